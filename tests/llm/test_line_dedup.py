"""Line dedup: guarantee, minimality and content safety against a brute-force reading."""
import numpy as np

from kestrel.llm import line_dedup as ld


def lines_of(text):
    return [x.strip() for x in (text or "").split("\n") if x.split()]


def windows_seen_earlier(docs):
    """Lines of (sorted) documents inside a 50-word window that occurred at an earlier place."""
    seen, out = set(), {}
    for key, text in docs:
        lines = lines_of(text)
        gone = set()
        for i in range(len(lines)):
            size, end = 0, i
            while end < len(lines) and size < 50:
                size += len(lines[end].split())
                end += 1
            if size < 50:
                break
            run = tuple(lines[i:end])
            if run in seen:
                gone.update(range(i, end))
            seen.add(run)
        out[key] = gone
    return out


def test_random_corpora(spark):
    rng = np.random.default_rng(3)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.integers(3, 70))) for k in range(12)]
    texts = []
    for d in range(60):
        lines = []
        for _ in range(rng.integers(0, 6)):
            if rng.random() < 0.6:
                a = rng.integers(0, 10)
                lines += pool[a:a + rng.integers(1, 4)]
            lines.append(rng.choice(["", "  ", f"own {d} " * 9, "short common line"]))
        texts.append("\n".join(lines))
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    must = windows_seen_earlier(docs)
    assert sum(map(len, must.values())) > 20
    kept = set()
    for i, text in docs:
        lines, left = lines_of(text), lines_of(got[i].text)
        rest = iter([x for k, x in enumerate(lines) if k not in must[i]])
        assert all(any(x == y for y in rest) for x in left)  # everything guaranteed is gone
        assert got[i].n_lines == text.count("\n") + 1
        if not got[i].n_removed:
            assert got[i].text == text
        kept.update(left)
    assert kept == {x for _, t in docs for x in lines_of(t)}  # the first of everything stays


def test_short_repeats_and_context(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = [(1, f"intro one\n{shared}\nend one"), (2, f"intro two\n  {shared} \nend two"),
            (3, "intro one\nnot long enough"), (4, f"{shared}\n{shared}")]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "intro two\nend two", 3: docs[2][1], 4: ""}


def test_extension_takes_the_tail(spark):
    """A short line after a long repeated one belongs to the run, although no window holds it."""
    shared = " ".join(f"s{i}" for i in range(60)) + "\ntail"
    docs = [(1, shared + "\na"), (2, shared + "\nb")]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "b"}


def lines_in_earlier_runs(docs):
    """Lines of (sorted) documents inside any run of 50 words or more that stood earlier."""
    seen, out = set(), {}
    for key, text in docs:
        lines = lines_of(text)
        gone = set()
        for i in range(len(lines)):
            for end in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:end])
                if sum(len(x.split()) for x in run) >= 50:
                    if run in seen:
                        gone.update(range(i, end))
                    seen.add(run)
        out[key] = gone
    return out


def test_tail_after_an_earlier_head(spark):
    """The first position of a run holds only its head; the longer run of a later document counts."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(20))
    docs = [(1, f"{a}\nx"), (2, f"{a}\n{b}\ny"), (3, f"{a}\n{b}\nz"), (4, f"{b}\n{a}\nu"), (5, f"{b}\n{a}\nv")]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: f"{b}\ny", 3: "z", 4: f"{b}\nu", 5: "v"}


def test_every_line_of_repeated_runs(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.integers(3, 70))) for k in range(9)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(rng.integers(1, 5)):
            at = rng.integers(0, 8)
            lines += pool[at:at + rng.integers(1, 6)] + [f"own {d} {len(lines)}"]
        docs.append((d, "\n".join(lines)))
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = lines_in_earlier_runs(docs)
    assert got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs}


def test_odd_input(spark, odd_documents, no_documents):
    assert ld.dedup_lines(no_documents).count() == 0
    out = ld.dedup_lines(odd_documents.withColumnRenamed("lang", "n_lines").withColumnRenamed("n_chars", "__doc"))
    assert out.columns == ["doc_id", "text", "source", "__doc", "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[100].n_removed == 0 and by[101].text == "" and by[102].text is None
    assert sum(r.text is None for r in rows) == 2
    assert [r.n_removed for r in rows if r.doc_id == 103] == [0, 0]


def test_common_runs_against_a_walk():
    rng = np.random.default_rng(8)
    for trial in range(200):
        own = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.int64)
        other = None if trial % 2 else rng.integers(0, 4, rng.integers(1, 60)).astype(np.int64)
        source = own if other is None else other
        places = [(i, i - j) for i in range(len(own)) for j in range(len(source)) if other is not None or j < i]
        if not places:
            continue
        at, shift = (np.array(c) for c in zip(*places))
        first, last = ld.common_runs(own, other, at, shift)
        for k, (i, s) in enumerate(places):
            a, z = i, i - 1
            if own[i] == source[i - s]:
                z = i
                while a > 0 and a - 1 - s >= 0 and own[a - 1] == source[a - 1 - s]:
                    a -= 1
                while z + 1 < len(own) and z + 1 - s < len(source) and own[z + 1] == source[z + 1 - s]:
                    z += 1
            assert (first[k], last[k]) == (a, z)


def test_column_names_of_the_operator(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"one\n{shared}", "a", "b", "c", "d"), (2, f"two\n{shared}", "e", "f", "g", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, __left string, __runs string, hashes string")
    got = sorted(ld.dedup_lines(df).drop("n_lines", "n_removed").collect())
    assert got == [rows[0], (2, "two", "e", "f", "g", "h")]


def test_long_repetitive_text(spark):
    """2 MB in which one passage returns 10,000 times between lines of its own."""
    import time
    passage = "\n".join(f"line {i} " + "of the passage " * 8 for i in range(2))
    text = "\n".join(f"{passage}\nown {i}" for i in range(10_000))
    assert len(text) > 2_000_000
    t = time.time()
    got = ld.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert time.time() - t < 60
    assert got.text == passage + "\n" + "\n".join(f"own {i}" for i in range(10_000))
