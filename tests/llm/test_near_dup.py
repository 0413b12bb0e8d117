"""Near-duplicates and components against brute force."""
import numpy as np

from kestrel.llm import components, near_dup


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else (tuple(words[i:i + 5]) for i in range(len(words) - 4)))


def brute(docs, percent):
    """doc_id -> smallest doc_id reachable; rows of one doc_id are one document."""
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def corpus(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(rng.integers(30, 200))]
        for _ in range(12):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, max(2, len(words) // 25))):
                words[at] = f"x{rng.integers(0, 10**6)}"
            docs.append(" ".join(words))
    passage = " ".join(f"common{i}" for i in range(60))
    docs += [passage + " " + " ".join(f"own{k}n{i}" for i in range(rng.integers(3, 80))) for k in range(30)]
    docs += ["A b c", "a B\tc", "a b", "", None, " \n"]
    order = rng.permutation(len(docs))
    return [(int(i) * 3, docs[k]) for i, k in enumerate(order)]


def test_components_against_brute_force(spark):
    for seed, percent in ((1, 85), (2, 80)):
        docs = corpus(seed)
        got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(docs, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingles(t)) for d, t in docs}


def test_two_families_in_one_list(spark):
    """Unlinked families that share half of their shingles need the pairs between components."""
    rng = np.random.default_rng(9)
    shared = [f"s{i}" for i in range(150)]
    docs = []
    for k in range(80):
        words = shared + [f"f{k % 2}w{i}" for i in range(40)]
        for at in rng.integers(0, len(words), rng.integers(0, 7)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        docs.append((k, " ".join(words)))
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs, 85)


def test_odd_input(spark, odd_documents, no_documents):
    assert near_dup.near_duplicates(no_documents).count() == 0
    rows = odd_documents.collect()
    got = near_dup.near_duplicates(odd_documents).collect()
    assert len(got) == len(rows)
    expected = brute([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 85)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    left = near_dup.drop_near_duplicates(odd_documents)
    assert left.columns == odd_documents.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(None) == 2 and 101 not in ids and ids.count(103) == 1 and ids.count(104) == 1


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    none = components.connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_intersections_by_products():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 9000, n)) for n in (5, 3000, 1, 700)]
    other = [np.unique(rng.integers(0, 9000, n)) for n in (4000, 2, 900)]
    got = near_dup._common(own, other)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in other] for x in own]


def test_fringe_of_unlinked_copies(spark, monkeypatch):
    """Many texts alike by about 70 %, a few links among them, compared in several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.choice(200, 7 if k % 3 else 2, replace=False):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(196)} for t in texts]
    parent = list(range(150))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(150):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, percent=80).collect()}
    assert got == {i: find(i) for i in range(150)}
