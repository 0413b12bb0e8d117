"""Line dedup by winnowing over line hashes.

The lines of a text that hold a word are hashed (128 bits).  From each line on, a gram is the shortest run
of lines with GRAM_WORDS words and a window the shortest run with RUN_WORDS words.  Winnowing
selects in every window the gram with the smallest hash, so any two texts that share a run of
RUN_WORDS words select the same gram inside it.  Selected positions meet the first position of
their gram and the first one whose whole window is the same; from there the match is extended
both ways, by ranks of line blocks of doubled length.  A match of at least RUN_WORDS words is a repeated run, and its later
occurrence is deleted.  The first positions may hold only the head of a longer run, so the
shortest run of RUN_WORDS words that ends at a line meets its first position as well: each line
of a repeated run lies in a window or in such a run inside it.  Lines go only where an equal run stands earlier (smaller doc_id, then
text hash, then line), so the first occurrence of everything stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import LOWEST, fresh, missing, written

GRAM_WORDS = 25
RUN_WORDS = 50
#: Documents that are hashed into one record batch.
ROWS = 1000


def line_hashes(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """128-bit hash (of the line without outer white space; 16 bytes each), word count and line
    number of each line with a word."""
    hashes, words, numbers = [], [], []
    for number, line in enumerate(text.encode().split(b"\n")):
        n = len(line.split())
        if n:
            hashes.append(xxhash.xxh3_128_digest(line.strip()))
            words.append(n)
            numbers.append(number)
    return b"".join(hashes), np.array(words, dtype=np.int32), np.array(numbers, dtype=np.int32)


def winnow(data: bytes, words: np.ndarray, gram_words: int = GRAM_WORDS,
           run_words: int = RUN_WORDS) -> list[tuple[int, int, int]]:
    """(gram hash, window hash, position) of the gram selected in each window of the lines whose
    hashes are ``data``."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if total[-1] < run_words:
        return []
    gram_end = np.searchsorted(total, total[:-1] + gram_words)
    run_end = np.searchsorted(total, total[:-1] + run_words)
    n = len(words)
    grams = [xxhash.xxh3_64_intdigest(data[16 * i:16 * e]) if e <= n else None
             for i, e in enumerate(gram_end.tolist())]
    # grams that end inside the window: starts up to the last one whose end is not beyond
    last = np.searchsorted(gram_end, run_end, side="right").tolist()
    out = []
    for i, e in enumerate(run_end.tolist()):
        if e > n:
            break
        best, at = min((grams[j], -j) for j in range(i, last[i]))
        out.append((best, xxhash.xxh3_64_intdigest(data[16 * i:16 * e], seed=1), -at))
    return out


def tails(data: bytes, words: np.ndarray, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(hash, position of the first line) of the shortest run of ``run_words`` words ending at
    each line, without those that are windows themselves."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    start = np.searchsorted(total, total[1:] - run_words, side="right") - 1
    run_end = np.searchsorted(total, total[:-1] + run_words)
    return [(xxhash.xxh3_64_intdigest(data[16 * i:16 * e], seed=1), i)
            for e, i in enumerate(start.tolist(), 1) if i >= 0 and run_end[i] < e]


def _lists(rows: list[np.ndarray], names: tuple[str, ...]) -> pa.Array:
    """A list column of structs: hashes (long) by name and at last a position (int)."""
    table = np.concatenate(rows) if rows else np.zeros((0, len(names)), dtype=np.int64)
    fields = [pa.array(table[:, i].astype(np.int32) if n == "pos" else table[:, i]) for i, n in enumerate(names)]
    stops = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(stops, pa.StructArray.from_arrays(fields, names))


def _table(found: list[tuple], width: int) -> np.ndarray:
    """Rows of unsigned hashes and a position as signed integers."""
    return np.array(found, dtype=np.uint64).reshape(-1, width).view(np.int64)


def _hash_rows(docs: DataFrame, gram_words: int, run_words: int) -> DataFrame:
    """Per document key (doc, tie): line hashes, words and line numbers as packed bytes, selected
    grams and tails."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                hashes, words, numbers, posts, ends = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    h, w, k = line_hashes(text)
                    hashes.append(h)
                    words.append(w.tobytes())
                    numbers.append(k.tobytes())
                    posts.append(_table(sorted(set(winnow(h, w, gram_words, run_words))), 3))
                    ends.append(_table(tails(h, w, run_words), 2))
                yield pa.record_batch([
                    part.column("doc"), part.column("tie"), pa.array(hashes, pa.binary()), pa.array(words, pa.binary()),
                    pa.array(numbers, pa.binary()), _lists(posts, ("gram", "win", "pos")), _lists(ends, ("win", "pos"))],
                    names=["doc", "tie", "hashes", "words", "numbers", "posts", "tails"])

    return docs.mapInArrow(run, "doc long, tie long, hashes binary, words binary, numbers binary, "
                                "posts array<struct<gram: long, win: long, pos: int>>, "
                                "tails array<struct<win: long, pos: int>>")


def _block_ranks(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ...: numbers of the blocks of 2^k symbols from each place on, equal exactly
    where the blocks are equal (blocks that reach beyond the end are all different)."""
    ranks = [x]
    while (2 << (len(ranks) - 1)) <= longest:
        half, step = ranks[-1], 1 << (len(ranks) - 1)
        left = len(half) - step
        pair = half[:left] * (half.max() + 1) + half[step:]
        up = np.full(len(half), -1, dtype=np.int64)
        up[:left] = np.unique(pair, return_inverse=True)[1]
        beyond = np.arange(len(half))[max(0, len(x) - 2 * step + 1):]
        up[beyond] = len(half) + beyond
        ranks.append(up)
    return ranks


def _common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols agree from the places i and j on (pairs of places inside)."""
    i, j = i.copy(), j.copy()
    n, out = len(ranks[0]), np.zeros(len(i), dtype=np.int64)
    for k in reversed(range(len(ranks))):
        # blocks of one size may agree more than once only for the largest size
        while True:
            inside = (i < n) & (j < n)
            same = np.zeros(len(i), dtype=bool)
            same[inside] = ranks[k][i[inside]] == ranks[k][j[inside]]
            if not same.any():
                break
            step = same * (1 << k)
            i, j, out = i + step, j + step, out + step
            if k < len(ranks) - 1:
                break
    return out


def common_runs(own: np.ndarray, other: np.ndarray | None, at: np.ndarray, shift: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """First and last place in ``own`` of the longest run around each place ``at`` that equals the
    run ``shift`` places before it in ``other`` (None: in ``own`` itself); the last is before the
    first where the place itself differs.

    Runs are measured by ranks of blocks of doubled length, so that a passage that returns n
    times costs n log n comparisons, not n times the length of the text.
    """
    if other is None:
        line, offset = np.concatenate([own, [own.max() + 1]]), 0
    else:  # both sides, each closed by a symbol of its own
        top = max(own.max(), other.max())
        line, offset = np.concatenate([own, [top + 1], other, [top + 2]]), len(own) + 1
    longest = len(own) if other is None else min(len(own), len(other))
    i, j = at, offset + at - shift
    right = _common(_block_ranks(line, longest), i, j)
    back = len(line) - 1
    if other is None:
        turned = np.concatenate([line[:-1][::-1], line[-1:]])
        ri, rj = back - 1 - i, back - 1 - j
    else:
        turned = line[::-1]
        turned = np.concatenate([turned[1:], turned[:1]])  # the closing symbols stay at the ends
        ri, rj = back - 1 - i, back - 1 - j
    left = _common(_block_ranks(turned, longest), ri, rj)
    return at - np.maximum(left, 1) + 1, at + right - 1


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ascending ranges with the same members as the ranges first..last."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    begins = np.concatenate([[True], first[1:] > last[:-1] + 1])
    starts = np.flatnonzero(begins)
    return list(zip(first[starts].tolist(), last[np.append(starts[1:], len(first)) - 1].tolist()))


def _extended(pairs: DataFrame, rows: DataFrame, run_words: int) -> DataFrame:
    """(doc, tie, runs): disjoint ranges of line numbers of the repeated runs, both ends included,
    of a document against one source.

    A row holds a document, one of its sources (none, if it is the document itself) and all places
    of the document that match the source, with their distances: each text travels once a pair.
    """
    lines = rows.select("doc", "tie", "hashes", "words", "numbers")
    source = rows.select(F.col("doc").alias("src"), F.col("tie").alias("src_tie"), F.col("hashes").alias("src_hashes"))
    itself = (F.col("doc") == F.col("src")) & (F.col("tie") == F.col("src_tie"))
    own = pairs.where(itself).join(lines, ["doc", "tie"]).withColumn("src_hashes", F.lit(None).cast("binary"))
    aligned = pairs.where(~itself).join(lines, ["doc", "tie"]).join(source, ["src", "src_tie"])
    columns = ["doc", "tie", "at", "hashes", "words", "numbers", "src_hashes"]
    symbol = np.dtype([("hi", "<u8"), ("lo", "<u8")])

    def symbols(*texts: bytes) -> list[np.ndarray]:
        """Numbers for the lines of the texts, equal where the hashes are."""
        whole = np.frombuffer(b"".join(texts), dtype=symbol)
        numbered = np.unique(whole, return_inverse=True)[1].astype(np.int64)
        return np.split(numbered, np.cumsum([len(t) // 16 for t in texts])[:-1])

    def run(batches):
        for b in batches:
            docs, ties, found = [], [], []
            for r in range(b.num_rows):
                doc, tie, at, hashes, words, numbers, src = (b.column(c)[r].as_py() for c in columns)
                own, other = (symbols(hashes)[0], None) if src is None else symbols(hashes, src)
                places = np.array([(x["pos"], x["shift"]) for x in at], dtype=np.int64)
                first, last = common_runs(own, other, places[:, 0], places[:, 1])
                total = np.concatenate([[0], np.cumsum(np.frombuffer(words, dtype=np.int32), dtype=np.int64)])
                long = (last >= first) & (total[last + 1] - total[first] >= run_words)
                if long.any():
                    number = np.frombuffer(numbers, dtype=np.int32)
                    docs.append(doc)
                    ties.append(tie)
                    found.append([{"start": int(number[x]), "stop": int(number[y])}
                                  for x, y in _merged(first[long], last[long])])
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(ties, pa.int64()), pa.array(found, kind)],
                                  names=["doc", "tie", "runs"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = "doc long, tie long, runs array<struct<start: int, stop: int>>"
    return own.select(*columns).unionByName(aligned.select(*columns)).mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc, tie, runs): the line ranges of each document that repeat an earlier run.

    ``docs`` has doc, tie and text.  Fingerprints are reduced to their first positions with
    map-side combination before they are joined, and a document's matches travel as positions,
    so a passage in a third of all documents costs one row per document.
    """
    rows = written(_hash_rows(docs, gram_words, run_words), "line-rows")
    posts = rows.select("doc", "tie", F.explode("posts").alias("f")).select(
        "doc", "tie", "f.gram", "f.win", "f.pos")
    ends = rows.select("doc", "tie", F.explode("tails").alias("f")).select("doc", "tie", "f.win", "f.pos")
    place = F.struct("doc", "tie", "pos")
    pairs = None
    for marks, keys in ((posts, ["gram"]), (posts, ["gram", "win"]), (ends, ["win"])):
        first = marks.groupBy(*keys).agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1")
        met = marks.join(first, keys).where(F.col("at") < place).select(
            "doc", "tie", F.col("at.doc").alias("src"), F.col("at.tie").alias("src_tie"),
            F.struct("pos", (F.col("pos") - F.col("at.pos")).alias("shift")).alias("at"))
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.groupBy("doc", "tie", "src", "src_tie").agg(F.collect_set("at").alias("at"))
    runs = _extended(pairs, rows, run_words)
    return runs.groupBy("doc", "tie").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from text, and n_lines and n_removed
    (lines before and lines deleted) appended; blank lines inside a deleted run go with it.

    Null texts stay null, texts under ``run_words`` words are never touched, very long texts are
    compared whole, and a document may repeat itself.  Null doc_ids come first.  Rows equal in
    doc_id and text are one document: they lose the same lines.  An empty table stays empty;
    other columns pass through (n_lines and n_removed of the input are replaced).
    """
    missing(docs, "doc_id", "text")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    doc, tie = fresh(docs, "__doc"), fresh(docs, "__tie")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    text = F.coalesce("text", F.lit(""))
    small = docs.where("text IS NOT NULL").select(key.alias("doc"), F.xxhash64("text").alias("tie"), text.alias("text"))
    runs = repeated_runs(small, gram_words, run_words).select(
        F.col("doc").alias(doc), F.col("tie").alias(tie), "runs")
    keyed = docs.withColumn(doc, key).withColumn(tie, F.xxhash64("text"))
    repeats, left = fresh(docs, "__runs"), fresh(docs, "__left")
    joined = keyed.join(runs.withColumnRenamed("runs", repeats), [doc, tie], "left")
    lines = F.split(text, "\n", -1)
    # in ascending order each range keeps the lines between the stop before it and its start
    kept = F.aggregate(
        F.sort_array(repeats), F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<from: int, n: int>>").alias("gaps")),
        lambda s, r: F.struct(
            F.greatest(s["next"], r["stop"] + 1).alias("next"),
            F.when(r["start"] > s["next"], F.concat(s["gaps"], F.array(F.struct(
                s["next"].alias("from"), (r["start"] - s["next"]).alias("n"))))).otherwise(s["gaps"]).alias("gaps")))
    joined = joined.withColumns({"n_lines": F.size(lines), left: F.when(F.col(repeats).isNotNull(), kept)})
    gaps = F.concat(F.col(left)["gaps"], F.array(F.struct(
        F.col(left)["next"].alias("from"), (F.col("n_lines") - F.col(left)["next"]).alias("n"))))
    # the lines are bound by a lambda, so that a text is split once
    joined = joined.withColumn(left, F.get(F.transform(F.array(lines), lambda ls: F.flatten(F.transform(
        gaps, lambda g: F.slice(ls, g["from"] + 1, F.greatest(g["n"], F.lit(0)))))), 0))
    removed = F.coalesce(F.col("n_lines") - F.size(left), F.lit(0))
    return joined.select(*[
        F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")).alias(c)
        if c == "text" else F.col(c) for c in docs.columns],
        F.col("n_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
