"""Cross-tokenizer alignment of a byte-level vocabulary (A) and a piece vocabulary (B).

Both encode the same bytes.  Where a token of A and a token of B end at the same byte, the text
is cut into groups; inside a group, the tokens whose bytes overlap are linked.  Almost all groups
of one token each hold an A id and the B id of the same bytes: an array made from the two
vocabularies gives that B id, so such links are counted in a vector over A's ids.  Only the links
of the other, irregular groups are counted by pair through a shuffle.

Texts are cut where neither tokenizer can join what stands on both sides (checked against both
files, else a text stays whole); each distinct chunk is encoded and aligned once and remembered.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.bpe import by_chars, byte_alphabet
from kestrel.llm.common import missing, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Links counted together in a task before its counts are merged.
LINKS = 2_000_000
#: Pairs whose counts are sent to all tasks (16 bytes each); the rarer ones are joined.
HEAD_PAIRS = 1_000_000
#: Remembered chunks per worker (two generations of at most about this many chunks or code
#: points), chunks encoded together, and code points of texts aligned at a time.
CHUNKS, CHUNK_CHARS, TOGETHER, CHARS = 120_000, 4_000_000, 8_192, 1_000_000

#: A chunk: white space and the letters or other characters after it; a line end before a letter
#: stands alone; an apostrophe keeps the letters after it, and a carriage return what follows it.
_CHUNK = regex.compile(r"\n(?=\p{L})|\s*\p{L}+"
                       r"|\s*[^\p{L}\s]+(?:(?<=')\p{L}+|(?<=[^\p{L}\s])\r\s*(?:\p{L}+|[^\p{L}\s]+|\Z))*|\s+")
_PLAIN = re.compile(" ?[A-Za-z]+")
#: What no piece may hold for that to be right (U+2581 is a space).
_CROSSING = regex.compile(r"\n|\p{L}[^\p{L}]|[^\p{L}\s▁']\p{L}|[^\s▁](?:[^\S\r]|▁)")


def a_bytes(path: str) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary file, by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of, vocab = byte_alphabet(), spec["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for t, i in vocab.items():
        if all(c in byte_of for c in t):
            out[i] = bytes(byte_of[c] for c in t)
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def b_bytes(processor) -> list[bytes]:
    """The bytes of each piece by id: U+2581 is a space, <0xHH> a byte."""
    return [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i)
            else processor.id_to_piece(i).replace("▁", " ").encode()
            for i in range(processor.get_piece_size())]


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id of the same bytes (a piece before a byte), -1 without one."""
    of = {}
    for i in reversed(range(len(b))):
        if b[i]:
            of[b[i]] = max(i, of[b[i]]) if b[i] in of and len(b[i]) == 1 else i
    return np.array([of.get(t, -1) if t else -1 for t in a], dtype=np.int64)


class Chunks:
    """What the alignment of a chunk gives, by number: tokens of A, of B, groups, whether it
    can't be spelled, the text of its groups, its equal links and its other links."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.chars = 0
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.groups: list[str] = []
        self.same: list[bytes] = []
        self.pairs: list[bytes] = []

    def add(self, chunks: list[str], counts: np.ndarray, groups, same, pairs) -> None:
        at = len(self.groups)
        self.number.update(zip(chunks, range(at, at + len(chunks))))
        self.chars += sum(map(len, chunks))
        self.counts = np.concatenate([self.counts, counts])
        self.groups.extend(groups)
        self.same.extend(same)
        self.pairs.extend(pairs)


class Aligner:
    """Both tokenizers of a worker and its memory of chunks."""

    def __init__(self, a_path: str, b_path: str, limit: int = CHUNKS):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = a_bytes(a_path), b_bytes(self.b)
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.same_bytes = identity_map(self.a_bytes, self.b_bytes)
        n = len(self.a_bytes)
        self.word = [f";{i}" for i in range(n)] + [f",{i}" for i in range(n)] \
            + [f"|{i}" for i in range(len(self.b_bytes))] + [f",{i}" for i in range(len(self.b_bytes))]
        self.kinds = link_kinds(n, len(self.b_bytes))
        self.limit = limit
        self.known, self.old = Chunks(), Chunks()
        split = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        self.whole = split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") \
            or any(_CROSSING.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())
                   if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        """A's ids of chunks; a chunk of at most a space and ASCII letters is one pre-token and
        goes straight to the merges."""
        if self.whole:
            return [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        merges, plain = self.a.model.tokenize, _PLAIN.fullmatch
        out = [[t.id for t in merges(c.replace(" ", "Ġ"))] if plain(c) else None for c in chunks]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.a.encode_batch([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks; a line end before each keeps the space off that B puts before a text."""
        if self.whole:
            return self.b.encode([c[1:] for c in chunks], num_threads=1)
        return [ids[2:] for ids in self.b.encode(["\n" + c for c in chunks], num_threads=1)]

    def learn(self, chunks: list[str]) -> None:
        """Encode, align and remember new chunks."""
        na, nb = len(self.a_bytes), len(self.b_bytes)
        a, b = self.encode_a(chunks), self.encode_b(chunks)
        spelled_a, spelled_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        equal = np.ones(len(chunks), dtype=bool)
        want = "".join(chunks).encode()
        if b"".join(map(spelled_a, chain.from_iterable(a))) != want \
                or b"".join(map(spelled_b, chain.from_iterable(b))) != want:
            for i, c in enumerate(chunks):
                want = c.encode()
                if b"".join(map(spelled_b, b[i])) != want or b"".join(map(spelled_a, a[i])) != want:
                    equal[i], a[i], b[i] = False, [], []
        ids_a = np.fromiter(chain.from_iterable(a), dtype=np.int64)
        ids_b = np.fromiter(chain.from_iterable(b), dtype=np.int64)
        n_a = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
        n_b = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        # every cut between neighbouring ends of either side bounds one overlapping pair
        cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        cuts = cuts[np.diff(cuts, prepend=0) > 0]
        link_a, link_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        group_ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(group_ends, ends_a), np.searchsorted(group_ends, ends_b)
        group_link = np.searchsorted(group_ends, cuts)
        size_a = np.bincount(group_a, minlength=len(group_ends))
        size_b = np.bincount(group_b, minlength=len(group_ends))
        before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        # the tokens of both sides in the order of the report, each with the mark before it
        lead_a = np.arange(len(ids_a)) != before_a[group_a]
        lead_b = np.arange(len(ids_b)) != before_b[group_b]
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        order[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + na * lead_a
        order[np.arange(len(ids_b)) + (before_a + size_a)[group_b]] = 2 * na + ids_b + nb * lead_b
        words = list(map(self.word.__getitem__, order.tolist()))
        linked_a, linked_b = ids_a[link_a], ids_b[link_b]
        plain = ((size_a == 1) & (size_b == 1))[group_link] & (self.same_bytes[linked_a] == linked_b)
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        chunk_of_token = np.repeat(np.arange(len(chunks)), n_a)
        chunk_of_link = chunk_of_token[link_a]
        groups = np.bincount(chunk_of_token[~lead_a], minlength=len(chunks))
        same = linked_a[plain].astype(self.kinds[0])
        pairs = (linked_a[~plain] * nb + linked_b[~plain]).astype(self.kinds[1])
        same_stop = np.cumsum(np.bincount(chunk_of_link[plain], minlength=len(chunks)))
        pair_stop = np.cumsum(np.bincount(chunk_of_link[~plain], minlength=len(chunks)))
        def parts(data: np.ndarray, stop: np.ndarray) -> list[bytes]:
            raw, width, stop = data.tobytes(), data.itemsize, stop.tolist()
            return [raw[width * x:width * y] for x, y in zip([0, *stop], stop)]

        bounds = zip((stop_a - n_a + stop_b - n_b).tolist(), (stop_a + stop_b).tolist())
        self.known.add(chunks, np.stack([n_a, n_b, groups, ~equal], axis=1),
                       ("".join(words[x:y]) for x, y in bounds), parts(same, same_stop), parts(pairs, pair_stop))

    def remember(self, chunks: set[str]) -> None:
        """Make every chunk known: from the old generation, else by learning it."""
        if len(self.known.groups) > self.limit or self.known.chars > CHUNK_CHARS:
            self.known, self.old = Chunks(), self.known
        missing = [c for c in chunks if c not in self.known.number]
        old = self.old.number
        again = [c for c in missing if c in old]
        at = [old[c] for c in again]
        self.known.add(again, self.old.counts[at], [self.old.groups[i] for i in at],
                       [self.old.same[i] for i in at], [self.old.pairs[i] for i in at])
        new = [c for c in missing if c not in old] if again else missing
        for i in range(0, len(new), TOGETHER):
            self.learn(new[i:i + TOGETHER])

    def align(self, texts: list[str]):
        """(n_a, n_b, n_groups, groups digest, A ids of equal links, pairs of the other links) of
        each text; zeros where it is empty or either side does not spell it."""
        cut = [[] if not t else [" " + t] if self.whole else _CHUNK.findall(" " + t) for t in texts]
        self.remember(set().union(*cut))
        known = self.known
        for chunks in cut:
            numbers = list(map(known.number.__getitem__, chunks))
            n_a, n_b, groups, wrong = known.counts[np.array(numbers)].sum(axis=0).tolist() if numbers else (0, 0, 0, 1)
            if wrong:
                yield 0, 0, 0, "", b"", b""
                continue
            text = "".join(map(known.groups.__getitem__, numbers))[1:]
            yield (n_a, n_b, groups, hashlib.sha256(text.encode()).hexdigest(),
                   b"".join(map(known.same.__getitem__, numbers)), b"".join(map(known.pairs.__getitem__, numbers)))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def link_kinds(n_a: int, n_b: int) -> tuple[str, str]:
    """The smallest little-endian integers that hold an A id, and a pair (A id * n_b + B id)."""
    return "<u2" if n_a <= 1 << 16 else "<u4", "<u4" if n_a * n_b <= 1 << 32 else "<u8"


def _rows(batches, rows: int = 500):
    """Batches cut into runs of rows, so that their links take little memory at a time.  The
    worker's memory of chunks is given back: no task of these stages encodes."""
    _ALIGNERS.clear()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _links(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all links of a binary column as long integers, how many each row has)."""
    rows = column.to_pylist()
    values = np.frombuffer(b"".join(rows), dtype=kind)
    return values.astype(np.int64), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // values.itemsize


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links as packed integers:
    ``same`` (A ids of links to the equal B id) and ``linked`` (pairs of all other links), of
    every whole text.

    A null or empty text, or one that a tokenizer does not spell, has no tokens.  Rows stay in
    their partition; repeated rows are alike, an empty table stays empty, other columns go.
    """
    missing(docs, "doc_id", "text")

    def run(batches):
        both = aligner(a_path, b_path)
        wide = [np.dtype(k).itemsize for k in both.kinds]
        for b, texts in chain.from_iterable(by_chars(b, CHARS) for b in batches):
            n_a, n_b, groups, sha, same, linked = map(list, zip(*both.align(texts)))
            links = [len(x) // wide[0] + len(y) // wide[1] for x, y in zip(same, linked)]
            yield pa.record_batch(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_a, n_b, groups, links)),
                 pa.array(sha, pa.string()), pa.array(same, pa.binary()), pa.array(linked, pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "linked"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "same binary, linked binary")


def pair_counts(aligned: DataFrame, same_bytes: np.ndarray, n_b: int) -> DataFrame:
    """(pair, b, n, best): how many links of the corpus each pair (A id * n_b + B id) holds, and
    whether no other pair of the B id holds more.  A task counts equal links in one vector over
    A's ids and sums the others by pair before they are shuffled."""
    kinds = link_kinds(len(same_bytes), n_b)

    def run(batches):
        vector = np.zeros(len(same_bytes), dtype=np.int64)
        waiting, size = [], 0

        def summed():
            keys, at = np.unique(np.concatenate([k for k, _ in waiting]), return_inverse=True)
            n = np.zeros(len(keys), dtype=np.int64)
            np.add.at(n, at, np.concatenate([c for _, c in waiting]))
            return keys, n

        def rows(keys, n):
            return pa.record_batch([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for b in _rows(batches):
            vector += np.bincount(_links(b.column("same"), kinds[0])[0], minlength=len(vector))
            keys, _ = _links(b.column("linked"), kinds[1])
            if len(keys):
                waiting.append(np.unique(keys, return_counts=True))
                size += len(waiting[-1][0])
            if size > LINKS:
                waiting = [summed()]
                size = len(waiting[0][0])
                if size > LINKS // 2:
                    yield rows(*waiting.pop())
                    size = 0
        if waiting:
            yield rows(*summed())
        used = np.flatnonzero(vector)
        yield rows(used * n_b + same_bytes[used], vector[used])

    counts = aligned.select("same", "linked").mapInArrow(run, "pair long, n long") \
        .groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % n_b)
    counts = written(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # at most one row per B id
    return written(counts.join(F.broadcast(most), "b").select(
        "pair", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def _head(counts: DataFrame, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(least count, sorted pairs, their counts, their best marks) of at most ``limit`` pairs:
    all pairs that occur at least the least count, a power of two."""
    sizes = {r["k"]: r["m"] for r in counts.groupBy(F.length(F.bin("n")).alias("k"))
             .agg(F.count(F.lit(1)).alias("m")).collect()}
    least, total = 1 << max(sizes, default=0), 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > limit:
            break
        least = 1 << (k - 1)
    rows = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow()
    pair = rows.column("pair").to_numpy()
    order = np.argsort(pair)
    return least, pair[order], rows.column("n").to_numpy()[order], \
        rows.column("best").to_numpy().astype(np.int64)[order]


def alignment_report(docs: DataFrame, a_path: str, b_path: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best counts a document's links whose corpus-wide count is the highest of their B id,
    count_sum adds the counts up.  The counts of equal links (one per A id) and of the frequent
    other pairs (at most ``head_pairs``) go to all tasks; links of rarer pairs are summed per
    document and joined.  Odd rows as in ``align_documents``.
    """
    both = aligner(a_path, b_path)
    n_b, same_bytes, kinds = len(both.b_bytes), both.same_bytes, both.kinds
    aligned = written(align_documents(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()),
                      "aligned")
    counts = pair_counts(aligned, same_bytes, n_b)
    ids = np.flatnonzero(same_bytes >= 0)
    own = counts.join(F.broadcast(docs.sparkSession.createDataFrame(
        [(int(p),) for p in ids * n_b + same_bytes[ids]], "pair long")), "pair")
    same_n, same_best = np.zeros(len(same_bytes), dtype=np.int64), np.zeros(len(same_bytes), dtype=np.int64)
    for r in own.collect():  # at most one row per A id
        same_n[r["pair"] // n_b], same_best[r["pair"] // n_b] = r["n"], r["best"]
    least, pair, n, best = _head(counts, head_pairs)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((same_n, same_best, pair, n, best))

    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total, stop = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
        return total[stop] - total[stop - sizes]

    def found(keys: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
        return at, (pair[at] == keys) if len(pair) else np.zeros(len(keys), dtype=bool)

    def score(batches):
        same_n, same_best, pair, n, best = shared.value
        for b in _rows(batches):
            same, n_same = _links(b.column("same"), kinds[0])
            keys, n_keys = _links(b.column("linked"), kinds[1])
            at, hit = found(keys, pair)
            other_n = np.where(hit, n[at], 0) if len(pair) else np.zeros(len(hit), dtype=np.int64)
            other_best = np.where(hit, best[at], 0) if len(pair) else np.zeros(len(hit), dtype=np.int64)
            n_best = sums(same_best[same], n_same) + sums(other_best, n_keys)
            count_sum = sums(same_n[same], n_same) + sums(other_n, n_keys)
            yield pa.record_batch(
                [b.column(c) for c in ("row", *kept)] + [pa.array(n_best), pa.array(count_sum)],
                names=["row", *kept, "n_best", "count_sum"])

    def rare(batches):
        pair = shared.value[2]
        for b in _rows(batches):
            keys, n_keys = _links(b.column("linked"), kinds[1])
            _, hit = found(keys, pair)
            rows = np.repeat(b.column("row").to_numpy(), n_keys)[~hit]
            if len(rows):
                order = np.lexsort((keys[~hit], rows))
                k, r = keys[~hit][order], rows[order]
                first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
                yield pa.record_batch([pa.array(r[first]), pa.array(k[first]),
                                       pa.array(np.diff(np.append(first, len(k))))], names=["row", "pair", "times"])

    kept = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
            "n_best long, count_sum long"
    scored = aligned.mapInArrow(score, schema)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:
        return scored.select(*columns)
    tail = counts.where(F.col("n") < least).select("pair", "n", "best")
    added = aligned.select("row", "linked").mapInArrow(rare, "row long, pair long, times long") \
        .join(tail, "pair").groupBy("row").agg(
            F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return scored.join(added, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*columns)
