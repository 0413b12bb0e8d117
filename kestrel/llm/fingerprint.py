"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraph pieces (at line ends and sentence ends, and after 200 characters
without either); each piece has a 64-bit digest, and the k-th repetition of a piece in a text has
a digest of its own.  A sketch of m cells adds each digest to three cells (count, key sum, check
sum).  Subtracting the sketches of two versions leaves only the pieces that differ; peeling cells
that hold one digest recovers them.  When peeling gets stuck the two versions are sketched again
with four times the cells, until it succeeds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import LOWEST, bucket_of, missing, range_bounds, shuffle_partitions

#: Cells of the stored fingerprint; a multiple of HASHES.
CELLS = 24
HASHES = 3
#: Code points of texts that are sketched together.
CHUNK_CHARS = 2_000_000

_PIECE = re.compile(r"[^.!?\n]{1,200}[.!?\n]*|[.!?\n]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests:
    """Piece digests of many texts: flat array and owner of each, plus counts per text."""

    def __init__(self, texts: list[str]):
        digest = xxhash.xxh3_64_intdigest
        lists = [list(map(digest, _PIECE.findall(t))) for t in texts]
        self.counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        keys = np.fromiter((k for x in lists for k in x), dtype=np.uint64, count=int(self.counts.sum()))
        owner = np.repeat(np.arange(len(texts)), self.counts)
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        # number repeated pieces of a text: 0 for the first, 1 for the second ...
        at = np.arange(len(keys))
        first = np.ones(len(keys), dtype=bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        nth = (at - np.maximum.accumulate(np.where(first, at, 0))) if len(keys) else at
        self.keys = _mix(keys + nth.astype(np.uint64) * _GOLDEN)
        self.owner = owner
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the texts ``which``, owners renumbered by their place in ``which``."""
        counts = self.counts[which]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[which] - (ends - counts), counts)
        return self.keys[at], np.repeat(np.arange(len(which)), counts)


def _cells_of(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """The HASHES cells (rows) of each digest, one in each third of its text's sketch."""
    part = cells // HASHES
    return np.stack([owner * cells + j * part + (
        _mix(keys + np.uint64((j + 1) * 0x51ED270B + cells)) % np.uint64(part)).astype(np.int64)
        for j in range(HASHES)])


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys * _GOLDEN + np.uint64(1)) >> np.uint64(32)


class Sketches:
    """Sketches of ``texts`` texts with ``cells`` cells each, laid end to end."""

    def __init__(self, texts: int, cells: int):
        self.texts, self.cells = texts, cells
        self.count = np.zeros(texts * cells, dtype=np.int64)
        self.key = np.zeros(texts * cells, dtype=np.uint64)
        self.check = np.zeros(texts * cells, dtype=np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: int = 1) -> Sketches:
        check, apply = _check(keys), np.add.at if sign > 0 else np.subtract.at
        for at in _cells_of(keys, owner, self.cells):
            np.add.at(self.count, at, sign)
            apply(self.key, at, keys)
            apply(self.check, at, check)
        return self

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.texts, self.cells)
        out.count, out.key, out.check = (
            self.count - other.count, self.key - other.key, self.check - other.check)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recover the digests: (keys, owner, sign, done per text).  Empties the sketches."""
        found = []
        look = np.flatnonzero(self.count)
        while len(look):
            sign = self.count[look]
            look = look[np.abs(sign) == 1]
            sign = self.count[look]
            keys = np.where(sign > 0, self.key[look], np.uint64(0) - self.key[look])
            check = np.where(sign > 0, self.check[look], np.uint64(0) - self.check[look])
            pure = _check(keys) == check
            keys, sign, owner = keys[pure], sign[pure], look[pure] // self.cells
            if not len(keys):
                break
            order = np.lexsort((keys, owner))
            keys, sign, owner = keys[order], sign[order], owner[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, sign, owner = keys[new], sign[new], owner[new]
            for s in (1, -1):
                self.add(keys[sign == s], owner[sign == s], -s)
            found.append((keys, owner, sign))
            look = np.unique(_cells_of(keys, owner, self.cells))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(self.texts, self.cells).any(axis=1)
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint64), none, none, done
        keys, owner, sign = (np.concatenate(x) for x in zip(*found))
        return keys, owner, sign, done

    def strings(self, counts: np.ndarray) -> list[str]:
        """Each sketch as text: base64 of the piece count and the cells."""
        cell = np.zeros(self.texts * self.cells, dtype=[("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
        cell["n"], cell["key"], cell["check"] = self.count, self.key, self.check & np.uint64(0xFFFFFFFF)
        head = counts.astype("<u4")
        cell = cell.reshape(self.texts, self.cells)
        return [base64.b64encode(head[i].tobytes() + cell[i].tobytes()).decode()
                for i in range(self.texts)]


def sketch(digests: Digests, cells: int = CELLS) -> Sketches:
    return Sketches(len(digests.counts), cells).add(digests.keys, digests.owner)


def differences(a: Digests, b: Digests, left: np.ndarray, right: np.ndarray,
                first: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair (text ``left[i]`` of ``a``, text ``right[i]`` of ``b``) the digests that only
    the first and only the second has.  ``first`` are their sketches of CELLS cells, if at hand."""
    out: list = [None] * len(left)
    todo, cells = np.arange(len(left)), CELLS
    while len(todo):
        ka, oa = a.of(left[todo])
        kb, ob = b.of(right[todo])
        if first is not None and cells == CELLS:
            diff = first[0].minus(first[1])
        else:
            diff = Sketches(len(todo), cells).add(ka, oa).add(kb, ob, -1)
        keys, owner, sign, done = diff.peel()
        order = np.argsort(owner, kind="stable")
        keys, owner, sign = keys[order], owner[order], sign[order]
        cuts = np.searchsorted(owner, np.arange(len(todo) + 1))
        for i in np.flatnonzero(done):
            k, s = keys[cuts[i]:cuts[i + 1]], sign[cuts[i]:cuts[i + 1]]
            out[todo[i]] = (k[s > 0], k[s < 0])
        sizes = a.counts[left[todo]] + b.counts[right[todo]]
        # so many cells that only equal digests of different pieces can block the peeling
        blocked = ~done & (cells > 64 * (sizes + HASHES))
        for i in np.flatnonzero(blocked):
            x, y = ka[oa == i], kb[ob == i]
            out[todo[i]] = (np.setdiff1d(x, y), np.setdiff1d(y, x))
        todo, cells = todo[~done & ~blocked], cells * 4
    return out


def likeness(n_left: int, only_left: int, only_right: int) -> float:
    """Shared pieces over all pieces of two versions; two empty versions are alike."""
    whole = n_left + only_right
    return 1.0 if whole == 0 else (n_left - only_left) / whole


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _report(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """Columns of the report for documents whose following texts are given; the followers of a
    run are the run itself shifted by one, so each text is digested once."""
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    n = len(texts)
    with np.errstate(over="ignore"):
        own, new = Digests([*texts, following[-1]]), Digests(edited)
        base, changed = sketch(own), sketch(new)
        at = np.arange(n)

        def rows(s: Sketches, a: int, z: int) -> Sketches:
            part = Sketches(z - a, s.cells)
            cut = slice(a * s.cells, z * s.cells)
            part.count, part.key, part.check = s.count[cut], s.key[cut], s.check[cut]
            return part

        to_edited = differences(own, new, at, at, (rows(base, 0, n), changed))
        to_next = differences(own, own, at, at + 1, (rows(base, 0, n), rows(base, 1, n + 1)))
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": base.strings(own.counts)[:n], "edited_fingerprint": changed.strings(new.counts),
        "near_edited": [likeness(int(own.counts[i]), len(x), len(y)) for i, (x, y) in enumerate(to_edited)],
        "near_next": [likeness(int(own.counts[i]), len(x), len(y)) for i, (x, y) in enumerate(to_next)],
        "n_pieces": own.counts[:n].tolist(),
        "only_before": [len(x) for x, _ in to_edited], "only_edited": [len(y) for _, y in to_edited]}


REPORT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_pieces long, only_before long, only_edited long")
_REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
    ("near_next", pa.float64()), ("n_pieces", pa.int64()), ("only_before", pa.int64()),
    ("only_edited", pa.int64())])


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document.

    The next document is the one with the next smaller doc_id (null smallest, equal ids by text
    hash); after the last comes the first.  Texts are shuffled once, into doc_id ranges; each
    range also gets the first document of the range after it, so neighbours meet in one task.
    Null texts count as empty.  An empty table gives no row, a single document follows itself.
    """
    missing(docs, "doc_id", "text")
    parts = shuffle_partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    bounds = range_bounds(docs, "doc_id", parts)
    # the highest id of each range: at most one row per shuffle partition
    tops = dict(docs.select(bucket_of(key, bounds).alias("b"), key.alias("k"))
                .groupBy("b").agg(F.max("k")).collect())
    filled = sorted(tops)
    receiver = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    size = len(bounds) + 1

    def lookup(values: list) -> F.Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    top = lookup([tops.get(b, LOWEST) for b in range(size)])
    to = lookup([receiver.get(b, 0) for b in range(size)])
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("k"), bucket_of(key, bounds).alias("b"),
                       F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    here = F.struct(F.col("b").cast("long").alias("bucket"), F.lit(False).alias("halo"))
    there = F.struct(F.get(to, F.col("b")).alias("bucket"), F.lit(True).alias("halo"))
    rows = rows.select("doc_id", "k", "tie", "text", F.explode(F.when(
        F.col("k") == F.get(top, F.col("b")), F.array(here, there)).otherwise(F.array(here))).alias("at"))
    rows = rows.select("at.bucket", "at.halo", "k", "tie", "doc_id", "text")
    ordered = rows.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "halo", F.col("k").desc(), "tie")

    def followed(batches) -> Iterator[tuple]:
        """(doc_id, text, following text) of every document."""
        waiting = None
        for b in batches:
            for halo, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("halo", "doc_id", "text"))):
                if waiting is not None:
                    yield (*waiting, text)
                waiting = None if halo else (doc_id, text)

    def run(batches):
        ids, texts, following, size = [], [], [], 0
        for doc_id, text, after in followed(batches):
            if texts and (size > CHUNK_CHARS or following[-1] is not text):
                yield pa.record_batch(pa.table(_report(ids, texts, following), _REPORT).to_batches()[0].columns,
                                      schema=_REPORT)
                ids, texts, following, size = [], [], [], 0
            ids.append(doc_id)
            texts.append(text)
            following.append(after)
            size += len(text)
        if texts:
            yield pa.record_batch(pa.table(_report(ids, texts, following), _REPORT).to_batches()[0].columns,
                                  schema=_REPORT)

    return ordered.mapInArrow(run, REPORT)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces and fingerprint of every document (null text: empty), without a shuffle."""
    missing(docs, "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in batches:
            with np.errstate(over="ignore"):
                d = Digests(b.column("text").to_pylist())
                yield pa.record_batch([b.column("doc_id"), pa.array(d.counts, pa.int64()),
                                       pa.array(sketch(d).strings(d.counts), pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInArrow(run, "doc_id long, n_pieces long, fingerprint string")
