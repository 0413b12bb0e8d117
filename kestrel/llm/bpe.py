"""Byte-level BPE encoding with a pair occurrence index, and decoding.

Encoding works per batch of a partition.  The batch's distinct pre-tokens that are not known yet
lie end to end in one symbol array with links to the left and right neighbour.  An index maps
the rank of each pair to all its positions; a heap gives the active ranks in ascending order.
Applying a rank merges all its positions at once, takes them out of the links and appends the
pairs that arise to the lists of their ranks; entries that a later merge has changed are seen to
be stale when their rank comes up.  A pair that holds a merged symbol always has a higher rank
than the merge that made the symbol, so one ascending pass yields the same merges as encoding
each pre-token by itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import Memory, missing

# Fixed value: the pattern that splits text before the merges (white space as in Unicode).
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


#: Pre-tokens that a worker remembers (two generations of this many).
REMEMBERED = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Vocabulary, merges and a bounded memory of encoded pre-tokens."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {
            i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        self.width = 1 + max(self.token_bytes)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_order = np.argsort(keys, kind="stable")
        self.rank_keys = keys[self.rank_order]
        self.known = Memory(limit)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without a merge."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.rank_keys, key), len(self.rank_keys) - 1)
        return np.where(self.rank_keys[at] == key, self.rank_order[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, merged together through one pair occurrence index."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        if n == 0:
            return [[] for _ in pieces]
        sym = self.byte_id[data]
        ends = np.cumsum(sizes)
        right = np.arange(1, n + 1)
        right[ends[sizes > 0] - 1] = -1
        left = np.arange(-1, n - 1)
        left[(ends - sizes)[sizes > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def post(positions: np.ndarray) -> None:
            """Append positions (of pairs with their right neighbour) to the lists of their ranks."""
            ranks = self._ranks(sym[positions], sym[right[positions]])
            has = ranks >= 0
            positions, ranks = positions[has], ranks[has]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for a, z, r in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
                if r in index:
                    index[r].append(positions[a:z])
                else:
                    index[r] = [positions[a:z]]
                    heapq.heappush(active, r)

        post(np.flatnonzero(right >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.made[r]
            q = right[p]
            live = (sym[p] == a) & (q >= 0) & (sym[q] == b)
            p, q = p[live], q[live]
            if a == b and len(p) > 1:  # runs of overlapping pairs merge from the left
                p = np.sort(p)
                begins = np.concatenate([[True], right[p[:-1]] != p[1:]])
                at = np.arange(len(p))
                first = np.maximum.accumulate(np.where(begins, at, 0))
                p = p[(at - first) % 2 == 0]
                q = right[p]
            if not len(p):
                continue
            after = right[q]
            sym[p], sym[q] = new, -1
            right[p] = after
            inner = after >= 0
            left[after[inner]] = p[inner]
            before = left[p]
            touched = np.concatenate([before[before >= 0], p[inner]])
            if len(touched):
                post(touched if len(touched) == 1 else np.unique(touched))
        alive = sym >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        ids = sym[alive].tolist()
        stops = kept[ends].tolist()
        starts = kept[ends - sizes].tolist()
        return [ids[a:z] for a, z in zip(starts, stops)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order; joined they are the text."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return PATTERN.findall(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            out.extend([part] if part in self.special else PATTERN.findall(part))
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of new pre-tokens; special tokens are their own id."""
        merged = iter(self.merge([w.encode() for w in words if w not in self.special]))
        return [array("i", [self.special[w]] if w in self.special else next(merged)).tobytes() for w in words]

    def encode_batch(self, texts: list[str], chars: int = 2_000_000):
        """The ids (int32) of each text; texts are taken together up to about ``chars`` at a time."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= chars):
                size += len(texts[stop])
                stop += 1
            cut = [self.pieces(t) for t in texts[at:stop]]
            self.known.learn({w for words in cut for w in words}, self._ids)
            ids = self.known.__getitem__
            for words in cut:
                yield np.frombuffer(b"".join(map(ids, words)), dtype=np.int32)
            at = stop

    def decode(self, ids) -> str:
        """Text of ids; special tokens are kept, broken UTF-8 becomes U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_CODERS: dict[str, ByteBPE] = {}


def coder(path: str, limit: int = REMEMBERED) -> ByteBPE:
    """One coder per Python worker and file."""
    if path not in _CODERS:
        _CODERS[path] = ByteBPE(path, limit)
    _CODERS[path].known.limit = limit
    return _CODERS[path]


def by_chars(batch, chars: int = 2_000_000):
    """(rows, texts) of a record batch in runs of about ``chars`` code points, so that what is
    made of them stays small."""
    texts = batch.column("text").to_pylist()
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= chars):
            size += len(texts[stop])
            stop += 1
        yield batch.slice(at, stop - at), texts[at:stop]
        at = stop


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    """A list column of packed ids."""
    stops = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(stops, pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *rows])))


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every whole text (null: empty, no ids).  Rows stay in their partition;
    repeated rows are encoded alike, an empty table stays empty, other columns are ignored."""
    missing(docs, "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = coder(tokenizer)
        for b in batches:
            for part, texts in by_chars(b):
                ids = list(bpe.encode_batch(texts))
                yield pa.record_batch([part.column("doc_id"), id_lists(ids)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of (doc_id, ids) rows; null ids give a null text."""
    missing(tokens, "doc_id", "ids")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = coder(tokenizer)
        for b in batches:
            texts = [None if i is None else bpe.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")) \
        .mapInArrow(run, "doc_id long, text string")


def round_trip_report(docs: DataFrame, tokenizer: str, with_ids: bool = False,
                      limit: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of
    the text decoded from those ids), encoded and decoded in one pass over the texts; on request
    also the ids.  A worker remembers at most two times ``limit`` pre-tokens.  Nulls, repeats and empty tables as in ``encode_documents``."""
    missing(docs, "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())]
                       + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        bpe = coder(tokenizer, limit)
        decimal = [str(i) for i in range(bpe.width)].__getitem__
        sha = hashlib.sha256
        for b in batches:
            for part, texts in by_chars(b):
                n, ids_sha, text_sha, kept = [], [], [], []
                for packed in bpe.encode_batch(texts):
                    ids = packed.tolist()
                    n.append(len(ids))
                    ids_sha.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                    text_sha.append(sha(bpe.decode(ids).encode()).hexdigest())
                    if with_ids:
                        kept.append(packed)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()),
                                       pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                                      + [id_lists(kept)] * with_ids, schema=schema)

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInArrow(run, columns)
