"""Token-id files with a shared zstandard dictionary.

Layout of a token store (a folder):

* ``dictionary``  one Parquet row: dictionary_sha256, dictionary, id_bytes (2 or 4).
* ``blocks``      Parquet rows of about BLOCK_BYTES payload: bucket, block, start (ids of the
  bucket before the block), dictionary_sha256, and per document doc_ids, n_ids, offsets (one
  more than documents) into payload, the concatenated zstandard frames.

Documents are stored in ascending doc_id order (null first; equal ids by text hash): buckets are
doc_id ranges, blocks count up inside a bucket.  Each document is a frame of its own, so a short
document is read by slicing the payload at its offsets; the dictionary, trained on serialized id
arrays of a bounded sample, makes up for the context that single frames lack.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.bpe import byte_alphabet
from kestrel.llm.common import LOWEST, Remembered, bucket_of, missing, range_bounds, shuffle_partitions

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLOCK_BYTES = 4_000_000
LEVEL = 3
#: Dictionary training: about this many documents (never more than twice as many), chosen by the
#: hash of id and text; of a longer one a piece of SAMPLE_CHARS code points at a hashed place.
SAMPLE_DOCUMENTS = 400
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 65_536

BLOCK = ("bucket int, block int, start long, dictionary_sha256 string, doc_ids array<long>, "
         "n_ids array<int>, offsets array<int>, payload binary")

_ASCII_GAPS = re.compile(r"[^\x20\x09-\x0D]+")
_INFORMATION_SEPARATORS = re.compile("[\x1c-\x1f]")
# Fixed value: the pre-tokens of the vocabulary, for lower-cased Latin-1 text.
_LATIN_WORDS = re.compile(
    "[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:[stmd]|re|ve|ll)|[^a-z0-9ªµº²³¹¼½¾ß-öø-ÿ\x09-\x0d\x20\x85\xa0]+")


class WordEncoder:
    """Ids of whole texts from a tokenizers file that lower-cases, drops white space and splits
    into words, digits and punctuation before the merges.

    A text of Latin-1 characters is split into its pre-tokens; each goes through the library's
    merge model once and is then remembered.  Any other text, and one that may hold a special
    token, is cut at white space, and the library encodes (and this class remembers) the chunks
    as they are.  Both memories are bounded.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spell = {b: c for c, b in byte_alphabet().items()}.__getitem__
        self.chunks = Remembered(self._encode_chunk, limit // 5)
        self.words = Remembered(self._encode_word, limit)

    def split(self, text: str) -> list[str]:
        # str.split() also cuts at U+001C..U+001F, which the tokenizer keeps as characters
        return _ASCII_GAPS.findall(text) if _INFORMATION_SEPARATORS.search(text) else text.split()

    def _encode_word(self, word: str) -> bytes:
        """Ids of a pre-token by the library's merge model, which reads bytes as characters."""
        spelled = word if word.isascii() and word.isprintable() else "".join(map(self.spell, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids (uint32) of a text."""
        if _latin(text) and "<|" not in text:
            parts = map(self.words.__getitem__, _LATIN_WORDS.findall(text.lower()))
        else:
            parts = map(self.chunks.__getitem__, self.split(text))
        return np.frombuffer(b"".join(parts), dtype="<u4")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; with too few samples to train on, their
    own bytes serve as a raw dictionary (none: empty, frames then use no dictionary)."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _zdict(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write a token store.

    ``tokenizer`` is the path of a tokenizers file on every machine.  Texts are not shuffled:
    each document travels as its compressed frame to the range of doc_id it belongs to.  An
    empty table gives a store without blocks; repeated rows are stored repeatedly; columns other
    than doc_id and text are ignored.
    """
    missing(docs, "doc_id", "text")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    share = min(1.0, SAMPLE_DOCUMENTS / max(docs.count(), 1))
    point = F.xxhash64("doc_id", "text").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    # of a longer text a piece somewhere in it, so that tables of long documents get a dictionary too
    first = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - F.lit(SAMPLE_CHARS - 1), F.lit(1)))
    sampled = (docs.select(point.alias("point"), "doc_id", F.substring(F.col("text"), first.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
               .where(F.col("point") < share).orderBy("point", "doc_id", "text").limit(2 * SAMPLE_DOCUMENTS)
               .select("text").collect())
    coder = encoder(tokenizer)
    id_bytes = 2 if coder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    kind = f"<u{id_bytes}"
    dictionary = train_dictionary([
        ids.astype(kind).tobytes() for ids in map(coder.encode, (r[0] for r in sampled))])
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary, id_bytes)],
                          "dictionary_sha256 string, dictionary binary, id_bytes int") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    parts = shuffle_partitions(spark)
    bounds = range_bounds(docs, "doc_id", parts)
    tail = [] if end_id is None else [end_id]

    frame_type = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()),
                            ("n", pa.int32()), ("frame", pa.binary())])

    def compress(batches):
        coder = encoder(tokenizer)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, **_zdict(shared.value)).compress
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                b = whole.slice(at, 400)
                n, frames = [], []
                for text in b.column("text").to_pylist():
                    ids = np.append(coder.encode(text), tail).astype(kind)
                    n.append(len(ids))
                    frames.append(squeeze(ids.tobytes()))
                yield pa.record_batch([b.column("bucket"), b.column("doc_id"), b.column("tie"),
                                       pa.array(n, pa.int32()), pa.array(frames, pa.binary())],
                                      schema=frame_type)

    keyed = docs.select(
        bucket_of(F.coalesce("doc_id", F.lit(LOWEST)), bounds).cast("int").alias("bucket"),
        "doc_id", F.xxhash64("text").alias("tie"), "text")
    frames = keyed.mapInArrow(compress, "bucket int, doc_id long, tie long, n int, frame binary")

    block_type = pa.schema([
        ("bucket", pa.int32()), ("block", pa.int32()), ("start", pa.int64()),
        ("dictionary_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())),
        ("n_ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary())])

    def pack(batches):
        bucket = block = start = size = 0
        ids, counts, frames = [], [], []

        def flush():
            return pa.record_batch(
                [[bucket], [block], [start], [digest], [ids], [counts],
                 [np.cumsum([0, *map(len, frames)]).tolist()], [b"".join(frames)]], schema=block_type)

        for b in batches:
            for at, doc_id, n, frame in zip(*(b.column(c).to_pylist() for c in
                                              ("bucket", "doc_id", "n", "frame"))):
                if ids and (at != bucket or size + len(frame) > BLOCK_BYTES):
                    yield flush()
                    block, start = block + 1, start + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
                if at != bucket:
                    bucket, block, start = at, 0, 0
                ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
        if ids:
            yield flush()

    ordered = frames.repartitionById(parts, "bucket").sortWithinPartitions(
        "bucket", F.col("doc_id").asc_nulls_first(), "tie")
    ordered.mapInArrow(pack, BLOCK).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    digest, dictionary, id_bytes = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(dictionary)
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary of {path} is damaged")
    return digest, dictionary, id_bytes


def _read_blocks(spark: SparkSession, path: str, wanted: frozenset | None, fields: list[tuple],
                 row) -> DataFrame:
    """Rows made by ``row(doc_id, start, ids)`` of the documents of a token store."""
    digest, dictionary, id_bytes = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # one number per bucket, at most as many as shuffle partitions when the store was written
    totals = dict(blocks.select("bucket", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)
                                .alias("n")).groupBy("bucket").agg(F.sum("n")).collect())
    before, total = {}, 0
    for b in sorted(totals):
        before[b], total = total, total + totals[b]
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(
            *[F.lit(i) for i in sorted(wanted)]).cast("array<long>")))
    schema = pa.schema([(name, kind) for name, kind, _ in fields])

    def unpack(batches):
        expand = zstandard.ZstdDecompressor(**_zdict(shared.value)).decompress
        for b in batches:
            for i in range(b.num_rows):
                block = b.slice(i, 1).to_pylist()[0]
                if block["dictionary_sha256"] != digest:
                    raise ValueError("block and dictionary do not belong together")
                payload, offsets = block["payload"], block["offsets"]
                starts = before[block["bucket"]] + block["start"] + np.cumsum([0, *block["n_ids"]])
                places = [(k, doc) for k, doc in enumerate(block["doc_ids"]) if wanted is None or doc in wanted]
                for at in range(0, len(places), 500):
                    rows = [row(doc, int(starts[k]), np.frombuffer(
                        expand(payload[offsets[k]:offsets[k + 1]]), dtype=f"<u{id_bytes}"))
                        for k, doc in places[at:at + 500]]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.mapInArrow(unpack, ", ".join(f"{name} {kind}" for name, _, kind in fields))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a token store: doc_id, start (ids of all documents before it), ids.

    With ``doc_ids`` only the blocks that list them are kept, and only their frames are
    decompressed.  Frames written with another dictionary raise an error.
    """
    return _read_blocks(
        spark, path, None if doc_ids is None else frozenset(doc_ids),
        [("doc_id", pa.int64(), "long"), ("start", pa.int64(), "long"),
         ("ids", pa.list_(pa.int32()), "array<int>")],
        lambda doc, start, ids: (doc, start, ids.astype(np.int32)))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (unsigned, of the ids as little-endian uint32) of
    every document of a token store, from its files."""
    return _read_blocks(
        spark, path, None,
        [("doc_id", pa.int64(), "long"), ("start", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"),
         ("ids_crc32", pa.int64(), "long")],
        lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
