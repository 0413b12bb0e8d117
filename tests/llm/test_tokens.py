"""BPE and token stores against the tokenizers library."""
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kestrel.llm import bpe, token_files
from tests.llm.conftest import ODD

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
HARD = ODD + ["  a  b\n\n c<|endoftext|>x <|endoftext|>", "aaaaaaaaaaaaaaa aaaa", "ΣΑΣ İstanbul a\u0085b",
              "'s't 'LL it's", "\r\n\t x", "café x́", "½ ² ١٢", "<|startoftext|>hi<|endoftext|>",
              "ab " * 3000, "a" * 20000, "x​y 　 z"]


def encoded(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_merges_ascend():
    """What the single ascending pass rests on: no merge uses a symbol made by a later one."""
    c = bpe.ByteBPE(BYTE)
    made = {int(m): r for r, m in enumerate(c.made)}
    assert len(made) == len(c.made)
    assert all(made.get(int(x), -1) < r for r in range(len(c.made)) for x in (c.left[r], c.right[r]))


def test_pair_index_equals_library():
    lib, expected = encoded(BYTE, HARD)
    c = bpe.ByteBPE(BYTE)
    got = list(c.encode_batch(HARD, chars=500))
    assert [list(map(int, g)) for g in got] == expected
    assert [c.decode(g) for g in got] == [lib.decode(e, skip_special_tokens=False) for e in expected]
    assert c.decode([200, 201, 220, 255]) == lib.decode([200, 201, 220, 255], skip_special_tokens=False)


def test_bounded_memory_does_not_change_ids():
    _, expected = encoded(BYTE, HARD)
    c = bpe.ByteBPE(BYTE, limit=10)
    assert [list(map(int, g)) for g in c.encode_batch(HARD, chars=50)] == expected
    _, expected = encoded(WORD, HARD)
    w = token_files.WordEncoder(WORD, limit=10)
    assert [w.encode(t).tolist() for t in HARD] == expected


def test_latin_pre_tokens_equal_library():
    texts = [f"x{chr(i)}Y{chr(i)}{chr(i)}9'S{chr(j)}A" for i in range(1, 256) for j in (i, 255 - i or 1, 39)]
    _, expected = encoded(WORD, texts)
    w = token_files.WordEncoder(WORD)
    assert [w.encode(t).tolist() for t in texts] == expected


def test_round_trip_documents(spark, odd_documents, no_documents):
    rows = odd_documents.collect()
    lib, ids = encoded(BYTE, [r.text or "" for r in rows])
    expected = sorted((r.doc_id or -1, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                       hashlib.sha256((r.text or "").encode()).hexdigest()) for r, i in zip(rows, ids))
    got = bpe.round_trip_report(odd_documents, BYTE).collect()
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == expected
    back = bpe.decode_documents(bpe.encode_documents(odd_documents, BYTE), BYTE)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in rows)
    assert bpe.round_trip_report(no_documents, BYTE, with_ids=True).count() == 0


def test_token_store(spark, odd_documents, no_documents, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 300)
    path = f"file://{tmp_path}/store"
    token_files.write_tokens(odd_documents, path, WORD, end_id=1)
    tie = {(r.doc_id, r.text or ""): r.h for r in odd_documents.selectExpr(
        "doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in odd_documents.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, tie[r]))
    _, ids = encoded(WORD, [t for _, t in rows])
    expected, start = [], 0
    for (doc_id, _), i in zip(rows, ids):
        i = np.array([*i, 1], dtype="<u4")
        expected.append((-1 if doc_id is None else doc_id, start, len(i), zlib.crc32(i.tobytes())))
        start += len(i)
    got = token_files.read_report(spark, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(expected)
    few = token_files.read_tokens(spark, path, [5, 100]).collect()
    assert {r.doc_id: (r.start, len(r.ids)) for r in few} == {e[0]: e[1:3] for e in expected if e[0] in (5, 100)}
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(no_documents, empty, WORD)
    assert token_files.read_report(spark, empty).count() == 0


def test_damaged_dictionary_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i} and more words") for i in range(30)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    token_files.write_tokens(docs, path, WORD)
    other = spark.createDataFrame([("0" * 64, b"x", 2)], "dictionary_sha256 string, dictionary binary, id_bytes int")
    other.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_files.read_tokens(spark, path)


def test_dictionary_of_long_documents_only(spark, tmp_path):
    """Documents beyond the piece length train a dictionary, the same one in every run."""
    import numpy as np
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 8000))) for i in range(20)], "doc_id long, text string")
    found = []
    for k, df in enumerate((docs, docs.repartition(7))):
        token_files.write_tokens(df, str(tmp_path / str(k)), WORD)
        row = spark.read.parquet(str(tmp_path / str(k) / "dictionary")).first()
        assert len(row["dictionary"]) > 1000
        found.append(row["dictionary_sha256"])
        assert token_files.read_report(spark, str(tmp_path / str(k))).count() == 20
    assert found[0] == found[1]
