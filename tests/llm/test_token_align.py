"""Cross-tokenizer alignment against whole-text encoding and nested loops."""
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm import token_align as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def reference(rows):
    a_of = Tokenizer.from_file(A)
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes, b_bytes = ta.a_bytes(A), ta.b_bytes(b_of)
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            docs.append((doc_id, [], [], [], ""))
            continue
        groups, links, i, j, end_a, end_b, at = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a):
            links.append((a[i], b[j]))
            stop_a, stop_b = end_a + len(a_bytes[a[i]]), end_b + len(b_bytes[b[j]])
            if stop_a <= stop_b:
                i, end_a = i + 1, stop_a
            if stop_b <= stop_a:
                j, end_b = j + 1, stop_b
            if stop_a == stop_b:
                groups.append((a[at[0]:i], b[at[1]:j]))
                at = (i, j)
        counts.update(links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc_id, a, b, links, hashlib.sha256(text.encode()).hexdigest(), len(groups)))
    most = {}
    for (x, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for d in docs:
        links = d[3]
        out.append((d[0], len(d[1]), len(d[2]), d[5] if len(d) > 5 else 0, len(links),
                    sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), d[4]))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


TRICKY = ["a  b   c    d ", "  two before", "tail space ", "x\n\n  y\n z\t\t w", "un▁der", "<s> </s> <|endoftext|> <0x41>",
          "é日本語🙂🙂 ñ", "\x00\x01 \x7f", "a　b c d   e", "   ", " ", "don't I'll  we've 12345 3.14", "\x1c \x1d x",
          "aaaa" * 300 + " " + "b" * 999, "ﬁ ﬀ ① Å", "\r\n a\r\n", "x.\r\ny();\r\n  z}\r\n\r\n'\rs ',\r", "it''s 'roll x'\n'y ''z",
          "one\ntwo.\nthree\n\nfour.\n five\t\tsix\u3000seven\u2009eight e\u0301a\u0301 x\u00b2. 5a6b"]


@pytest.mark.parametrize("head", [1_000_000, 300, 0])
def test_report_against_nested_loops(spark, odd_documents, head):
    """Odd texts and the documents of the smallest table, with all, some and no counts sent to tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tricky = spark.createDataFrame(list(enumerate(TRICKY, 10_000)), "doc_id long, text string")
    df = docs.unionByName(tricky).unionByName(odd_documents.select("doc_id", "text")).repartition(6)
    want = reference([(r["doc_id"], r["text"]) for r in df.collect()])
    got = ta.alignment_report(df.withColumn("row", F.lit("x")).withColumn("n_a", F.lit(1)), A, B, head_pairs=head)
    assert got.columns == COLUMNS
    assert order(got.collect()) == order(want)


def test_bounded_memory_gives_the_same(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    whole, small = ta.Aligner(A, B), ta.Aligner(A, B, limit=50)
    assert list(whole.align(texts)) == [x for t in texts for x in small.align([t])]


def test_vocabularies_allow_chunks():
    assert not ta.Aligner(A, B).whole


def test_identity_map():
    a, b = [b"x", b" the", b"", b"\xc3"], [b"<unk>", b"x", b"x", b" the", b"\xc3"]
    assert ta.identity_map(a, b).tolist() == [2, 3, -1, 4]


def test_empty_table(spark, no_documents):
    out = ta.alignment_report(no_documents, A, B)
    assert out.columns == COLUMNS and out.count() == 0
