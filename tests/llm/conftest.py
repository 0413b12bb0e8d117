import pytest

ODD = ["", " ", "\n\n", "one", "two words", "a b c d e", "A b C d E", "x\ty\x0bz\x0c", "日本 語 テキスト é", "no break space",
       "tail <|endoftext|> and </s>[INST] x [/INST] | \\ <|user|>", "\x1c\x1d odd\x1e gaps\x1f", "aaaa" * 50, "🙂 " * 30]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, odd and very long texts, ties, repeated rows, extra columns."""
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(ODD)]
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    rows += [(100, long, "en", "s1", len(long)), (101, long, None, None, None), (102, None, "en", "s0", 0),
             (None, "text without an id", "en", None, 18), (None, None, None, None, None),
             (103, "same row twice " * 20, "en", "s0", 1), (103, "same row twice " * 20, "en", "s0", 1),
             (104, "one id and", "en", "s1", 1), (104, "two texts", "en", "s2", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
