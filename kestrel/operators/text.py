"""D — text features, row verbalization and prompt/response handling.

Bag-of-words and TF-IDF are computed in long form ``(row_id, term, value)``:
tokens are exploded, the 300-term vocabulary is a bounded top-k of the terms'
total counts (broadcast) by which tokens are filtered before rows are grouped; document frequencies and term frequencies are grouped counts, and the L2 norm is
a per-row aggregate.  Whole texts are tokenized (no prefixes).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.exprs import quote_ident
from kestrel.functions.prefix import prefix_sums
from kestrel.session import cut_lineage, unbounded

# Fixed pattern: tokens of two or more word characters (letters, digits, underscore)
# after lower-casing — the vectorizer default, written with Unicode classes so
# that the JVM and SQL engines agree on non-ASCII letters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


#: Words that one task fits word vectors on, and numbers of the vectors of as many words that one task averages.
PART_WORDS, PART_NUMBERS = 1_000_000, 16_000_000
#: Distinct words that Spark ML, which keeps them all on the driver, fits vectors of.
VOCABULARY = 100_000
#: Words of a sentence; a longer text counts as several (as in Spark ML's Word2Vec).
SENTENCE = 1000


def _c(name: str) -> Column:
    return F.col(quote_ident(name))


def join_text(cols: Sequence[str]) -> Column:
    """D1 — text columns joined with a space."""
    return F.concat_ws(" ", *[_c(c).cast("string") for c in cols])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def _doc_tokens(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """One document per (row, column): ``(row_id, doc, term)`` exploded."""
    docs = df.select(F.col(quote_ident(row_id)).alias("row_id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("doc"), _c(c).cast("string").alias("t")) for c in cols]))
        .alias("d")).select("row_id", "d.doc", "d.t")
    return docs.select("row_id", "doc", F.explode(tokens(F.col("t"))).alias("term"))


def term_counts(df: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """Token counts per (row, column document, term): one tokenization, one
    map-side-combined aggregation; everything below reads this table."""
    return _doc_tokens(df, row_id, cols).groupBy("row_id", "doc", "term").agg(
        F.count(F.lit(1)).alias("n"))


def top_terms(df: DataFrame, row_id: str, cols: Sequence[str], max_features: int = 300) -> DataFrame:
    """The ``max_features`` terms with the greatest total count, ties broken by the term:
    ``(term, tf_total)``.  Terms are counted without their rows, so that what travels are the
    distinct terms of a task; bounded and written once."""
    return cut_lineage(_doc_tokens(df, row_id, cols).groupBy("term").agg(F.count(F.lit(1)).alias("tf_total"))
                       .orderBy(F.desc("tf_total"), "term").limit(max_features))


def _vocabulary_counts(df: DataFrame, row_id: str, cols: Sequence[str], terms: DataFrame) -> DataFrame:
    """:func:`term_counts` of the vocabulary's terms only; it has at most max_features rows: broadcast."""
    return (_doc_tokens(df, row_id, cols).join(F.broadcast(terms.select("term")), "term", "left_semi")
            .groupBy("row_id", "doc", "term").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(df: DataFrame, row_id: str, cols: Sequence[str], max_features: int = 300,
               terms: DataFrame | None = None) -> DataFrame:
    """Top ``max_features`` terms by total count over the (row, column)
    documents; ties broken by the term.  ``(term, tf_total, df)``; bounded."""
    terms = top_terms(df, row_id, cols, max_features) if terms is None else terms
    return _vocabulary_counts(df, row_id, cols, terms).groupBy("term").agg(
        F.sum("n").alias("tf_total"), F.count(F.lit(1)).alias("df"))


def _row_tf(counts: DataFrame, cols: Sequence[str]) -> DataFrame:
    # the joined text's tokens are the union of its columns' tokens (a space separates columns),
    # so row term frequencies are sums over the documents
    if len(cols) == 1:
        return counts.select("row_id", "term", F.col("n").alias("tf"))
    return counts.groupBy("row_id", "term").agg(F.sum("n").alias("tf"))


def bag_of_words(df: DataFrame, row_id: str, cols: Sequence[str], max_features: int = 300,
                 terms: DataFrame | None = None) -> DataFrame:
    """D2 — counts of vocabulary terms in each row's joined text, long form
    ``(row_id, term, tf)`` (absent terms are zeros).  ``terms``: :func:`top_terms`, if known."""
    terms = top_terms(df, row_id, cols, max_features) if terms is None else terms
    return _row_tf(_vocabulary_counts(df, row_id, cols, terms), cols)


def tfidf(df: DataFrame, row_id: str, cols: Sequence[str], max_features: int = 300,
          terms: DataFrame | None = None) -> DataFrame:
    """D3 — ``tf * (ln((1+n)/(1+df)) + 1)`` with n the number of (row, column)
    documents, each row L2-normalized; long form ``(row_id, term, tfidf)``.  A row has at most
    ``max_features`` terms, which are normalized together."""
    terms = top_terms(df, row_id, cols, max_features) if terms is None else terms
    counts = _vocabulary_counts(df, row_id, cols, terms)
    vocab = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs = df.agg((F.count(F.lit(1)) * len(cols)).alias("n_docs"))
    idf = (vocab.crossJoin(F.broadcast(n_docs))  # one row
           .select("term", (F.ln((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    per_row = (_row_tf(counts, cols).join(F.broadcast(idf), "term")
               .groupBy("row_id").agg(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("v"))).alias("w")))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x["v"] * x["v"]))
    return per_row.withColumn("norm", norm).select("row_id", "norm", F.inline("w")).select(
        "row_id", "term", (F.col("v") / F.col("norm")).alias("tfidf"))


def to_dense(long: DataFrame, vocab_terms: Sequence[str], value: str, row_id: str = "row_id"
             ) -> DataFrame:
    """Long form to one ``ARRAY<DOUBLE>`` per row in vocabulary order."""
    terms = F.array(*[F.lit(t) for t in vocab_terms])
    m = long.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("term", value))).alias("m"))
    return m.select(row_id, F.transform(terms, lambda t: F.coalesce(
        F.element_at("m", t).cast("double"), F.lit(0.0))).alias("vec"))


def _words(cols: Sequence[str]) -> Column:
    return F.regexp_extract_all(join_text(cols), F.lit(r"\S+"), 0)


def _n_words(df: DataFrame, cols: Sequence[str]) -> int:
    return df.agg(F.sum(F.size(_words(cols)))).first()[0] or 0


def _part_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of ``n`` parts such that a shuffle into ``n`` partitions sends each part to its own."""
    found = {r.at: r.key for r in spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at"))
             .agg(F.min("id").alias("key")).collect()}
    return [found.get(p, 32 * n + p) for p in range(n)]


def _dealt(df: DataFrame, cols: Sequence[str], n: int, *keep: Column) -> DataFrame:
    """``(keep, piece, part)``: the texts' words, joined by spaces in pieces of SENTENCE words, dealt to ``n``
    parts.  Written once: the part must mean the same rows in each use."""
    last = F.floor((F.size("words") - 1) / SENTENCE).cast("int")
    pieces = df.select(*keep, _words(cols).alias("words")).select(
        *[c for c in ("row_id",) if keep], F.explode(F.when(F.size("words") > 0, F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice("words", i * SENTENCE + 1, F.lit(SENTENCE)), " ")))).alias("piece"))
    keys = F.array(*[F.lit(k) for k in _part_keys(df.sparkSession, n)])
    return cut_lineage(pieces.repartition(n).withColumn("part", F.element_at(keys, F.spark_partition_id() + 1)))


def _part_words(dealt: DataFrame) -> DataFrame:
    """Distinct words of each part and how often they occur there: ``(part, word, n)``."""
    return (dealt.select("part", F.explode(F.split("piece", " ")).alias("word"))
            .groupBy("part", "word").agg(F.count(F.lit(1)).alias("n")))


def _by_part(dealt: DataFrame, words: DataFrame, n: int, run, schema) -> DataFrame:
    """``run(part, pieces, words)`` for each part's pieces and what is known of its words (Arrow tables)."""
    left = dealt.repartition(n, "part").groupBy("part")
    right = words.withColumnRenamed("part", "at").repartition(n, "at").groupBy("at")
    return left.cogroup(right).applyInArrow(lambda key, p, w: run(key[0].as_py(), p, w), schema)


def _indices(pieces: pa.Table, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all words, piece after piece, the position in ``words`` (-1: not there); where the pieces end."""
    split = pc.split_pattern(pieces["piece"].combine_chunks(), " ")
    at = pc.fill_null(pc.index_in(split.flatten(), value_set=words), -1)
    return (at.to_numpy(zero_copy_only=False).astype(np.int64),
            np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()),
                                    pa.array(rows.ravel()))


def _fit_parts(dealt: DataFrame, local: DataFrame, leaves: DataFrame, runs: Sequence[tuple[int, int]],
               n: int, dim: int, seed: int) -> DataFrame:
    """Skip-gram with hierarchical softmax (:mod:`kestrel.functions.skipgram`) on each part; a word's vectors are
    averaged, weighted by how often a part moved them.  A task holds the words of its part only."""
    from kestrel.functions import skipgram as S
    tree, root = S.huffman(runs), 2 * sum(k for _, k in runs) - 2
    total = sum(w * k for w, k in runs)
    number = {k: p for p, k in enumerate(_part_keys(dealt.sparkSession, n))}

    def run(key, pieces, words):
        words, part = words.sort_by("leaf"), number[key]
        # in an order that does not depend on how the rows arrived
        pieces = pieces.sort_by("piece")
        pieces = pieces.take(pa.array(np.random.default_rng([seed & 0xFFFFFFFF, part, 1]).permutation(len(pieces))))
        names = words["word"].combine_chunks()
        at, ends = _indices(pieces, names)
        known = at >= 0  # others are too rare
        ends = np.r_[0, np.cumsum(known)][ends]
        vec, moved = S.train(at[known], ends, words["leaf"].to_numpy(), tree, root, dim, total, n, part, seed)
        # a word that no part moved, alone in its sentences, keeps its first vector, the same in each part
        return pa.table({"word": names, "n": np.maximum(moved, 1e-9), "vec": _lists(vec)})

    fitted = _by_part(dealt, local.join(unbounded(leaves), "word").select("part", "word", "leaf"), n, run,
                      "word string, n double, vec array<float>")
    sums = fitted.groupBy("word").agg(F.sum("n").alias("n"), *[
        F.sum(F.col("vec")[i] * F.col("n")).alias(f"v{i}") for i in range(dim)])
    return cut_lineage(sums.select("word", F.array(*[F.col(f"v{i}") / F.col("n") for i in range(dim)]).alias("vec")))


def fit_word_vectors(df: DataFrame, cols: Sequence[str], dim: int = 100, min_count: int = 5,
                     steps: int = 1, seed: int = 1) -> DataFrame:
    """Word vectors ``(word, vec)`` of dimension ``dim`` fitted on the texts (Spark ML
    Word2Vec); words rarer than ``min_count`` have none.  Texts of more than PART_WORDS words are
    fitted in as many parts, whose vectors Word2Vec averages, so that no task fits them all.
    Word2Vec keeps the vocabulary on the driver: of more than VOCABULARY words, one pass over the
    parts is made by the same method without it."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    total = _n_words(df, cols)
    n = max(1, -(-total // PART_WORDS))
    if total > VOCABULARY and steps == 1:
        dealt = _dealt(df, cols, n)
        local = cut_lineage(_part_words(dealt))
        counts = (local.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
                  .withColumn("one", F.lit(1)))
        leaves = prefix_sums(counts, [], "n", ["one"], tiebreak=["word"]).select(
            "word", "n", F.col("one_before").alias("leaf"))
        # of N words, at most sqrt(2 N) different counts
        runs = sorted((r.n, r["count"]) for r in leaves.groupBy("n").count().collect())
        if sum(k for _, k in runs) > VOCABULARY:
            return _fit_parts(dealt, local, leaves, runs, n, dim, seed)
    words = df.select(F.coalesce(_words(cols), F.array().cast("array<string>")).alias("words"))
    model = Word2Vec(vectorSize=dim, minCount=min_count, maxIter=steps, seed=seed, inputCol="words", outputCol="v",
                     numPartitions=n).fit(words)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def mean_word_vectors(df: DataFrame, row_id: str, cols: Sequence[str], vectors: DataFrame,
                      dim: int) -> DataFrame:
    """D4 — mean of the known words' vectors (words split on whitespace,
    case-sensitive), zeros when no word is known.  ``vectors(word, vec)``.
    Rows are dealt to parts; the distinct words of a part are joined with the vectors, and its
    rows are averaged from them, so that words in running text are not shuffled one by one."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    rows = F.col(quote_ident(row_id)).alias("row_id")
    n = max(1, -(-_n_words(df, cols) * max(dim, 16) // PART_NUMBERS))
    dealt = _dealt(df, cols, n, rows)
    known = _part_words(dealt).join(unbounded(vectors.where(F.col("vec").isNotNull()).select(
        "word", F.transform("vec", lambda x: x.cast("double")).alias("vec"))), "word").select("part", "word", "vec")

    def run(key, pieces, words):
        names = words["word"].combine_chunks().dictionary_encode()
        of = names.indices.to_numpy(zero_copy_only=False)  # a word may have several vectors
        each = words["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1) \
            if len(of) else np.zeros((0, dim))
        times = np.r_[np.bincount(of, minlength=len(names.dictionary)), 0]
        sums = np.zeros((len(times), each.shape[1]))
        np.add.at(sums, of, each)
        at, ends = _indices(pieces, names.dictionary)
        starts = np.r_[0, ends[:-1]]
        weight, mean = np.zeros(len(pieces)), np.zeros((len(pieces), sums.shape[1]))
        for lo in range(0, len(pieces), 128):  # of at most SENTENCE words; unknown ones are at -1: zeros
            hi = min(lo + 128, len(pieces))
            here, begin = at[starts[lo]:ends[hi - 1]], starts[lo:hi] - starts[lo]
            weight[lo:hi] = np.add.reduceat(times[here], begin)
            mean[lo:hi] = np.add.reduceat(sums[here], begin, axis=0) / np.maximum(weight[lo:hi], 1)[:, None]
        out = pa.table({"row_id": pieces["row_id"], "n": weight, "vec": _lists(mean)})
        return out.filter(pa.array(weight > 0))

    schema = T.StructType([T.StructField("row_id", dealt.schema["row_id"].dataType), T.StructField("n", T.DoubleType()),
                           T.StructField("vec", T.ArrayType(T.DoubleType()))])
    vec = _by_part(dealt, known, n, run, schema).groupBy("row_id").agg(
        vector_to_array(Summarizer.mean(array_to_vector("vec"), F.col("n"))).alias("vec"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (df.select(rows).join(vec, "row_id", "left")
            .select("row_id", F.coalesce("vec", zeros).alias("vec")))


def format_value(c: Column, dtype: T.DataType) -> Column:
    """Value as text for reading: null ``N/A``, integers as integers, floats
    with 2 decimals, everything else as its string."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        s = F.format_string("%.2f", c.cast("double"))
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        s = c.cast("long").cast("string")
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit("N/A"))


def format_sample(df: DataFrame, cols: Sequence[str] | None = None, out: str = "sample") -> DataFrame:
    """D5 — ``col is value`` lines joined by newlines."""
    cols = list(cols or df.columns)
    lines = [F.concat(F.lit(f"{c} is "), format_value(_c(c), df.schema[c].dataType)) for c in cols]
    return df.withColumn(out, F.concat_ws("\n", *lines))


def samples_text(df: DataFrame, n: int, seed=0, key: str = "row_id",
                 cols: Sequence[str] | None = None) -> DataFrame:
    """D6 — ``### Sample i`` blocks over ``n`` hash-sampled rows as one text.
    ``n`` is the prompt's own sample count (a handful of rows)."""
    from kestrel.operators.sampling import sample_n
    cols = list(cols or [c for c in df.columns if c != key])
    s = format_sample(sample_n(df, n, seed, key), cols).withColumn(
        "__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(quote_ident(key)).cast("string"))))
    agg = s.agg(F.array_sort(F.collect_list(F.struct("__h", F.col(quote_ident(key)).alias("k"),
                                                     "sample"))).alias("xs"))
    return agg.select(F.aggregate(
        F.sequence(F.lit(1), F.size("xs")), F.lit(""),
        lambda acc, i: F.concat(acc, F.lit("### Sample "), i.cast("string"), F.lit("\n"),
                                F.element_at("xs", i)["sample"], F.lit("\n\n"))).alias("text"))


def serialize_rows(df: DataFrame, row_id: str, orders, cols: Sequence[str]) -> DataFrame:
    """D7 — per row and order: ``" col is value "`` joined by ``,`` in the order's
    column sequence; an empty value is ``None``.  The (small) order table is plan
    metadata: rows x orders are produced by one projection, no join."""
    from kestrel.operators.scoring import orders_list
    olist = orders if isinstance(orders, list) else orders_list(orders)

    def val(c):
        return F.coalesce(F.nullif(F.trim(_c(c).cast("string")), F.lit("")), F.lit("None"))
    items = [F.struct(F.lit(oid).alias("order_id"), F.concat_ws(",", *[
        F.concat(F.lit(f" {c} is "), val(c), F.lit(" ")) for c in ocols]).alias("text"))
        for oid, ocols in olist]
    return df.select(F.col(quote_ident(row_id)).alias("row_id"), F.inline(F.array(*items)))


def truncate_tokens(df: DataFrame, max_len: Mapping[str, int], default: int = 128,
                    cols: Sequence[str] | None = None) -> DataFrame:
    """D8 — per column, keep at most ``max_len(col) - name tokens`` whitespace
    tokens of the value (the name tokens are ``' col '`` plus ``'is'``) when the
    total reaches the limit (joined by single spaces); shorter values stay as they are;
    ``default`` for unlisted columns."""
    cols = list(cols or df.columns)
    out = df
    for c in cols:
        limit = max_len.get(c, default)
        name_tokens = len(c.split()) + 1
        toks = F.regexp_extract_all(_c(c).cast("string"), F.lit(r"\S+"), 0)
        cut = F.array_join(F.slice(toks, 1, max(limit - name_tokens, 0)), " ")
        out = out.withColumn(c, F.when(F.size(toks) + name_tokens >= limit, cut)
                             .otherwise(_c(c).cast("string")))
    return out


_PLACEHOLDER = re.compile(r"\$(?:\{(\w+)\}|(\w+))")


def render_prompts(df: DataFrame, template: str, params: Mapping[str, object] | None = None,
                   out: str = "prompt") -> DataFrame:
    """D9 — ``$name`` / ``${name}`` placeholders filled per row from columns (or
    constant ``params``); a placeholder with neither raises (strict)."""
    params = dict(params or {})
    names = [a or b for a, b in _PLACEHOLDER.findall(template)]
    missing = [n for n in names if n not in df.columns and n not in params]
    if missing:
        raise KeyError(f"template placeholders without a value: {sorted(set(missing))}")
    expr = F.lit(template)
    for n in sorted(set(names), key=len, reverse=True):
        val = _c(n).cast("string") if n in df.columns else F.lit(str(params[n]))
        val = F.coalesce(val, F.lit(""))
        expr = F.replace(expr, F.lit("${" + n + "}"), val)
        expr = F.regexp_replace(expr, r"\$" + n + r"(?![A-Za-z0-9_])", F.regexp_replace(val, r"([\\$])", r"\\$1"))
    return df.withColumn(out, expr)


def factor_summary(factors: DataFrame, order_col: str = "pos") -> DataFrame:
    """D10 — the factor catalogue as one review text: a numbered entry of four lines per
    factor, in ``order_col`` order.  The catalogue is small by nature; one row results."""
    values = F.array_join(F.transform("possible_values", lambda v: v.cast("string")), ", ")
    entry = F.concat_ws("\n", F.concat_ws(": ", "name", "description"),
                        F.concat(F.lit("  values: "), values),
                        F.concat(F.lit("  how to annotate: "), F.col("annotation_criteria")))
    entries = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("at"), entry.alias("entry"))))
    numbered = F.transform(entries, lambda e, i: F.concat((i + 1).cast("string"), F.lit(") "), e["entry"]))
    return factors.agg(F.array_join(numbered, "\n\n").alias("summary"))


def extract_json_text(c: Column) -> Column:
    """D11 — the JSON text of a model response: inside a ```json fence, else a
    plain fence, else the whole (trimmed) response."""
    fenced_json = F.regexp_extract(c, r"(?s)```json(.*?)(```|$)", 1)
    fenced = F.regexp_extract(c, r"(?s)```(.*?)(```|$)", 1)
    return F.trim(F.when(F.contains(c, F.lit("```json")), fenced_json)
                  .when(F.contains(c, F.lit("```")), fenced).otherwise(c))


def parse_fenced_json(c: Column, schema: str) -> Column:
    """D11 — parse the extracted JSON (permissive: malformed gives null)."""
    return F.from_json(extract_json_text(c), schema, {"mode": "PERMISSIVE"})


# JSON number literal (the only value type a possible value may have)
_JSON_NUMBER = r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?"
_NUMERIC_ARRAY = r"^\[\s*(" + _JSON_NUMBER + r"\s*(,\s*" + _JSON_NUMBER + r"\s*)*)?\]$"


def validate_factors(df: DataFrame, json_col: str = "json") -> DataFrame:
    """D12 — a proposal (JSON text in ``json_col``) is valid when it has both
    ``factors`` and ``recommended_focus_factors`` and every possible value of
    every factor is a JSON number (strings such as ``"5"`` are not); otherwise a
    reason.  The raw JSON of each factor is kept (a map to strings), so value
    types are checked on the JSON tokens."""
    doc = F.from_json(F.col(quote_ident(json_col)),
                      "factors MAP<STRING, STRING>, recommended_focus_factors STRING")
    pv_ok = F.forall(F.map_values(doc["factors"]), lambda f: F.coalesce(
        F.get_json_object(f, "$.possible_values"), F.lit("[]")).rlike(_NUMERIC_ARRAY))
    reason = (F.when(doc["factors"].isNull(), F.lit("no factors"))
              .when(doc["recommended_focus_factors"].isNull(),
                    F.lit("no recommended focus"))
              .when(~pv_ok, F.lit("a possible value is not a number")))
    return df.withColumn("valid", reason.isNull()).withColumn("reason", reason)
