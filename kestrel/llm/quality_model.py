"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled web text, a mixture
of good and bad documents with an estimated share of good ones (the class prior).  A linear score
over measures of the text minimises the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])        (l: logistic loss)

over all trusted positives and all unlabelled documents: every Newton step is one pass over the
table of measures, whose tasks send sums of the size of the model.  The prior is the best-bin
estimate: a first model tells positives from unlabelled rows, and where its score is high only
good documents are left, so the ratio of the unlabelled and the positive rows there is the share
of good ones.  Positives used for the estimate are not used for the first model.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import missing, written

#: Byte classes, in the order of their numbers; every other byte is of class 0 (control).
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
           b".,;:", b"!?", b"'\"()[]{}-", b"|", b"#*$%&<>@^~=+_/\\`", bytes(range(128, 256)))
KINDS = len(CLASSES) + 1
OTHERS = 14
WIDTH = OTHERS + KINDS + KINDS * KINDS
STEPS = 12
RIDGE = 1e-3
BINS = 400
#: A standardised measure is held to this many standard deviations.
REACH = 6.0
#: Bytes whose class pairs are counted at a time.
SLICE = 1 << 20

_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _members in enumerate(CLASSES, 1):
    _CLASS[list(_members)] = _i


def measures_of(text: str) -> np.ndarray:
    """Measures of a whole text: sizes, shares of byte classes and of pairs of neighbouring
    classes, repetition of words and lines, compressibility.  An empty text has zeros."""
    out = np.zeros(WIDTH, dtype=np.float32)
    data = text.encode()
    if not data:
        return out
    pairs = np.zeros(KINDS * KINDS, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    squeezed, packer = 0, zlib.compressobj(1)
    for at in range(0, len(raw), SLICE):  # one class of overlap joins the slices
        kinds = _CLASS[raw[at:at + SLICE + 1]].astype(np.intp)
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        squeezed += len(packer.compress(data[at:at + SLICE]))
    squeezed += len(packer.flush())
    singles = pairs.reshape(KINDS, KINDS).sum(axis=1)
    singles[_CLASS[raw[-1]]] += 1
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = len(words), len(lines)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1)
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    out[:OTHERS] = [
        1.0, np.log1p(len(data)), np.log1p(n), np.log1p(m), len(set(words)) / max(n, 1), same / max(n, 1),
        len(set(lines)) / max(m, 1), sizes.mean(), sizes.std(), np.log1p(sizes.max()), squeezed / (len(data) + 64),
        np.log1p(len(data) / max(m, 1)), sum(map(str.isupper, words)) / max(n, 1),
        sum(map(str.isalpha, words)) / max(n, 1)]
    out[OTHERS:OTHERS + KINDS] = singles / len(data)
    out[OTHERS + KINDS:] = pairs / max(len(data) - 1, 1)
    return out


def measure_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every whole text (null: empty).  No other column is read."""
    def run(batches):
        for b in batches:
            x = [measures_of(t) for t in b.column("text").to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0, dtype=np.float32)
            stops = np.arange(len(x) + 1, dtype=np.int32) * WIDTH
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))],
                                  names=["doc_id", "x"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<float>")


def _summed(df: DataFrame, task, width: int) -> np.ndarray:
    """Sum over all tasks of the vector ``task(record batches)``: tasks send one row each, which
    are added up in two levels."""
    def run(batches):
        yield pa.record_batch([pa.array([task(batches)], pa.list_(pa.float64()))], names=["v"])

    rows = df.mapInArrow(run, "v array<double>").select(
        F.pmod(F.spark_partition_id(), F.lit(32)).alias("g"), array_to_vector("v").alias("v"))
    level = rows.groupBy("g").agg(Summarizer.sum(F.col("v")).alias("v"))
    total = level.agg(Summarizer.sum(F.col("v")).alias("v")).select(vector_to_array("v").alias("v")).first()["v"]
    return np.array(total) if total is not None and len(total) else np.zeros(width)


def _x(b) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)


def scales(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (1 where constant) of every measure over all rows."""
    def task(batches):
        total = np.zeros(1 + 2 * WIDTH)
        for b in batches:
            x = _x(b)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return total

    t = _summed(measured.select("x"), task, 1 + 2 * WIDTH)
    n = max(t[0], 1.0)
    mean = t[1:1 + WIDTH] / n
    dev = np.sqrt(np.maximum(t[1 + WIDTH:] / n - mean * mean, 0.0))
    # a measure seen in next to no document says nothing and would only be scaled up
    return mean, np.where(dev > 1e-6, dev, 1e9)


def _standard(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """Standardised measures and a constant."""
    z = np.clip((x - mean) / dev, -REACH, REACH)
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, g)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * g))


def fit(rows: DataFrame, mean: np.ndarray, dev: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of the minimum of the non-negative risk over ``rows`` (x, positive): unlabelled
    rows are those with positive = false.  Newton steps, halved while the risk grows; while the
    inner term is negative, the risk is its first term and so is the step."""
    d = WIDTH + 1

    def passed(w: np.ndarray):
        def task(batches):
            head, grad = np.zeros(5), np.zeros((3, d))
            hess = np.zeros((2, d, d))
            for b in batches:
                z = _standard(_x(b), mean, dev)
                p = b.column("positive").to_numpy(zero_copy_only=False).astype(bool)
                g = z @ w
                s = _sigmoid(g)
                curve = s * (1.0 - s)
                for k, part in enumerate((p, ~p)):
                    hess[k] += (z[part] * curve[part, None]).T @ z[part]
                head += [p.sum(), (~p).sum(), _softplus(-g[p]).sum(), _softplus(g[p]).sum(), _softplus(g[~p]).sum()]
                grad += [(s[p] - 1.0) @ z[p], s[p] @ z[p], s[~p] @ z[~p]]
            return np.concatenate([head, grad.ravel(), hess.ravel()])

        t = _summed(rows.select("x", "positive"), task, 5 + 3 * d + 2 * d * d)
        n_p, n_u = max(t[0], 1.0), max(t[1], 1.0)
        grad, hess = t[5:5 + 3 * d].reshape(3, d), t[5 + 3 * d:].reshape(2, d, d)
        ridge = RIDGE * np.append(np.ones(d - 1), 0.0)
        inner = t[4] / n_u - prior * t[3] / n_p
        risk = prior * t[2] / n_p + max(inner, 0.0) + 0.5 * (ridge * w) @ w
        if inner >= 0:  # the two terms of the positives add up to a linear one
            slope = prior * (grad[0] - grad[1]) / n_p + grad[2] / n_u
            curve = hess[1] / n_u
        else:
            slope, curve = prior * grad[0] / n_p, prior * hess[0] / n_p
        slope = slope + ridge * w
        return risk, slope, np.linalg.solve(curve + np.diag(ridge + 1e-9), slope)

    w = np.zeros(d)
    risk, slope, step = passed(w)
    size = 1.0
    for _ in range(steps):
        trial = w - size * step
        new = passed(trial)
        if new[0] > risk + 1e-12:
            size /= 4
            if size < 1e-3:
                break
            continue
        gained, w, (risk, slope, step), size = risk - new[0], trial, new, min(1.0, 2 * size)
        if gained < 1e-6:
            break
    return w


def estimate_prior(rows: DataFrame, mean: np.ndarray, dev: np.ndarray, w: np.ndarray) -> float:
    """Share of positives among the unlabelled rows: the least upper bound, over thresholds of
    the score, of the unlabelled share above it to the positive share above it, each with a
    margin for chance.  ``rows``: x, positive (of positives that ``w`` has not seen)."""
    def run(batches):
        for b in batches:
            s = _sigmoid(_standard(_x(b), mean, dev) @ w)
            yield pa.record_batch([b.column("positive"), pa.array(s)], names=["positive", "s"])

    scored = rows.select("x", "positive").mapInArrow(run, "positive boolean, s double")
    cuts = np.zeros((2, BINS))
    # the score of this model is at most one half of its range by far: bins are made of its rank
    edges = scored.where("positive").agg(F.percentile_approx(
        "s", F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)]), 10_000).alias("e")).first()["e"]
    if not edges:
        return 0.5
    edges = np.unique(np.array(edges))
    code = F.lit(0)
    at = F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), code, lambda n, e: n + F.when(F.col("s") >= e, 1).otherwise(0))
    for r in scored.groupBy("positive", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        cuts[int(r["positive"]), r["bin"]] = r["n"]
    n_u, n_p = cuts.sum(axis=1)
    if not n_u or not n_p:
        return 0.5
    above = cuts[:, ::-1].cumsum(axis=1)[:, ::-1]
    share_u, share_p = above[0] / n_u, above[1] / n_p
    margin = np.sqrt(np.log(4.0 * BINS) / (2 * n_u)) + np.sqrt(np.log(4.0 * BINS) / (2 * n_p))
    ok = share_p > 0.05
    bound = (share_u[ok] + margin) / share_p[ok]
    pick = int(np.argmin(bound))
    return float(np.clip(share_u[ok][pick] / share_p[ok][pick], 0.01, 0.99))


def held_out(doc_id) -> "F.Column":
    """Whether labels of a row may not be learnt from: crc32(doc_id as text) mod 3 is 1 (a null
    doc_id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(measured: DataFrame, labels: DataFrame):
    """(mean, dev, weights, prior) from measured documents (doc_id, x) and labels.

    Trusted positives: doc_ids outside the held-out third all of whose labels are 1.  Unlabelled:
    the other documents outside that third, whatever their label.  Without either, None.
    """
    trusted = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()) \
        .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    side = measured.where(~held_out("doc_id"))
    known = written(side.join(trusted.withColumn("positive", F.lit(True)), "doc_id", "left").select(
        "doc_id", "x", F.coalesce("positive", F.lit(False)).alias("positive")), "quality-rows")
    n = {r["positive"]: r["n"] for r in known.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    mean, dev = scales(measured)
    # every document outside the third belongs to the mixture; half of the positives, as many
    # as stand for the others there, is kept from the first model
    half = F.col("positive") & (F.xxhash64("doc_id", F.lit("prior")) % 2 == 0)
    mixture = known.select("x", F.lit(False).alias("positive"))
    first = fit(known.where(F.col("positive") & ~half).select("x", "positive").unionByName(mixture), mean, dev, 0.5, 6)
    prior = estimate_prior(known.where(half).select("x", "positive").unionByName(mixture), mean, dev, first)
    weights = fit(known.where("positive").select("x", "positive").unionByName(mixture), mean, dev, prior)
    return mean, dev, weights, prior


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every whole
    text of ``docs``.

    Scores depend on the text alone: equal texts score alike, null and empty ones like a text
    without anything.  Without trusted positives or unlabelled rows every score is 0.5.  Repeated
    rows stay, an empty table stays empty, other columns are ignored.
    """
    missing(docs, "doc_id", "text")
    missing(labels, "doc_id", "quality")
    measured = written(measure_documents(docs), "quality-measures")
    model = learn(measured, labels)

    def run(batches):
        for b in batches:
            s = np.full(b.num_rows, 0.5) if model is None else _sigmoid(
                _standard(_x(b), model[0], model[1]) @ model[2])
            yield pa.record_batch([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = measured.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
