"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes its set of distinct word shingles; equal sets form one class.
2. Each class is posted under its (coordinate, value) pairs.  A link of the wanted similarity
   agrees in at least ``matches`` of the coordinates (up to a chance of about 1e-5 exactly at the
   threshold, far less above).  Prefix filter: with the pairs ordered by frequency, rarest first,
   two classes that agree in ``matches`` places share a pair among the first
   ``coordinates - matches + 1``; only those are posted, so values that come from widespread
   passages hardly ever are.
3. Posting lists are merged without listing all their pairs.  Every member first meets the list's
   smallest member only, then the best-shared member outside the largest component; pairs that
   are in one component by then are skipped.  What remains are pairs between components, taken
   from the members outside a list's largest one, and only where the shingles that both share
   with any other candidate would suffice.  So every pair of a list is tested, connected already,
   or too different by an exact bound.
4. A pair counts its agreeing coordinates, and from ``matches`` on it is confirmed on the full
   shingle sets.  Confirmed links are contracted to components.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import fresh, missing, written
from kestrel.llm.components import connected_components

SHINGLE = 5
COORDINATES = 64
CHUNK_CHARS = 2_000_000
REMEMBERED_WORDS = 100_000
#: Members of a posting list compared with as many others at a time, and shingles of a product.
BLOCK, COLUMNS = 512, 2048
#: Node ids are broadcast for a join with the texts up to this many (8 bytes each), else shuffled.
BROADCAST_NODES = 1_000_000


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(
        0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE = _constants(64, 5)
_MULTIPLY, _XOR = _constants(1024, 6), _constants(1024, 7)


def matches_needed(coordinates: int, similarity: float) -> int:
    """Agreeing coordinates that a link must have: 4.2 standard deviations below the mean."""
    spread = math.sqrt(coordinates * similarity * (1 - similarity))
    return max(1, math.floor(coordinates * similarity - 4.2 * spread))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHash()


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text (A-Z lower-cased, words apart at
    space and U+0009..U+000D; fewer words than a shingle: the whole sequence; none: empty)."""
    if len(_WORDS) > REMEMBERED_WORDS:
        _WORDS.clear()
    words = [t.encode().lower().split() for t in texts]  # bytes: ASCII only, as defined
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    get = _WORDS.__getitem__
    flat = np.fromiter((h for w in words for h in map(get, w)), dtype=np.uint64, count=int(counts.sum()))
    out, at = [], 0
    with np.errstate(over="ignore"):
        n = max(0, len(flat) - shingle + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(shingle):
            rolled += flat[j:j + n] * _PLACE[j]
        rolled = _mix(rolled)
        for c in counts.tolist():
            if c >= shingle:
                out.append(np.unique(rolled[at:at + c - shingle + 1]))
            elif c:
                out.append(_mix((flat[at:at + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True)
                                + np.uint64(c)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += c
    return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """MinHash signature (int32) of each non-empty set, one row per set."""
    if not sets:
        return np.zeros((0, coordinates), dtype=np.int32)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), coordinates), dtype=np.int32)
    with np.errstate(over="ignore"):
        for c in range(coordinates):
            low = np.minimum.reduceat((flat ^ _XOR[c]) * _MULTIPLY[c], starts)
            out[:, c] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _chunks(texts: list[str]):
    """Slices of a batch of about CHUNK_CHARS code points."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_CHARS):
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def sketch_documents(docs: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, 128-bit digest of the set (hi, lo) and signature (null if empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()),
                        ("lo", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in _chunks(texts):
                sets = shingle_sets(texts[a:z], shingle)
                sig = iter(signatures([s for s in sets if len(s)], coordinates))
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.record_batch([
                    b.column("doc_id")[a:z], pa.array(map(len, sets), pa.int64()),
                    pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digest], pa.int64()),
                    pa.array([int.from_bytes(d[8:], "big", signed=True) for d in digest], pa.int64()),
                    pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int32()))],
                    schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, sig array<int>")


def _shingles_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and full shingle set of the documents whose doc_id is a node."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in _chunks(texts):
                sets = [s.view(np.int64) for s in shingle_sets(texts[a:z], shingle)]
                yield pa.record_batch([b.column("node")[a:z], pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    side = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    wanted = docs.select(F.col("doc_id").cast("long").alias("node"),
                         F.coalesce("text", F.lit("")).alias("text")).join(side, "node", "left_semi")
    return wanted.mapInArrow(run, "node long, shingles array<long>")


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(token, node) under the prefix filter.  Pairs of frequency 1 come first in every prefix and
    meet nothing, so of a class with q shared pairs the q - matches + 1 rarest are posted."""
    posts = classes.select("node", "hi", F.posexplode("sig").alias("c", "v")).select(
        "node", "hi", (F.shiftleft(F.col("c").cast("long"), 32)
                       + F.col("v").cast("long") + F.lit(1 << 31)).alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    ranked = posts.join(shared, "token").groupBy("node", "hi").agg(
        F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("t"))  # at most one per coordinate
    kept = ranked.where(F.size("t") >= matches).select(
        "node", F.explode(F.slice("t", F.lit(1), F.size("t") - F.lit(matches - 1))).alias("t"))
    return kept.select(F.col("t.token").alias("token"), "node").distinct()


def _mixed(members: DataFrame, comps: DataFrame | None, rows: int) -> DataFrame:
    """(token, node, comp) of the posting lists that still hold more than one component."""
    if comps is None:
        m = members.withColumn("comp", F.col("node"))
    else:
        m = members.join(comps, "node", "left").select(
            "token", "node", F.coalesce("component", "node").alias("comp"))
    lists = m.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    return written(m.join(lists.select("token"), "token"), "near-lists", rows)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """Every member of a list with the list's smallest member."""
    hubs = lists.groupBy("token").agg(F.min("node").alias("q"))
    return _ordered(lists.join(hubs, "token").where("node <> q").select(F.col("node").alias("p"), "q"))


def _with_shared(lists: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Append n and c to the lists: the size of a node's set and how many of its shingles occur in
    a second node of any list.  Nodes that even a partner made of all those could not reach are
    left out; so are lists that then hold one component.  Applied twice, as nodes left out may
    have been the only second ones of a shingle."""
    nodes = lists.select("node").distinct()
    each = sets.join(nodes, "node").select("node", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
    counts = each.join(shared, "s").groupBy("node").agg(F.count("*").alias("c"))
    able = counts.join(sets.select("node", F.size("shingles").alias("n")), "node").groupBy("node").agg(
        F.max("c").alias("c"), F.min("n").alias("n")).where(100 * F.col("c") >= percent * F.col("n"))
    m = lists.join(able, "node")
    mixed = m.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    return written(m.join(mixed.select("token"), "token"), "near-shared", rows)


def _main_component(lists: DataFrame) -> DataFrame:
    """(token, main): the component with most members in each list."""
    sizes = lists.groupBy("token", "comp").agg(F.count("*").alias("m"))
    return sizes.groupBy("token").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"))


def _reachable(percent: int):
    """Both sets could share all their shared shingles: an upper bound of the similarity."""
    return ((100 + percent) * F.least("c", "qc") >= percent * (F.col("n") + F.col("qn"))) \
        & (F.col("comp") != F.col("q_comp"))


def _second_hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Members with the one outside the list's largest component that shares most of its set."""
    hubs = lists.join(_main_component(lists), "token").where("comp <> main").groupBy("token").agg(
        F.max(F.struct(F.col("c") / F.col("n"), "node", "comp", "c", "n")).alias("h")).select(
        "token", F.col("h.node").alias("q"), F.col("h.comp").alias("q_comp"),
        F.col("h.c").alias("qc"), F.col("h.n").alias("qn"))
    return _ordered(lists.join(hubs, "token").where(_reachable(percent))
                    .select(F.col("node").alias("p"), "q"))


def _agreeing(x: str, y: str):
    """Number of coordinates in which two signatures agree."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e))


def _common(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, as products of
    0/1 matrices over the shingles that occur on both sides, some of them at a time."""
    out = np.zeros((len(own), len(other)), dtype=np.int64)
    both = np.intersect1d(np.unique(np.concatenate(own)), np.unique(np.concatenate(other)), assume_unique=True)
    if not len(both):
        return out

    def placed(sets):
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    (i, x), (j, y) = placed(own), placed(other)
    for low in range(0, len(both), COLUMNS):
        left, right = np.zeros((len(own), COLUMNS), np.float32), np.zeros((len(other), COLUMNS), np.float32)
        here, there = (x >= low) & (x < low + COLUMNS), (y >= low) & (y < low + COLUMNS)
        left[i[here], x[here] - low] = 1
        right[j[there], y[there] - low] = 1
        out += (left @ right.T).astype(np.int64)  # counts up to COLUMNS are exact
    return out


def _rest_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components: members outside a list's largest
    component against all members of the list, by their full sets.

    Both sides of a list are cut into blocks of about BLOCK members; a task compares two blocks
    and returns the links that join components which its other links have not joined already, so
    that it returns less rows than it has members, however many pairs are alike."""
    # of lists with the same members (equal 128 bits of summed hashes) one is enough
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    alike = lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), *sums)
    lists = lists.join(alike.groupBy("m", "s0", "s1").agg(F.min("token").alias("token")).select("token"), "token")
    main = lists.join(_main_component(lists), "token").withColumn("outside", F.col("comp") != F.col("main"))
    sizes = main.groupBy("token").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("all"),
        F.ceil(F.count_if("outside") / F.lit(BLOCK)).cast("int").alias("out"))
    rows = main.join(sizes.where("out > 0"), "token").select("token", "node", "comp", "outside", "all", "out")
    h = F.xxhash64("node")
    left = rows.select("token", "node", "comp", F.pmod(h, F.col("all")).cast("int").alias("p"),
                       F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("q"))
    right = rows.where("outside").select("token", "node", "comp", F.pmod(h, F.col("out")).cast("int").alias("q"),
                                         F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("p"))

    def compare(all_, outside):
        a, b = [], []
        all_, outside = (t.rename(columns=lambda c: c[2:]) for t in (all_, outside))
        if len(all_) and len(outside):
            own, other = ([np.asarray(s) for s in t["shingles"]] for t in (all_, outside))
            n, m = np.array([len(s) for s in own]), np.array([len(s) for s in other])
            same = _common(own, other)
            near = (100 * same >= percent * (n[:, None] + m[None, :] - same)) \
                & (all_["comp"].to_numpy()[:, None] != outside["comp"].to_numpy()[None, :])
            root: dict[int, int] = {}

            def find(x):
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            x_comp, y_comp = all_["comp"].tolist(), outside["comp"].tolist()
            x_node, y_node = all_["node"].tolist(), outside["node"].tolist()
            for i, j in zip(*np.nonzero(near)):
                x, y = find(x_comp[i]), find(y_comp[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(min(x_node[i], y_node[j]))
                    b.append(max(x_node[i], y_node[j]))
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    def grouped(side: DataFrame, prefix: str):
        """The side under column names of its own, as both come from the same lists."""
        own = side.join(sets, "node").select(*[F.col(c).alias(prefix + c) for c in (
            "token", "p", "q", "node", "comp", "shingles")])
        return own.groupBy(*[prefix + c for c in ("token", "p", "q")])

    return grouped(left, "l_").cogroup(grouped(right, "r_")).applyInPandas(compare, "a long, b long").distinct()


def _side(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.select(F.col("node").alias(key), F.col(value).alias(name))


def _agreeing_pairs(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    return pairs.join(_side(classes, "a", "sig", "sa"), "a").join(_side(classes, "b", "sig", "sb"), "b") \
        .where(_agreeing("sa", "sb") >= matches).select("a", "b").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    near, side = written(pairs, "near-pairs", rows), _side
    both = F.size(F.array_intersect("x", "y"))
    return near.join(side(sets, "a", "shingles", "x"), "a").join(side(sets, "b", "shingles", "y"), "b") \
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE,
                    coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked when 100 * common shingles >= ``percent`` * all shingles of the two;
    component_id is the smallest doc_id reachable, kept says doc_id = component_id.  A text that
    is null, empty or without words has no shingle and no link.  Rows that repeat a doc_id are
    one document (linked through whatever one of them is linked to).  Rows without doc_id are
    linked with nothing: component_id null, kept.  An empty table gives no row.
    """
    missing(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")
    matches = matches_needed(coordinates, percent / 100)
    rows = written(sketch_documents(docs, shingle, coordinates), "near-rows")
    real = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    n = rows.count()
    classes = written(real.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")),
                      "near-classes", n)
    members = written(prefix_postings(classes, matches), "near-posts", 2 * n)
    # a doc_id with several sets ties their classes together
    tied = real.join(classes.drop("sig"), ["hi", "lo"]).groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all"))
    links = written(tied.where("a < b").select("a", F.explode("all").alias("b")).where("a < b"), "near-links", n)
    m = members.count()
    lists = _mixed(members, None, m)
    nodes = written(lists.select("node").distinct(), "near-nodes", min(m, n))
    sets = written(_shingles_of(docs, nodes, shingle), "near-sets")
    confirm = partial(_confirm, sets=sets, percent=percent, rows=m)
    hubs = _agreeing_pairs(_hub_pairs(lists), classes, matches)
    links = links.unionByName(written(confirm(hubs), "near-links", m))
    comps = connected_components(links, m)
    lists = _mixed(members, comps, m)
    if lists.take(1):
        m = lists.count()
        lists = _with_shared(_with_shared(lists, sets, percent, m).drop("c", "n"), sets, percent, m)
        hubs = _agreeing_pairs(_second_hub_pairs(lists, percent), classes, matches)
        links = links.unionByName(written(confirm(hubs), "near-links", m))
        comps = connected_components(links, m)
        lists = lists.drop("comp").join(comps.withColumnRenamed("component", "comp"), "node", "left") \
            .withColumn("comp", F.coalesce("comp", "node"))
        links = links.unionByName(written(_rest_links(written(lists, "near-rest", m), sets, percent), "near-links", m))
        comps = connected_components(links, m)
    named = classes.join(comps, "node", "left").select(
        "hi", "lo", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    comp = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document stays: the smallest doc_id of each component, once
    (of rows that repeat it the one with the smallest hash); rows without doc_id stay."""
    missing(docs, "doc_id", "text")
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    w = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    at = fresh(docs, "__nth_row")
    return left.withColumn(at, F.row_number().over(w)).where(
        F.col("doc_id").isNull() | (F.col(at) == 1)).drop(at)


def drop_near_texts(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose text stays, decided by (doc_id, text): of each component of
    linked texts the one with the smallest doc_id (then the smallest hash), once.  Texts that
    share a doc_id are linked only if they are near; rows without doc_id stay."""
    missing(docs, "doc_id", "text")
    key, at = fresh(docs, "__text_key"), fresh(docs, "__nth_row")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    named = keyed.where("doc_id IS NOT NULL").select("doc_id", F.col(key).alias("key"), "text")
    comps = near_duplicates(named.select(F.col("key").alias("doc_id"), "text"), percent).select(
        F.col("doc_id").alias("key"), "component_id").distinct()
    texts = written(named.select("doc_id", "key").distinct().join(comps, "key"), "near-texts", docs.count())
    first = texts.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = texts.join(first, "component_id").where(F.col("key") != F.col("first.key")).select(F.col("key").alias(key))
    left = keyed.join(gone, key, "left_anti").select(*docs.columns, key)
    w = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    return left.withColumn(at, F.row_number().over(w)).where(
        F.col("doc_id").isNull() | (F.col(at) == 1)).select(*docs.columns)
