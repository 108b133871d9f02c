"""Similarity self-join of documents by n-gram sets (Jaccard), with vertically partitioned counting, and its components.

Sets. A document's set holds 62-bit hashes of its distinct word n-grams. Equal sets become one class, so copies are
never paired.

Order. All n-grams of all documents are counted: tasks send them as packed numbers, dealt by range, and each range is
counted alone. Those of FREQUENT documents or more are moved behind all others by one more bit; the numbers then are
the global n-gram order. At most MOST_FREQUENT of them, the most frequent, are shipped to the tasks (a fixed bound). The
order decides only the speed: any order gives the same result.

Candidates. Two sets of Jaccard >= t share an n-gram among the first n - ceil(t n) + 1 of each. Classes that share
such an n-gram form a block; a pair is looked at only where the places of the n-gram in both sets, if it is their first
common one, leave room for enough others. A block isn't expanded into pairs: its smallest class serves as hub and is
paired with the others, and has then done its part in the block. After links have been counted and components found,
blocks whose classes lie in one component are done. In those left, more classes serve as hubs (six times as many each
round) for classes of other components. So no link between different components is missed, and classes that are
already connected are never paired.

Counting. The global order is cut into fragments. The prefixes, its first part, are intersected first, and give an
upper bound that drops most pairs; for the rest, overlaps are counted for every fragment separately and summed a pair.

Components are found by large-star and small-star steps over tables (few links: in one task); nothing that grows with
the documents reaches the driver. Finished steps are written to the shared folder; those that nothing reads any more are deleted.

Nulls: a null or empty text has an empty set (0 n-grams), linked with nothing; its component is its own doc_id. A
row with a null doc_id takes part by its text; a component's id is the smallest doc_id that isn't null. Repeated rows
share a class. An empty table gives no rows; other columns are ignored. Texts are read whole, at any length.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lathe.llm.common import discard, materialize, short_batches, slices, table
from lathe.llm.words import Hasher, signatures

#: N-grams of so many documents are frequent; at most so many of them are known to the tasks (8 bytes each).
FREQUENT, MOST_FREQUENT = 24, 1_000_000
#: N-grams that a task packs at once, and that a range to be counted holds on average.
CHUNK, RANGE = 2_000_000, 2_000_000
FRAGMENTS = 4
#: How many more hubs serve in each block in the next round.
FASTER = 6
#: Tables of so many rows or fewer (some 16 to 40 bytes each) are broadcast, and as many links joined up in one task.
FEW = 200_000
BITS = 62


def prefix_length(n, t: int):
    return n - (t * n + 99) // 100 + 1


def firsts(n: np.ndarray, *sig: np.ndarray) -> np.ndarray:
    """Numbers of the rows with non-empty sets, equal ones once."""
    _, at = np.unique(np.stack([n, *sig]), axis=1, return_index=True)
    at.sort()
    return at[n[at] > 0]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def summarised(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n, signature a and b of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in slices(batches, "text", 2 << 20):
            flat, n = hasher.sets(b.column(2), size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (n, *signatures(flat, n)))], names=["doc_id", "key", "n", "a", "b"])

    return rows.mapInArrow(run, "doc_id long, key long, n long, a long, b long")


def frequent_grams(rows: DataFrame, size: int, total: int) -> tuple[np.ndarray, int]:
    """The frequent n-grams' leading bits in order, and how far n-grams are shifted to give them. total: the number of all n-grams."""
    cut = min(18, max(0, (total // RANGE).bit_length()))
    shift = BITS - 32 - cut

    def packed(sets: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(sets) >> shift
        ids.sort()
        ranges = ids >> 32
        starts = np.flatnonzero(np.diff(ranges, prepend=-1))
        data = ids.astype(np.uint32)
        offsets = (np.append(starts, len(ids)) * 4).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ranges[starts]), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], names=["range", "ids"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n_held, seen = Hasher(), [], 0, set()
        for b in slices(batches, "text", 2 << 20):
            flat, n = hasher.sets(b.column(0), size)
            a, c = signatures(flat, n)
            ends = np.cumsum(n)
            for i in firsts(n, a, c).tolist():
                if (sig := (int(a[i]), int(c[i]))) not in seen:
                    seen.add(sig)
                    held.append(flat[ends[i] - n[i] : ends[i]])
                    n_held += int(n[i])
            if n_held >= CHUNK:
                yield packed(held)
                held, n_held, seen = [], 0, set()
        if held:
            yield packed(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for r, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(r, []).append(np.frombuffer(ids, dtype=np.uint32))
        for r in sorted(parts):
            ids, n = np.unique(np.concatenate(parts.pop(r)), return_counts=True)
            often = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(ids[often].astype(np.int64) + (r << 32)), pa.array(n[often])], names=["id", "n"])

    counted = rows.select("text").mapInArrow(send, "range long, ids binary").repartition("range").mapInArrow(count, "id long, n long")
    most = counted.orderBy(F.desc("n"), "id").limit(MOST_FREQUENT).select("id")
    with short_batches(rows.sparkSession):
        return np.sort(most.toArrow().column("id").to_numpy()).astype(np.int64), shift


def ordered(flat: np.ndarray, lengths: np.ndarray, frequent: np.ndarray, shift: int) -> np.ndarray:
    """The sets in global order: frequent n-grams get bit 62 and come last in their set."""
    if not len(frequent) or not len(flat):
        return flat
    ids = flat >> shift
    late = frequent[np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)] == ids
    own = np.repeat(np.arange(len(lengths)), lengths)
    at = np.lexsort((late, own)) if late.any() else slice(None)
    return (flat | late.astype(np.int64) << BITS)[at]


def lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def prefixes(rows: DataFrame, size: int, t: int, frequent: np.ndarray, shift: int) -> DataFrame:
    """n, a, b, prefix of each non-empty row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in slices(batches, "text", 2 << 20):
            flat, n = hasher.sets(b.column(0), size)
            sig = signatures(flat, n)
            flat, starts, at = ordered(flat, n, frequent, shift), np.cumsum(n) - n, firsts(n, *sig)
            if not len(at):
                continue
            p = prefix_length(n[at], t)
            place = np.repeat(starts[at] - (np.cumsum(p) - p), p) + np.arange(int(p.sum()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in (n, *sig)), lists(flat[place], p)], names=["n", "a", "b", "prefix"])

    return rows.select("text").mapInArrow(run, "n long, a long, b long, prefix array<long>")


def fragments(rows: DataFrame, size: int, frequent: np.ndarray, shift: int, cuts: int = FRAGMENTS) -> DataFrame:
    """rows: node, n, a, b, text. node, n, grams: the set's parts in equal ranges of the global order, frequent ones last. Rows whose text isn't the class's (of the same doc_id) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        bounds = np.array([(1 << BITS) // (cuts - 1) * (i + 1) for i in range(cuts - 2)] + [1 << BITS], dtype=np.int64)
        for b in slices(batches, "text", 2 << 20):
            flat, n = hasher.sets(b.column(4), size)
            right = np.logical_and.reduce([b.column(k + 1).to_numpy() == x for k, x in enumerate((n, *signatures(flat, n)))]) & (n > 0)
            flat, ends, at = ordered(flat, n, frequent, shift), np.cumsum(n), np.flatnonzero(right)
            if not len(at):
                continue
            sets = [flat[ends[i] - n[i] : ends[i]] for i in at.tolist()]
            lengths = np.concatenate([np.diff(np.searchsorted(x, bounds), prepend=0, append=len(x)) for x in sets])
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(lengths) + 1, cuts).astype(np.int32)), lists(np.concatenate(sets), lengths))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n[at]), parts], names=["node", "n", "grams"])

    return rows.mapInArrow(run, "node long, n long, grams array<array<long>>")


def few(written: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """A written table (or df, what is selected from it), marked for a broadcast if its counted rows are few."""
    df = written if df is None else df
    return F.broadcast(df) if written.n_rows <= FEW else df


def only(b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of b whose v is in the pairs; so the others aren't shuffled."""
    return b.join(few(pairs, pairs.select("v")), "v", "left_semi")


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all links u, v: each node with the smallest node of its component, itself left out."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    nodes = [x for x in up if root(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame, n_links: int, most_at_once: int = FEW) -> DataFrame:
    """u, v: each node and its root (the smallest node of its component, itself left out) of undirected links u, v. Up to most_at_once links are joined up in one task, more by large-star and small-star steps."""
    if n_links <= most_at_once:
        return materialize(links.select("u", "v").coalesce(1).mapInArrow(joined_up, "u long, v long"), "edges")
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def similar(overlap, n1, n2, t: int):
    """(100 + t) overlap >= t (n1 + n2), which is 100 overlap >= t union."""
    return (100 + t) * overlap >= t * (n1 + n2)


def possible(n1: str, p1: str, n2: str, p2: str, t: int):
    """Whether sets may be similar whose first common n-gram stands at places p1 and p2 (from 0). A similar pair passes in the block of its first one."""
    rest = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
    return similar(rest, F.col(n1), F.col(n2), t)


def bounded(pairs: DataFrame, prefix: DataFrame, t: int) -> DataFrame:
    """Of pairs u, v those whose prefixes allow enough overlap."""
    a = prefix.select(F.col("node").alias("u"), F.col("n").alias("n1"), F.col("prefix").alias("p1"))
    b = prefix.select(F.col("node").alias("v"), F.col("n").alias("n2"), F.col("prefix").alias("p2"))
    both = a.join(few(pairs), "u").join(only(b, pairs), "v")
    cut = F.least(F.element_at("p1", -1), F.element_at("p2", -1))
    rest = lambda n, p: F.col(n) - F.size(F.filter(p, lambda x: x <= F.col("cut")))
    both = both.withColumn("cut", cut)
    most = F.size(F.array_intersect("p1", "p2")) + F.least(rest("n1", "p1"), rest("n2", "p2"))
    return both.where(similar(most, F.col("n1"), F.col("n2"), t)).select("u", "v")


def linked(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Of pairs u, v those that are similar: partial overlaps, counted fragment by fragment, summed. (A pair may come twice, from repeated rows.)"""
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("n1"), F.col("grams").alias("g1"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("n2"), F.col("grams").alias("g2"))
    parts = F.zip_with("g1", "g2", lambda x, y: F.size(F.array_intersect(x, y)).cast("long"))
    overlap = F.aggregate(parts, F.lit(0).cast("long"), lambda total, part: total + part)
    both = a.join(few(pairs), "u").join(only(b, pairs), "v")
    return both.where(similar(overlap, F.col("n1"), F.col("n2"), t)).select("u", "v")


def blocks_of(prefix: DataFrame) -> DataFrame:
    """x, node, n, pos, hub (n, node, pos of the smallest class) of all n-grams that two or more classes have in their prefixes.

    An n-gram that isn't frequent is in few classes, so a window may hold them; frequent ones are added up first."""
    each = prefix.select(F.posexplode("prefix").alias("pos", "x"), "node", "n")
    hub = F.min(F.struct("n", "node", "pos"))
    light, heavy = each.where(F.col("x") < 1 << BITS), each.where(F.col("x") >= 1 << BITS)
    light = light.withColumn("many", F.count(F.lit(1)).over(W.partitionBy("x"))).where("many > 1")
    light = light.withColumn("hub", hub.over(W.partitionBy("x"))).select("x", "node", "n", "pos", "hub")
    hubs = heavy.groupBy("x").agg(hub.alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    return light.union(heavy.join(hubs, "x").select("x", "node", "n", "pos", "hub"))


def unfinished(left: DataFrame, roots: DataFrame) -> DataFrame:
    """x, node, n, pos, root of blocks whose classes lie in more than one component."""
    rooted = left.select("x", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("x").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("x")
    return rooted.join(apart, "x").select("x", "node", "n", "pos", "root")


def hubs_of(left: DataFrame, many: int) -> DataFrame:
    """Up to many classes of each block, dealt by hash, the smallest of each hand."""
    hand = F.pmod(F.xxhash64("node", "x"), F.lit(many))
    best = left.groupBy("x", hand.alias("hand")).agg(F.min(F.struct("n", "node", "pos", "root")).alias("hub"))
    return best.select("x", F.col("hub.node").alias("u"), F.col("hub.n").alias("n1"), F.col("hub.pos").alias("p1"), F.col("hub.root").alias("root1"))


def further(left: DataFrame, hubs: DataFrame, tried: DataFrame, t: int) -> DataFrame:
    """Pairs of hubs with the classes of other components in their block, not tried before."""
    both = left.join(few(hubs), (hubs["x"] == left["x"]) & (F.col("root") != F.col("root1")) & possible("n1", "p1", "n", "pos", t))
    pairs = both.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
    return pairs.join(tried, ["u", "v"], "left_anti")


def texts_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, n, a, b, text: of each of nodes the text of one row (or of a few, if rows share a key). A short list is broadcast, a longer one joined."""
    wanted = materialize(nodes.join(classes, "node").select("key", "node", "n", "a", "b"), "join-wanted")
    return rows.join(few(wanted), "key").select("node", "n", "a", "b", "text")


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    spark, t = docs.sparkSession, percent
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text")
    mine = materialize(summarised(rows, size), "join-facts")
    classes = mine.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("first_doc"), F.min("key").alias("key"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")
    frequent, shift = frequent_grams(rows, size, classes.agg(F.sum("n")).first()[0] or 0)
    release(spark)

    prefix = prefixes(rows, size, t, frequent, shift).groupBy("n", "a", "b").agg(F.any_value("prefix").alias("prefix"))
    prefix = materialize(prefix.join(classes, ["n", "a", "b"]).select("node", "n", "prefix"), "join-prefixes")
    release(spark)
    left = materialize(blocks_of(prefix), "join-blocks")
    release(spark)

    left_over = left.where(F.col("node") != F.col("hub.node"))
    first = left_over.select("node", "n", "pos", F.col("hub.node").alias("u"), F.col("hub.n").alias("n1"), F.col("hub.pos").alias("p1")).where(possible("n1", "p1", "n", "pos", t))
    tried = pairs = materialize(first.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct(), "join-pairs")
    sets = edges = hubs = None
    many = 1
    while True:
        good = materialize(bounded(pairs, prefix, t), "join-bounded")
        if edges is None or good.n_rows:
            nodes = good.select(F.col("u").alias("node")).union(good.select(F.col("v").alias("node"))).distinct()
            if sets is not None:
                nodes = nodes.join(sets.select("node").distinct(), "node", "left_anti")
            more = materialize(fragments(texts_of(nodes, classes, rows), size, frequent, shift), "join-sets")
            sets = more if sets is None else sets.union(more)
            links = materialize(linked(good, sets, t), "join-links")
            if edges is None:
                edges = components(links, links.n_rows)
            elif links.n_rows:
                old, edges = edges, components(links.union(edges), links.n_rows + edges.n_rows)
                discard(old)
            discard(links)
        discard(good)
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if hubs is not None:  # a class that has served as hub of a block is paired with all others there, so it is left out from now on
            left_over = left.join(few(hubs, hubs.select("x", F.col("u").alias("node"))), ["x", "node"], "left_anti")
        old, left = left, materialize(unfinished(left_over, few(edges, roots)), "join-left")
        for done in (old, hubs) if hubs is not None else (old,):
            discard(done)
        release(spark)
        if not left.n_rows:
            break
        many *= FASTER
        hubs = materialize(hubs_of(left, many), "join-hubs")
        pairs = materialize(further(left, hubs, tried, t), "join-pairs")
        tried = tried.union(pairs)

    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    placed = materialize(placed.join(ids, "root").select("n", "a", "b", "component_id"), "join-components")
    for done in (prefix, left, edges):
        discard(done)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return mine.join(placed, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(r.v) AS component_id FROM s JOIN r ON r.u = s.doc_id GROUP BY s.doc_id, len(g)
"""
