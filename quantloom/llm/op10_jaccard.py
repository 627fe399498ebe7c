"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric; documents link when it is at most ``r = 1 - percent / 100``.  Equal sets are one point.

0. *The empty set as pivot.*  Sizes of linked sets differ by the ratio at most, so regions are cut into classes of size, each with its neighbour.
1. *Singleton pivots.*  Every shingle is a pivot; a point belongs to the regions of the pivots that could be the nearest one, in a
   common order of pivots, of any point within ``r``: the first n - ceil(percent * n / 100) + 1 shingles of its own set.  Points on a boundary
   thus lie in many regions and two linked points share at least one.  With n / EXTRA further shingles two linked points share more than n / EXTRA
   regions, so a point with fewer populated regions has no partner and leaves, again and again while regions shrink.  The order puts rare pivots first; frequencies come from a
   count sketch of all shingles, and any order gives the same result.
2. *Point pivots.*  Inside a region points become pivots in turn; the distance of a member to them is computed exactly.  Members
   within ``r`` join the pivot's component; two members whose distances to one pivot differ by more than ``r`` cannot link (triangle
   inequality), nor can two that share nothing before the region's shingle if it comes too late in their orders.  A region is done when it holds one component.  Else further pivots come from outside its largest component: all of these
   points where that makes at most ``LEAF`` pairs, or ``WIDE_PIVOTS`` a round; then it goes on without them.  No link between different
   components is lost.

Words are as the contract has them.  A null text and one without words have 0 shingles and stand alone; so does an empty set. Repeated rows and
copies share one point.  An empty table gives no rows.  Further columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import STEP, Words, column, documents, lists, mix, raw, saved, signed, slices
from quantloom.llm.graph import components

K = 5
PERCENT = 80
SKETCH_BITS = 20
SKETCH_PARTS = 64
FAN_IN = 64
LEAF = 2048
WIDE_PIVOTS = 64
CHEAP_ROUNDS = 2
EXTRA = 10


def shingle_sets(buf: np.ndarray, offsets: np.ndarray):
    """Per text the sorted distinct shingle hashes, one array with offsets."""
    words = Words(buf, offsets)
    hashes, doc = words.shingles(K)
    rows = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(rows + 1))
    length = np.diff(words.offsets)
    out, size = [], np.zeros(rows, np.int64)
    for i in range(rows):
        if at[i + 1] > at[i]:
            h = np.sort(hashes[at[i]:at[i + 1]])
            h = h[np.append(True, h[1:] != h[:-1])]
        elif length[i]:
            h = np.zeros(1, np.uint64)
            for w in words.hash[words.offsets[i]:words.offsets[i + 1]]:
                h = h * STEP + w
            h = mix(h + np.uint64(length[i]))
        else:
            continue
        out.append(h)
        size[i] = len(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.append(0, np.cumsum(size))


def parts(batches):
    for batch in batches:
        buf, offsets = raw(column(batch, "text"))
        for a, b in slices(offsets):
            yield batch, a, b, *shingle_sets(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def set_ids(hashes: np.ndarray, at: np.ndarray, seed: int) -> list[np.ndarray]:
    """Two order-free 64-bit names per set; empty sets give 0."""
    out = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ mix(np.array([salt], np.uint64))), dtype=np.uint64))
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out


def named(seed: int):
    """Size and names of each text's set, and behind a task's texts the shingle occurrences by hash bucket in ``SKETCH_PARTS`` rows."""
    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, np.int64)
        kind = pa.int64()
        for batch, a, b, hashes, at in parts(batches):
            n = np.diff(at)
            x, y = set_ids(hashes, at, seed)
            kind = batch.column(0).type
            total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
            columns = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(x.view(np.int64), mask=n == 0), pa.array(y.view(np.int64), mask=n == 0)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.binary())], NAMED)
        rows = [pa.array(range(SKETCH_PARTS), pa.int64()), pa.array([TaskContext.get().partitionId()] * SKETCH_PARTS, pa.int64()), pa.array([x.tobytes() for x in np.split(total, SKETCH_PARTS)], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_PARTS, kind), *[pa.nulls(SKETCH_PARTS, pa.int64())] * 3, *rows], NAMED)
    return run


NAMED = ["doc_id", "n", "h", "h2", "part", "task", "counts"]


def added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
    return pa.table([table["part"][:1], pa.array([table["task"][0].as_py() // FAN_IN], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "task", "counts"])


def sketch(table: DataFrame) -> np.ndarray:
    """Shingle occurrences of all texts by hash bucket, from the tasks' tables (part, task, counts), added up in groups of at most ``FAN_IN``."""
    kind = "part long, task long, counts binary"
    while table.agg(F.max("task")).first()[0]:
        table = saved(table.groupBy("part", F.floor(F.col("task") / FAN_IN)).applyInArrow(added, kind))
    found = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in table.collect()}  # 8 bytes a bucket
    return np.concatenate([found[k] for k in range(SKETCH_PARTS)]) if found else np.zeros(1 << SKETCH_BITS, np.int64)


def hotness(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts / max(1.0, float(counts.mean())) + 1).astype(np.uint64)


def regions(heat, percent: int, seed: int):
    def run(batches):
        hot = heat.value
        for _, _, _, hashes, at in parts(batches):
            rank = (hot[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(58)) | (mix(hashes) >> np.uint64(6))
            own, _ = set_ids(hashes, at, seed)
            keys, places, size = [], [], np.zeros(len(own), np.int64)
            for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                n = int(hi - lo)
                if n:
                    p = n - -(-percent * n // 100) + 1 + n // EXTRA
                    keys.append(np.sort(np.partition(rank[lo:hi], p - 1)[:p]))
                    places.append(np.arange(p))
                    size[i] = p
            if keys:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), signed(np.repeat(own, size)), pa.array(np.concatenate(places))], ["pivot", "h", "at"])
    return run


def full_sets(seed: int):
    def run(batches):
        for _, _, _, hashes, at in parts(batches):
            own, _ = set_ids(hashes, at, seed)
            yield pa.RecordBatch.from_arrays([signed(own), lists(hashes.view(np.int64), at, pa.int64())], ["h", "items"])
    return run


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared and joint: sizes of intersection and union."""
    left, right = sets.select(F.col("h").alias("a"), F.col("items").alias("left")), sets.select(F.col("h").alias("b"), F.col("items").alias("right"))
    both = pairs.join(right, "b").join(left, "a").withColumn("shared", F.size(F.array_intersect("left", "right")))
    return both.select("a", "b", "shared", (F.size("left") + F.size("right") - F.col("shared")).alias("joint"))


def linked(members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, root) over the points of ``members`` (pivot, h, n, at): regions of step 1 joined by step 2."""
    r = 1 - percent / 100
    roots = saved(members.select(F.col("h").alias("node")).distinct().withColumn("root", F.col("node")))

    def known(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(col), F.col("root").alias(name)), col)

    def test(pairs: DataFrame) -> DataFrame:
        """Distances of pairs in different components whose sizes allow a link."""
        n = sizes.select("h", "n")
        pairs = known(known(pairs.select("a", "b").where("a <> b").distinct(), "a", "ra"), "b", "rb").where("ra <> rb")
        pairs = pairs.join(n.select(F.col("h").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("h").alias("b"), F.col("n").alias("nb")), "b")
        pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
        return saved(distances(pairs, sets))

    def merge(tested: DataFrame) -> DataFrame:
        links = tested.where(F.col("shared") * 100 >= F.col("joint") * percent)
        ends = known(known(links, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        step = components(ends).select(F.col("node").alias("root"), F.col("root").alias("to"))
        return saved(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))

    # one pivot a region, a point to which the region's shingle is nearest; a point first meets the pivot it shares most regions with
    first = saved(members.groupBy("pivot").agg(F.min(F.struct((F.col("at") / F.col("n")).alias("share"), "h", "n", "at")).alias("p")).select("pivot", F.col("p.h").alias("b"), F.col("p.n").alias("bn"), F.col("p.at").alias("bat")))
    for k in range(CHEAP_ROUNDS):
        pivots = members.groupBy("pivot").agg(F.min(F.struct(F.xxhash64("h", F.lit(k)).alias("x"), "h", "n", "at")).alias("p")).select("pivot", F.col("p.h").alias("b"), F.col("p.n").alias("bn"), F.col("p.at").alias("bat")) if k else first
        met = known(known(members.join(pivots, "pivot").where((F.col("h") != F.col("b")) & reach("n", "at", "bn", "bat", percent)), "h", "r1"), "b", "r2").where("r1 <> r2").groupBy(F.col("h").alias("a"), "b").count()
        roots = merge(test(met.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))))
    others = test(members.join(first, "pivot").where(reach("n", "at", "bn", "bat", percent)).select(F.col("h").alias("a"), "b"))
    roots = merge(others)
    seen = saved(others.select(F.col("a").alias("h"), "b", (1 - F.col("shared") / F.col("joint")).alias("d")).distinct())
    left = saved(members.join(first.select("pivot", "b"), "pivot").where("h <> b").join(seen, ["h", "b"], "left"))  # the first pivot is done
    while True:
        here = known(left, "h", "root")
        by_root = here.groupBy("pivot", "root").count()
        mixed = by_root.groupBy("pivot").agg(F.count("*").alias("kinds"), F.sum("count").alias("k"), F.max("count").alias("most"), F.max_by("root", F.struct("count", "root")).alias("main")).where("kinds > 1")
        here = saved(here.join(saved(mixed.select("pivot", "main", (F.col("k") * (F.col("k") - F.col("most"))).alias("pairs"))), "pivot"))
        if here.isEmpty():
            return roots
        # pivots come from outside a region's largest component: all of them where that is little work, else some a round
        outside = here.where(F.col("root") != F.col("main"))
        some = outside.where(F.col("pairs") > LEAF).groupBy("pivot", F.pmod(F.xxhash64("h"), F.lit(WIDE_PIVOTS)).alias("k")).agg(F.min(F.struct("h", "root", "d", "n", "at")).alias("p"))
        some = saved(some.select("pivot", F.col("p.h").alias("g"), F.col("p.root").alias("other"), F.col("p.d").alias("e"), F.col("p.n").alias("gn"), F.col("p.at").alias("gat")))
        every = outside.where(F.col("pairs") <= LEAF).select("pivot", F.col("h").alias("g"), F.col("root").alias("other"), F.col("d").alias("e"), F.col("n").alias("gn"), F.col("at").alias("gat"))
        window = F.coalesce(F.abs(F.col("d") - F.col("e")) <= r + 1e-9, F.lit(True))
        near = here.join(every.union(some), "pivot").where((F.col("root") != F.col("other")) & window & reach("n", "at", "gn", "gat", percent))
        roots = merge(test(near.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b"))))
        left = saved(here.where(F.col("pairs") > LEAF).select("pivot", "h", "b", "d", "n", "at").join(some.select("pivot", F.col("g").alias("h")), ["pivot", "h"], "left_anti"))


def reach(n: str, at: str, m: str, bt: str, percent: int):
    """Whether two points of n and m shingles can link if a region's shingle, at places ``at`` and ``bt`` in their orders, is the first they share."""
    return (100 + percent) * F.least(F.col(n) - F.col(at), F.col(m) - F.col(bt)) >= percent * (F.col(n) + F.col(m))


def sized(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Regions (pivot, h, n, at) cut by set size: linked sets are in the same or in neighbouring classes of ratio ``percent``; points and regions
    without a pair go.  Of regions with equal members the first in the common order stays: every member has its shingle in the earliest place there."""
    many = members.groupBy("h").count().join(sizes.select("h", "n"), "h").where(F.col("count") > F.floor(F.col("n") / EXTRA)).select("h", "n")
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
    own = F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100)
    near = members.join(saved(many), "h").where(own).select("pivot", "h", "n", "at", F.explode(F.array(level, level + 1)).alias("level"))
    near = saved(near.select(F.xxhash64("pivot", "level").alias("pivot"), "h", "n", "at"))
    ends = near.groupBy("pivot").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("k"), F.sum("at").alias("place"),
                                     F.max((F.col("at") * (100 + percent) <= F.col("n") * (100 - percent)).cast("int")).alias("close"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    # no two members can link where the shingle comes late in all their orders
    fits = ((F.col("k") > 2) | (100 * F.col("least") >= percent * F.col("most"))) & (F.col("close") == 1)
    kept = saved(ends.where((F.col("lo") != F.col("hi")) & fits).groupBy("k", "x", "y").agg(F.min(F.struct("place", "pivot")).alias("p")).select("p.pivot"))
    return saved(near.join(kept, "pivot").select("pivot", "h", "n", "at"))


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    seed = 0
    while True:
        table = saved(docs.mapInArrow(named(seed), f"doc_id {kind}, n long, h long, h2 long, part long, task long, counts binary"))
        rows = table.where("part IS NULL").select("doc_id", "n", "h", "h2")
        sizes = rows.where("h IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi"))
        sizes = saved(sizes)
        if sizes.where("lo <> hi").isEmpty():
            break
        seed += 1  # two sets share the first name: name them anew
    heat = docs.sparkSession.sparkContext.broadcast(hotness(sketch(table.where("part IS NOT NULL").select("part", "task", "counts"))))
    every = docs.mapInArrow(regions(heat, percent, seed), "pivot long, h long, at long")
    several = saved(every.groupBy("pivot").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("pivot"))
    inside = saved(every.join(several, "pivot").dropDuplicates(["pivot", "h"]))
    heat.destroy()
    members = sized(inside, sizes, percent)
    points = sizes.join(members.select("h").distinct(), "h", "left_semi")
    sets = saved(docs.join(points.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(full_sets(seed), "h long, items array<long>"))
    roots = linked(members, sets, sizes, percent)
    least = saved(sizes.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h")))
    top = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named_sets = saved(least.select("h", "root").join(top, "root").select("h", "component_id"))
    return rows.join(named_sets, "h", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
