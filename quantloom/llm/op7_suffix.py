"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are compared through ``length`` bytes only, in most-significant-digit passes; a group with one member is settled
and leaves, so after the last pass the equal groups are exactly the repeated windows.  A pass may read any fixed part of a
window as its digit.  Read here are, in this order:

1. the window's *anchor*, its 32-byte gram with the smallest hash (leftmost on ties).  Equal windows have the same anchor at the same
   place.  Neighbouring windows share anchors, so one row stands for about 35 suffixes.
2. the whole stretch of the windows that share one anchor: two equal stretches settle all their windows at once.  Left are the first
   members of anchors with several different stretches.
3. the anchor with the 34 bytes before it, or for windows that do not reach so far back, with the 34 bytes behind it.
4. the full window.

The first member of a group by (doc_id, start) stays; the bytes of the others are removed.  Digits are 64-bit hashes.  Passes are joins and
aggregations by digit, so that adaptive execution can split a digit that many documents hold.

Nulls count as empty.  Texts under ``length`` bytes lose nothing.  Rows that repeat a doc_id, or have none, are told apart by a hash of
the text; equal rows count as one document and each gets its result.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import BASE, BYTE_CODE, STEP, column, documents, mix, powers, raw, saved, signed

LENGTH = 100
GRAM = 32
PIECE = 1 << 20


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def rolled(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position, by doubling."""
    step, width, out, done = code, 1, None, 0
    while True:
        if size & width:
            n = len(code) - size + 1
            # the parts of the binary number are laid one behind the other, smallest first
            piece = step[done:done + n]
            out = piece.copy() if out is None else out * power(width) + piece
            done += width
            if done == size:
                return out
        step = step[:-width] * power(width) + step[width:]
        width *= 2


def extreme(x: np.ndarray, size: int, pick) -> np.ndarray:
    """Minimum or maximum of the ``size`` values from each position, by doubling."""
    width = 1
    while 2 * width <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:len(x) - (size - width)], x[size - width:]) if size > width else x


def pieces(offsets: np.ndarray, length: int):
    """Byte ranges of whole texts of together about PIECE bytes; a longer text in parts that overlap by length - 1."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        while True:
            stop = min(hi, lo + PIECE + length - 1)
            yield lo, stop
            if stop == hi:
                break
            lo = stop - length + 1
        row = end


def stretches(buf: np.ndarray, bounds: np.ndarray, length: int):
    """Of the windows inside texts (``bounds``: where texts begin and end), for each stretch: anchor, hash, the hashes of the anchor with
    what stands before and behind, first window, number of windows, and how many of them reach far back."""
    n = len(buf) - length + 1
    none = *(np.zeros(0, np.uint64) for _ in range(3)), *(np.zeros(0, np.int64) for _ in range(3))
    if n <= 0:
        return none
    grams = mix(rolled(BYTE_CODE[buf], GRAM))
    span = length - GRAM + 1
    least = extreme(grams, span, np.minimum)
    valid = np.ones(n, bool)
    for b in bounds[(bounds > 0) & (bounds < len(buf))]:
        valid[max(0, b - length + 1):b] = False
    if not valid.any():
        return none
    top = np.zeros(len(grams) + span - 1, np.uint64)
    top[span - 1:span - 1 + n] = np.where(valid, least, np.uint64(0))
    anchors = np.flatnonzero(extreme(top, span, np.maximum)[:len(grams)] == grams)
    change = valid.copy()
    change[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    start = np.flatnonzero(change)
    stop = np.flatnonzero(valid & np.append((least[1:] != least[:-1]) | ~valid[1:], True))
    owner = owners(start, least, grams, anchors)
    tied = stop > owner  # the anchor's gram comes again: look at these windows one by one
    if tied.any():
        size = (stop - start + 1)[tied]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[tied], size)
        every = np.concatenate([start[~tied], inner])
        own = np.concatenate([owner[~tied], owners(inner, least, grams, anchors)])
        end = np.concatenate([stop[~tied], inner])
        order = np.argsort(every, kind="stable")
        every, own, end = every[order], own[order], end[order]
        first = np.append(True, (own[1:] != own[:-1]) | (every[1:] != end[:-1] + 1))
        start, owner = every[first], own[first]
        stop = end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[buf] * powers(np.arange(len(buf))), dtype=np.uint64))

    def span_hash(a, b):
        return mix((sums[b] - sums[a]) * powers(2 * PIECE - a))

    place = (owner - start).astype(np.uint64) * STEP + (stop - start).astype(np.uint64)
    half = (length - GRAM) // 2
    before = np.clip(np.minimum(stop, owner - half) - start + 1, 0, None)
    left = span_hash(np.maximum(owner - half, 0), owner + GRAM) >> np.uint64(32)
    right = span_hash(owner, np.minimum(owner + GRAM + half, len(buf))) >> np.uint64(32)
    return grams[owner], mix(span_hash(start, stop + length) + place), (left << np.uint64(32)) | right, start, stop - start + 1, before


def owners(p: np.ndarray, least: np.ndarray, grams: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The first anchor from each window's start on that has the window's smallest hash."""
    at = np.searchsorted(anchors, p)
    while True:
        wrong = grams[anchors[at]] != least[p]
        if not wrong.any():
            return anchors[at]
        at = at + wrong


def digits(length: int):
    def run(batches):
        for batch in batches:
            buf, offsets = raw(column(batch, "text"))
            ids = batch.column(0).to_numpy()
            for lo, hi in pieces(offsets, length):
                bounds = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, side="right")] - lo
                gram, whole, sides, start, n, before = stretches(buf[lo:hi], bounds, length)
                row = np.searchsorted(offsets, start + lo, side="right") - 1
                where = pa.array(start + lo - offsets[row])
                yield pa.RecordBatch.from_arrays([signed(gram), signed(whole), signed(sides), pa.array(ids[row]), where, pa.array((n << 8) | before)], ["gram", "whole", "sides", "doc", "at", "many"])
    return run


DIGITS = "gram long, whole long, sides long, doc long, at long, many long"


def single_windows(length: int):
    """Hashes of the windows of the listed stretches of each text."""
    def run(batches):
        for batch in batches:
            buf, offsets = raw(column(batch, "text"))
            ids, lists = batch.column(0), batch.column(2)
            waiting: list = []
            for row in range(batch.num_rows):
                spans = lists[row].values.flatten()
                start, n = (x.to_numpy() for x in spans)
                order = np.argsort(start)
                start, n = start[order], n[order]
                text = buf[offsets[row]:offsets[row + 1]]
                for lo in range(0, len(text), PIECE):
                    a, b = np.maximum(start, lo), np.minimum(start + n, lo + PIECE)
                    size = np.maximum(b - a, 0)
                    if not size.sum():
                        continue
                    p = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
                    hashes = mix(rolled(BYTE_CODE[text[lo:lo + PIECE + length - 1]], length))
                    waiting.append((hashes[p - lo], np.full(len(p), ids[row].as_py()), p))
                    if sum(len(x[2]) for x in waiting) > PIECE // 8:
                        yield flushed(waiting)
            if waiting:
                yield flushed(waiting)
    return run


def flushed(waiting: list) -> pa.RecordBatch:
    window, doc, at = (np.concatenate(x) for x in zip(*waiting))
    waiting.clear()
    return pa.RecordBatch.from_arrays([signed(window), pa.array(doc, pa.int64()), pa.array(at)], ["window", "doc", "at"])


def cut(batches):
    """What is left of each text without the given byte ranges."""
    for batch in batches:
        buf, offsets = raw(column(batch, "text"))
        ranges = batch.column(batch.schema.get_field_index("ranges"))
        rows = []
        for row in range(batch.num_rows):
            text = buf[offsets[row]:offsets[row + 1]]
            spans = 0
            if ranges[row].is_valid:
                start, end = (x.to_numpy() for x in ranges[row].values.flatten())
                order = np.argsort(start)
                start, end = start[order], np.maximum.accumulate(end[order])
                first = np.append(True, start[1:] > end[:-1])
                start, end = start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]
                spans, edge = len(start), np.append(0, end)
                kept = np.concatenate([text[a:b] for a, b in zip(edge, np.append(start, len(text)))])
            else:
                kept = text
            rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        n, gone, spans, digest = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(docs: DataFrame) -> DataFrame:
    """doc (a number in the order of documents), doc_id and text; doc is the doc_id wherever that is unique."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    order = rows.select("doc_id", "mark").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "mark").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    order = saved(docs.sparkSession.createDataFrame(order, "doc_id long, mark long, doc long")).withColumnsRenamed({"doc_id": "d", "mark": "m"})
    return saved(rows.join(order, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("doc", "doc_id", "text"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, at, end): byte ranges that start earlier elsewhere, from ``docs`` (doc, text)."""
    texts = docs.select("doc", "text")
    every = texts.where(F.octet_length("text") >= length).mapInArrow(digits(length), DIGITS)
    anchors = saved(every.groupBy("gram").count().where("count > 1").select("gram"))
    rows = saved(every.join(anchors, "gram"))
    place = F.struct("doc", "at")
    groups = saved(rows.groupBy("gram", "whole").agg(F.min(F.struct("doc", "at", "many", "sides")).alias("first")))
    later = rows.join(groups, ["gram", "whole"]).where(place > F.struct("first.doc", "first.at")).select("doc", "at", (F.col("at") + F.shiftright("many", 8) - 1 + length).alias("end"))
    later = saved(later)
    several = groups.groupBy("gram").count().where("count > 1").select("gram")
    n, before = F.shiftright("many", 8), F.col("many").bitwiseAND(255)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.shiftright("sides", 32).alias("digit"), F.col("at"), before.alias("n")),
        F.struct(F.lit(1).alias("side"), F.col("sides").bitwiseAND(0xFFFFFFFF).alias("digit"), (F.col("at") + before).alias("at"), (n - before).alias("n")))
    halves = groups.join(saved(several), "gram").select("gram", "first.*").select("gram", "doc", F.explode(sides).alias("s")).select("gram", "doc", "s.*").where("n > 0")
    halves = saved(halves)
    shared = saved(halves.groupBy("gram", "side", "digit").count().where("count > 1").drop("count"))
    spans = halves.join(shared, ["gram", "side", "digit"]).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    windows = saved(texts.join(spans, "doc").select("doc", "text", "spans").mapInArrow(single_windows(length), "window long, doc long, at long"))
    firsts = saved(windows.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("window", "first"))
    single = windows.join(firsts, "window").where(place > F.col("first")).select("doc", "at", (F.col("at") + length).alias("end"))
    return later.union(single)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows = numbered(docs)
    ranges = saved(repeats(rows.dropDuplicates(["doc"]) if "mark" in rows.columns else rows, length).groupBy("doc").agg(F.collect_list(F.struct("at", "end")).alias("ranges")))
    return rows.join(ranges, "doc", "left").select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
