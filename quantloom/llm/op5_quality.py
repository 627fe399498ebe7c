"""Quality rules by n-gram perplexity.

Symbols are the bytes of the text as they are, 256 of them; sign 0 stands before each text.  Texts are dealt into buckets of about
``BUCKET_BYTES`` by a hash; Spark lists each bucket's distinct symbol 4-grams with their counts and adds the buckets up, so the model grows with
the corpus and is a distributed table at every step.  The interpolated modified Kneser-Ney model (three discounts per order from counts of
counts, continuation counts below the top order) is fitted by grouping and joining the grams of each order; no context has more than ``SIGNS``
continuations.  A join gives each bucket the log-probabilities of its own grams; they meet the bucket's texts as sorted arrays that are searched for
every byte.  All texts train, so every gram is found.  A text's perplexity comes from summed
log-probabilities; per language the band is median - lower * spread to median + upper * spread of the cross-entropy, spread
being half the distance between the 25 and 75 per cent points, widened for short texts, whose mean scatters more, by
sqrt(1 + SHORT / bytes).  Outside the band a text is rejected.  Percentiles are over texts with distinct least hashes of
``SKETCH``-word shingles, so a group of copies counts once and one of near copies a few times.  The spread is at least ``LEAST_SPREAD`` bits (about three
quarters of the narrowest measured in a language of the test data); a
language with fewer than ``FEW`` distinct texts has at least the mean spread, by texts, of the languages with more.

``base_failed`` and the base counts follow their fixed definitions.  Nulls count as empty: no words, base failed, perplexity
null.  Null languages form a group of their own.  Repeated rows get equal results row by row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quantloom.llm.common import SAME, SPACE, Words, column, documents, dropped, mix, raw, saved, slices, span_hashes

ORDER = 4
SIGNS = 257
BUCKET_BYTES = 1 << 24
LOWER_SPREADS = 6.0
UPPER_SPREADS = 6.0
SHORT = 500.0
LEAST_SPREAD = 0.015
SKETCH = 8
FEW = 40
MIN_WORDS = 50
STEP_BYTES = 1 << 22


SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def grams(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Packed grams of the top order that end at bytes ``lo`` to ``hi`` of consecutive texts."""
    sign = buf[max(0, lo - ORDER + 1):hi].astype(np.int64) + 1
    sign = np.concatenate([np.zeros(ORDER - 1 - min(lo, ORDER - 1), np.int64), sign])
    n = hi - lo
    out = sign[ORDER - 1:].copy()
    near = offsets[np.searchsorted(offsets, lo - ORDER):np.searchsorted(offsets, hi)] - lo
    for j in range(1, ORDER):
        before = sign[ORDER - 1 - j:ORDER - 1 - j + n].copy()
        for t in range(j):
            at = near + t
            before[at[(at >= 0) & (at < n)]] = 0
        out += before * SIGNS ** j
    return out


def added(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gram, kind="stable")
    keys, first = np.unique(gram[order], return_index=True)
    return keys, np.add.reduceat(n[order], first) if len(keys) else n


def counted(bucket, table):
    """The distinct grams of a bucket's texts, sorted, with their counts."""
    gram, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in table.to_batches():
        buf, offsets = raw(column(batch, "text"))
        for lo in range(0, len(buf), STEP_BYTES):
            more, k = np.unique(grams(buf, offsets, lo, min(len(buf), lo + STEP_BYTES)), return_counts=True)
            gram, n = added(np.append(gram, more), np.append(n, k))
    return pa.table({"bucket": pa.array(np.full(len(gram), bucket[0].as_py()), pa.int64()), "gram": pa.array(gram), "n": pa.array(n)})


def discounts(few) -> list[float]:
    """Discounts of grams counted 0, 1, 2 and 3 or more times, from the numbers of grams counted 1 to 4 times."""
    y = few[0] / max(1, few[0] + 2 * few[1])
    return [0.0] + [min(i, max(0.0, i - (i + 1) * y * few[i] / max(1, few[i - 1]))) if few[0] and few[1] else 0.5 for i in (1, 2, 3)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(gram, logp) of every counted gram (gram, n) of the top order: log2 probability of its last sign after the others."""
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct signs seen before
        levels.insert(0, saved(levels[0].groupBy((F.col("gram") % SIGNS ** k).alias("gram")).agg(F.count("*").alias("n"))))
    rare = None
    for k, level in enumerate(levels):
        part = level.where("n <= 4").groupBy("n").agg(F.count("*").alias("grams")).select(F.lit(k).alias("k"), "n", "grams")
        rare = part if rare is None else rare.unionByName(part)
    few = {(r["k"], r["n"]): r["grams"] for r in rare.collect()}  # four numbers an order
    lower = None
    for k, level in enumerate(levels):
        _, one, two, more = discounts([few.get((k, i), 0) for i in (1, 2, 3, 4)])
        context = Window.partitionBy("context")
        d = level.select("gram", "n", F.expr(f"gram div {SIGNS}").alias("context"), F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more).alias("off"))
        d = d.withColumns({"total": F.sum("n").over(context), "kept": F.sum("off").over(context)})
        if lower is None:
            d = d.withColumn("base", F.lit(1.0 / SIGNS))
        else:
            d = d.withColumn("suffix", F.col("gram") % SIGNS ** k).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("base")), "suffix")
        lower = d.select("gram", ((F.col("n") - F.col("off") + F.col("kept") * F.col("base")) / F.col("total")).alias("p"))
    return lower.select("gram", F.log2("p").cast("float").alias("logp"))


@dataclass
class KneserNey:
    """The same model from counts in one process, for few texts: per order, from one sign up, sorted keys with probabilities, sorted contexts with back-off weights."""

    keys: list[np.ndarray]
    p: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    @classmethod
    def fit(cls, gram: np.ndarray, n: np.ndarray) -> KneserNey:
        order = np.argsort(gram)
        tables = [(gram[order], n[order])]
        for k in range(ORDER - 1, 0, -1):
            tables.append(np.unique(tables[-1][0] % SIGNS ** k, return_counts=True))
        model = cls([], [], [], [])
        for k, (keys, c) in enumerate(reversed(tables), start=1):
            off = np.array(discounts([int((c == i).sum()) for i in (1, 2, 3, 4)]))[np.minimum(c, 3)]
            context, start = np.unique(keys // SIGNS, return_index=True)
            total, kept = np.add.reduceat(c, start), np.add.reduceat(off, start)
            group = np.repeat(np.arange(len(context)), np.diff(np.append(start, len(keys))))
            base = 1.0 / SIGNS if k == 1 else model.p[-1][np.searchsorted(model.keys[-1], keys % SIGNS ** (k - 1))]
            model.keys.append(keys)
            model.p.append((c - off + kept[group] * base) / total[group])
            model.contexts.append(context)
            model.backoff.append(kept / total)
        return model

    def dense(self) -> np.ndarray:
        """Log2 probabilities of every sign after every seen context of the top order."""
        table = np.full((1, SIGNS), 1.0 / SIGNS)
        for k in range(1, ORDER + 1):
            context = self.contexts[k - 1]
            suffix = np.searchsorted(self.contexts[k - 2], context % SIGNS ** (k - 2)) if k > 1 else np.zeros(1, np.int64)
            table = table[suffix] * self.backoff[k - 1][:, None]
            table[np.searchsorted(context, self.keys[k - 1] // SIGNS), self.keys[k - 1] % SIGNS] = self.p[k - 1]
        return np.log2(table)


def repeated_words(words: Words) -> np.ndarray:
    """Words per text inside 3-word windows that its text holds at least twice."""
    rows = len(words.offsets) - 1
    n = len(words.hash) - 2
    if n <= 0:
        return np.zeros(rows, np.int64)
    doc = words.doc()
    valid = np.flatnonzero(doc[:n] == doc[2:])
    key, _ = words.shingles(3)
    key ^= mix(doc[valid].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order] = np.append(same, False) | np.append(False, same)
    covered = np.zeros(len(words.hash), bool)
    for j in range(3):
        covered[valid[twice] + j] = True
    return np.diff(np.append(0, np.cumsum(covered))[words.offsets])


def sketches(words: Words) -> np.ndarray:
    """The least hash of the ``SKETCH``-word shingles of each text, 0 where it has fewer words: equal for copies and for most near copies."""
    out = np.zeros(len(words.offsets) - 1, np.int64)
    n = len(words.hash) - SKETCH + 1
    if n > 0:
        doc = words.doc()
        valid = doc[:n][doc[:n] == doc[SKETCH - 1:]]
        if len(valid):
            row, first = np.unique(valid, return_index=True)
            out[row] = np.minimum.reduceat(mix(words.shingles(SKETCH)[0]), first).astype(np.int64)
    return out


def duplicate_lines(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    rows = len(offsets) - 1
    feed = np.flatnonzero(buf == 10)
    start = np.union1d(offsets[:-1], feed + 1)
    start = start[start < len(buf)]
    if not len(start):
        return np.zeros(rows, np.int64)
    end = np.append(start[1:], len(buf))
    end = end - (buf[end - 1] == 10)
    start, end = start[end > start], end[end > start]
    word = np.append(0, np.cumsum(~SPACE[buf]))
    has = word[end] > word[start]
    start, end = start[has], end[has]
    if not len(start):
        return np.zeros(rows, np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    key = span_hashes(buf, start, end, SAME) ^ mix(doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.append(False, key[order][1:] == key[order][:-1])
    return np.bincount(doc[order[same]], minlength=rows)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double, n_bytes long, sketch long"


def measures(kind: pa.Schema):
    def run(texts, found):
        gram, logp = (found.column(c).to_numpy() for c in ("gram", "logp"))
        order = np.argsort(gram)
        gram, logp = gram[order], logp[order]
        out = []
        for batch in texts.to_batches():
            buf, offsets = raw(column(batch, "text"))
            for a, b in slices(offsets):
                part, at = buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                words = Words(part, at, SAME)
                total = np.zeros(b - a)
                for lo in range(0, len(part), STEP_BYTES):
                    hi = min(len(part), lo + STEP_BYTES)
                    sums = np.append(0.0, np.cumsum(logp[np.searchsorted(gram, grams(part, at, lo, hi))], dtype=np.float64))
                    total += np.diff(sums[np.clip(at, lo, hi) - lo])
                size = np.diff(at)
                counts = [np.diff(np.append(0, np.cumsum(x))[at]) for x in (~SPACE[part] & ((part & 0xC0) != 0x80), SYMBOL[part])]
                bits = np.divide(-total, size, out=np.full(b - a, np.nan), where=size > 0)
                out.append(pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(a, b - a) for c in ("doc_id", "mark", "lang")), pa.array(np.diff(words.offsets)), *map(pa.array, counts), pa.array(duplicate_lines(part, at)),
                    pa.array(repeated_words(words)), pa.array(bits, from_pandas=True), pa.array(size), pa.array(sketches(words))], kind.names).cast(kind))
        return pa.Table.from_batches(out, kind)
    return run


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, lang, base counts and bits a byte under the model of all texts, one row per input row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("bucket"), "doc_id", F.xxhash64("text").alias("mark"), "lang", "text")
    held = saved(texts.select("bucket", "text").repartition(parts, "bucket").groupBy("bucket").applyInArrow(counted, "bucket long, gram long, n long"))
    model = kneser_ney(saved(held.groupBy("gram").agg(F.sum("n").alias("n"))))
    found = saved(held.select("bucket", "gram").join(model, "gram"))
    dropped(held)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, lang string, {MEASURES}"
    kind = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    grouped = [t.repartition(parts, "bucket").groupBy("bucket") for t in (texts, found)]
    out = saved(grouped[0].cogroup(grouped[1]).applyInArrow(measures(kind), schema))
    dropped(found)
    return out


def assess(docs: DataFrame, lower: float = LOWER_SPREADS, upper: float = UPPER_SPREADS, mark: bool = False) -> DataFrame:
    """Base counts, perplexity per symbol, the band of the language and the verdict, one row per input row; ``mark`` adds a hash of the text."""
    rows = measured(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    points = F.percentile_approx("bits", [0.25, 0.5, 0.75], 10_000)
    distinct = rows.where(~failed).groupBy("lang", "sketch").agg(F.min_by("bits", "mark").alias("bits"))
    bands = distinct.groupBy("lang").agg(points.alias("q"), F.count("*").alias("n")).select(F.col("lang").alias("of"), F.col("q")[1].alias("middle"), ((F.col("q")[2] - F.col("q")[0]) / 2).alias("own"), "n")
    pooled = bands.where(F.col("n") >= FEW).agg((F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("pooled"))
    bands = bands.crossJoin(F.broadcast(pooled)).select("of", "middle", F.greatest("own", F.lit(LEAST_SPREAD), F.when(F.col("n") < FEW, F.col("pooled"))).alias("spread"))
    width = F.col("spread") * F.sqrt(1 + SHORT / F.greatest("n_bytes", F.lit(1)))
    banded = rows.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left").withColumns({
        "base_failed": failed, "low": F.col("middle") - lower * width, "high": F.col("middle") + upper * width})
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return banded.select("doc_id", *(["mark"] if mark else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
                         F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "low").alias("lower_band"), F.pow(F.lit(2.0), "high").alias("upper_band"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir))
