"""Personal data: fixed formats plus gradient-boosted selection among proposed variants.  DataFrame functions and MLlib only.

*Base* spans follow four fixed formats (email, ip, card, phone) with their validity rules and are always kept.
*Generators* of high recall propose further, overlapping spans: addresses written with (at) and (dot), IP numbers with bracketed dots, card numbers
with other separators and groups, phone numbers without the plus sign; and parts of matches that fail, as an over-long match may hold real data: runs of whole
digit groups with 12 to 19 digits and a valid checksum, prefixes of a phone number with 9 to 15 digits, and all windows of four octets in longer dotted runs.  Boosted trees see the format of the normalised value and its
context, never the marks that tell a variant from the fixed format.  They learn from matches of the fixed formats that pass (1) and fail
(0) the rules, all of them.  A threshold is calibrated on a held-out quarter:
the lowest score above which precision is at least ``PRECISION``.  Proposals above it that overlap no base span are added; of proposals that overlap
each other the one with the higher score stays, at equal scores the longer.

Spans are in code points, end exclusive.  A null text is empty and has no spans; so has an empty one.  Repeated rows get equal results.  Without matches of
both outcomes nothing is learned and base spans alone come out.  An empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import documents, saved

KINDS = ("email", "ip", "card", "phone")
TREES = 20
DEPTH = 4
PRECISION = 0.98
CONTEXT = 24
BLOCK = 256

# The fixed formats.  Possessive quantifiers and the look-behind spare repeated scans and deep recursion; they match the same spans, as the
# characters of each part exclude the sign that follows, and a start inside a run fails where the run's start has failed.
FORMATS = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", None, r"[0-9](?:[ -]?[0-9])++"),
    ("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]"),
)
GAP = r"(?: ?[._/\u2013-] ?|[ \u00a0]{1,3})"
# The last is no variant: the windows in it are.
VARIANTS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?i:at) ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?(?i:dot) ?[\])]) ?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?: ?\[ ?(?:\.|(?i:dot)) ?\] ?[0-9]{1,3}){3}(?![0-9])"),
    ("card", rf"(?<![0-9])[0-9]{{4}}{GAP}(?:[0-9]{{4}}{GAP}[0-9]{{4}}{GAP}[0-9]{{4}}(?:{GAP}[0-9]{{3}})?|[0-9]{{6}}{GAP}[0-9]{{4,5}})(?![0-9])"),
    ("phone", r"(?<![0-9+(])(?<![0-9][.-])(?:(?:00[1-9][0-9]{0,2}|1)[ .-])?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("run", r"(?<![0-9.])[0-9]++(?:\.[0-9]++){4,}+"),
)
CUES = ("mail", "tel", "phone", "call", "card", "address", "contact", "reach")


def running(steps: Column) -> Column:
    """Running sums of an array of numbers, block by block, so that long arrays stay linear."""
    def sums(values: Column, start: Column) -> Column:
        begin = F.struct(start.cast("int").alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, begin, lambda s, x: F.struct((s["sum"] + x).cast("int").alias("sum"), F.concat(s["out"], F.array((s["sum"] + x).cast("int"))).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda i: F.slice(steps, i * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: (a + x).cast("int")))
    ends = sums(totals, F.lit(0))["out"]
    inner = F.zip_with(blocks, F.zip_with(ends, totals, lambda e, t: e - t), lambda b, o: sums(b, o)["out"])
    return F.when(F.size(steps) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


FOUND = "array<struct<value:string,before:int>>"
GROUPS = "array<struct<gap:string,value:string>>"
SPANS = "array<struct<at:int,kind:int,end:int,value:string,label:int>>"
SEEN = "array<struct<at:int,kind:int,end:int,value:string,label:int,left:string,right:string>>"
SCORED = "array<struct<at:int,kind:int,end:int,score:int>>"


def found(text: Column, regex: str, may: Column) -> Column:
    """Matches with the number of characters since the match before, left to right."""
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("value"), F.split(text, regex, -1).alias("gap"))
    listed = F.transform(F.filter(pair, lambda x: x["value"].isNotNull()), lambda x: F.struct(x["value"].alias("value"), F.length(x["gap"]).alias("before")))
    return F.when(may, listed).otherwise(F.array().cast(FOUND)).cast(FOUND)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The checksum rule for 12 to 19 digits."""
    back = F.reverse(number)
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: (a + F.when(x > 9, x - 9).otherwise(x)).cast("int"))
    return F.when(F.length(number).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def octets(value: Column) -> Column:
    part = F.transform(F.split(value, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(part, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).cast("int"), F.lit(999)) <= 255))


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(value)
    if kind == "card":
        return luhn(digits(value))
    return F.length(digits(value)).between(9, 15)


def spans(found_col: Column, kind: str, labelled: bool) -> Column:
    ends = running(F.transform(found_col, lambda x: x["before"] + F.length(x["value"])))
    label = (lambda v: passes(kind, v).cast("int")) if labelled else (lambda v: F.lit(None).cast("int"))
    return F.zip_with(found_col, ends, lambda x, e: F.struct((e - F.length(x["value"])).cast("int").alias("at"), F.lit((*KINDS, "run").index(kind)).alias("kind"), e.cast("int").alias("end"), x["value"].alias("value"), label(x["value"]).alias("label"))).cast(SPANS)


def proposed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mark`` (hash of the text), ``matches`` of the fixed formats and ``variants``."""
    text = F.coalesce("text", F.lit(""))
    numbers = text.rlike("[0-9]")
    out = docs.withColumn("mark", F.xxhash64("text"))
    out = out.withColumns({f"f_{kind}": found(text, regex, F.contains(text, F.lit(sign)) if sign else numbers) for kind, sign, regex in FORMATS})
    out = out.withColumns({f"v_{kind}": found(text, regex, numbers if kind != "email" else text.rlike(r"[\[(]")) for kind, regex in VARIANTS})
    return out.withColumns({"matches": F.concat(*[spans(F.col(f"f_{k}"), k, True) for k in KINDS]), "variants": F.concat(*[spans(F.col(f"v_{k}"), k, False) for k, _ in VARIANTS])}).drop(*[f"{a}_{k}" for a in "fv" for k in (*KINDS, "run")])


def features(cand: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format of the normalised value and context; nothing that tells a variant from the fixed format."""
    value, left, right = F.col("value"), F.lower(F.col("left")), F.lower(F.col("right"))
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), r" ?[\[(] ?at ?[\])] ?", "@"), r" ?[\[(] ?(?:dot|\.) ?[\])] ?", ".")
    number = digits(value)
    cols = {f"is_{k}": (F.col("kind") == i).cast("double") for i, k in enumerate(KINDS)}
    cols |= {
        "n_digits": F.least(F.length(number), F.lit(40)).cast("double"), "n_letters": F.least(F.length(F.regexp_replace(plain, "[^a-z]", "")), F.lit(80)).cast("double"),
        "n_labels": F.least(F.size(F.split(plain, r"\.")), F.lit(12)).cast("double"), "checksum": luhn(number).cast("double"), "octets": F.when(F.col("kind") == 1, octets(plain)).otherwise(False).cast("double"),
        "lead": F.coalesce(F.substring(number, 1, 1).try_cast("double"), F.lit(-1.0)), "spread": F.size(F.array_distinct(F.split(number, ""))).cast("double"),
        "before_space": left.rlike(r"(?:^|\s)$").cast("double"), "after_space": right.rlike(r"^(?:$|\s)").cast("double"), "before_word": left.rlike(r"\p{L}$").cast("double"), "after_word": right.rlike(r"^\p{L}").cast("double"),
        "cue": left.rlike("|".join(CUES)).cast("double"),
    }
    return cand.withColumns(cols), list(cols)


def joined(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda x: F.concat(x["gap"], x["value"])), "")


def last_chars(x: Column) -> Column:
    return F.substring(x, F.greatest(F.length(x) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))


def inner(matches: DataFrame) -> DataFrame:
    """``matches`` (column ``s``) and the parts of those that fail, which have no label.

    Texts and contexts of parts are put together from neighbouring digit groups, so a long match costs no more than its groups.
    """
    value, kind = F.col("s.value"), F.col("s.kind")
    card, phone, ip = (kind == 2) & (F.col("s.label") == 0), (kind == 3) & (F.col("s.label") == 0), kind == 4
    pair = F.arrays_zip(F.split(value, "[0-9]+", -1).alias("gap"), F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)).alias("value"))
    groups = F.when((card & value.rlike("[ -]")) | phone | ip, F.filter(pair, lambda x: x["value"].isNotNull())).otherwise(F.array().cast(GROUPS)).cast(GROUPS)
    parted = matches.withColumn("parts", groups)
    parted = parted.withColumn("ends", running(F.transform("parts", lambda x: F.length(x["gap"]) + F.length(x["value"]))))
    last = F.size("parts") - 1
    near = CONTEXT // 2  # groups that hold the context at least, as each has a digit and a sign before it

    def pieces(first, whole, start, stop, number, holds):
        """Parts from digit group ``first`` (from the match's start if ``whole``) to the end of each group from ``start`` to ``stop`` whose text passes ``holds``."""
        begin = F.lit(0) if whole else F.get("ends", first) - F.length(F.get("parts", first)["value"])
        gap = F.get("parts", first)["gap"]
        from_group = F.greatest(first - near, F.lit(0))
        left = F.lit("") if whole else F.concat(joined(F.slice("parts", from_group + 1, first - from_group)), gap)
        left = last_chars(F.concat(F.when(from_group == 0, F.col("s.left")).otherwise(F.lit("")), left))

        def text(j):
            run = joined(F.slice("parts", first + 1, j - first + 1))
            return run if whole else F.substring(run, F.length(gap) + 1, F.length(run))

        def right(j):
            return F.substring(F.concat(joined(F.slice("parts", j + 2, F.least(last - j, F.lit(near)))), F.when(last - j <= near, F.col("s.right")).otherwise(F.lit(""))), 1, CONTEXT)

        each = F.transform(F.sequence(start, stop), lambda j: F.struct(j.alias("j"), text(j).alias("value")))
        return F.transform(F.filter(each, lambda x: holds(x["value"])), lambda x: F.struct(
            (F.col("s.at") + begin).cast("int").alias("at"), F.lit(number).alias("kind"), (F.col("s.at") + F.get("ends", x["j"])).cast("int").alias("end"), x["value"].alias("value"),
            F.lit(None).cast("int").alias("label"), left.alias("left"), right(x["j"]).alias("right")))

    each = F.sequence(F.lit(0), last)
    more = (F.when(last < 1, F.array().cast(SEEN))
            .when(card, F.flatten(F.transform(each, lambda i: pieces(i, False, i, F.least(i + 18, last), 2, lambda v: luhn(digits(v))))))
            .when(phone, pieces(F.lit(0), True, F.lit(0), F.least(F.lit(14), last), 3, lambda v: passes("phone", v)))
            .when(ip, F.flatten(F.transform(F.sequence(F.lit(0), last - 3), lambda i: pieces(i, False, i + 3, i + 3, 1, octets))))
            .otherwise(F.array().cast(SEEN)).cast(SEEN))
    # outer, as a plain explode would put a filter with the whole expression below, to be worked out twice
    both = parted.select("doc_id", "mark", F.explode_outer(F.concat(F.array("s").cast(SEEN), more)).alias("s"))
    return both.where("s.kind < 4")


def candidates(rows: DataFrame) -> DataFrame:
    """One row per match, part of a failing match and variant, with its context.  Contexts are cut from blocks of the text before the rows part, so no row carries the text."""
    blocks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cut = rows.select("doc_id", "mark", F.concat("matches", "variants").alias("all"), F.when(F.size("matches") + F.size("variants") > 0, blocks).alias("blocks"))

    def part(begin, n):
        i = F.floor(begin / BLOCK).cast("int")
        two = F.concat(F.coalesce(F.get("blocks", i), F.lit("")), F.coalesce(F.get("blocks", i + 1), F.lit("")))
        return F.substring(two, begin - i * BLOCK + 1, n)

    def seen(s):
        begin = F.greatest(s["at"] - CONTEXT, F.lit(0))
        return F.struct(*[s[c].alias(c) for c in ("at", "kind", "end", "value", "label")], part(begin, s["at"] - begin).alias("left"), part(s["end"], F.lit(CONTEXT)).alias("right"))

    one = cut.select("doc_id", "mark", F.explode_outer(F.transform("all", seen).cast(SEEN)).alias("s")).where("s IS NOT NULL")
    return inner(one).select("doc_id", "mark", "s.*")


def selected(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> DataFrame | None:
    """(doc_id, mark, extra): proposals with scores that the trees select, or None where there is nothing to learn from or to select."""
    cand = saved(candidates(rows))
    share = {r["label"]: r["count"] for r in cand.groupBy("label").count().collect()}
    if not share.get(0) or not share.get(1) or not share.get(None):
        return None
    data, names = features(cand)
    draw = F.pmod(F.xxhash64("doc_id", "at", "kind", "value"), F.lit(1 << 20)) / float(1 << 20)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    learn = data.where("label IS NOT NULL").withColumn("draw", draw)
    learn = saved(learn.select("features", F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64("draw"), F.lit(4)) == 0).alias("held")))
    sides = {(r["held"], r["label"]) for r in learn.groupBy("held", "label").count().collect()}
    if len(sides) < 4:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(learn.where("NOT held"))
    score = F.floor(vector_to_array("probability")[1] * 1000)
    bins = model.transform(learn.where("held")).groupBy(score.alias("bin")).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()
    hits = n = 0.0
    least = None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        hits, n = hits + r["hits"], n + r["n"]
        if hits >= precision * n:
            least = r["bin"]
    if least is None:
        return None
    chosen = model.transform(data.where("label IS NULL")).where(score >= least)
    return chosen.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "kind", "end", score.cast("int").alias("score"))).alias("extra"))


def best(scored: Column) -> Column:
    """Of sorted spans that overlap the one before, the better of the two; no two of the result overlap."""
    begin = F.struct(F.array().cast(SCORED).alias("out"), F.lit(None).cast(SCORED[len("array<"):-1]).alias("last"))

    def step(s, x):
        last = s["last"]
        apart = F.struct(F.concat(s["out"], F.filter(F.array(last), lambda l: l.isNotNull())).alias("out"), x.alias("last"))
        better = (x["score"] > last["score"]) | ((x["score"] == last["score"]) & (x["end"] - x["at"] > last["end"] - last["at"]))
        return F.when(last.isNull() | (last["end"] <= x["at"]), apart).when(better, F.struct(s["out"].alias("out"), x.alias("last"))).otherwise(s)

    done = F.aggregate(scored, begin, step, lambda s: F.concat(s["out"], F.filter(F.array(s["last"]), lambda l: l.isNotNull())))
    return F.transform(done, lambda x: F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["end"].alias("end")))


def detect(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (at, kind, end), by start, then kind."""
    rows = proposed(docs)
    base = F.sort_array(F.transform(F.filter("matches", lambda x: x["label"] == 1), lambda x: F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["end"].alias("end"))))
    extra = selected(rows, **kw)
    rows = rows.withColumn("base", base)
    if extra is None:
        return rows.withColumn("spans", F.col("base")).drop("matches", "variants", "mark")
    extra = saved(extra).withColumnsRenamed({"doc_id": "x_doc", "mark": "x_mark"})
    rows = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("x_doc")) & (F.col("mark") == F.col("x_mark")), "left")
    free = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["at"] < x["end"]) & (x["at"] < b["end"])))
    rows = rows.withColumn("spans", F.sort_array(F.concat("base", best(F.sort_array(F.coalesce(free, F.array().cast(SCORED)))))))
    return rows.drop("matches", "variants", "mark", "extra", "x_doc", "x_mark")


def spelled(spans_col: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["at"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with each span of its text replaced by its kind in angle brackets; n_chars follows."""
    inner = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that no name of the input clashes
    found_rows = detect(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in inner.items()]))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        fresh = F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(F.col("text"), s["at"] + 1, F.greatest(x["at"] - s["at"], F.lit(0))), F.element_at(names, x["kind"] + 1))).alias("out"))
        return F.when(x["end"] <= s["at"], s).otherwise(fresh)

    done = F.aggregate("spans", begin, step)
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(done["out"], ""), F.substring(F.col("text"), done["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    out = found_rows.withColumn("text", text)
    if "n_chars" in inner:
        out = out.withColumn(inner["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(inner.get(c, c)).alias(c) for c in docs.columns])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    rows = detect(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.filter(F.transform("base", lambda x: x["kind"]), lambda k: k == F.lit(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
