"""Text, retrieval, verdict and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import by, div
from quantloom.operators import quality as dq
from quantloom.operators import text as tx
from quantloom.plans.queries_market import event_json
from quantloom.plans.registry import query
from quantloom.plans.views import bars, exits, table, ticks
from quantloom.sources import market as mk

SPACE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("TX1 TX2 FN6", f"""WITH w AS (SELECT doc_id, string_split({SPACE}, ' ') AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) >= 80), c AS (SELECT doc_id, w, n, unnest(range(0, CAST(greatest(ceil((n - 420) / 340), 0) AS BIGINT) + 1)) AS i FROM n)
SELECT 'document:' || doc_id || ':' || i AS id, i AS chunk_index, sha256(array_to_string(w[i * 340 + 1 : i * 340 + 420], ' ')) AS sha256, CAST(len(w[i * 340 + 1 : i * 340 + 420]) AS INTEGER) AS n_words FROM c WHERE len(w[i * 340 + 1 : i * 340 + 420]) >= 80""")
def word_chunks(spark, sf):
    return tx.chunk_rows(tx.chunks(table(spark, sf, "documents"))).select("id", "chunk_index", "sha256", "n_words")


WORDS = r"regexp_extract_all(lower(text), '[a-z]+(?:[''-][a-z]+)*')"


@query("TX3 TX4 FN5", f"""WITH t AS (SELECT doc_id, text, {WORDS} AS k, len(regexp_extract_all(text, '\\b\\d[\\d,.]*\\b')) AS nums, len(regexp_extract_all(regexp_replace(text, '([.!?]+)(\\s|$)', '\\1@#@', 'g'), '[.!?]+@#@')) AS sen FROM documents)
SELECT doc_id, CAST(length(text) AS DOUBLE) AS s_char_len, CAST(len(k) AS DOUBLE) AS s_word_count, coalesce(nums / nullif(nums + len(k), 0), 0) AS s_numeric_density, coalesce(list_sum(list_transform(k, lambda w: length(w))) / nullif(len(k), 0), 0) AS s_avg_word_len,
 coalesce(len(list_filter(k, lambda w: length(w) >= 10)) / nullif(len(k), 0), 0) AS s_pct_long_words FROM t""", "s_char_len s_word_count s_numeric_density s_avg_word_len s_pct_long_words")
def section_features(spark, sf):
    d = tx.section_features(table(spark, sf, "documents"))
    return d.select("doc_id", "s_char_len", "s_word_count", "s_numeric_density", "s_avg_word_len", "s_pct_long_words")


LEX_SQL = f"""lx AS (SELECT word, CASE WHEN length(word) % 3 = 0 THEN 'positive' WHEN length(word) % 3 = 1 THEN 'negative' ELSE 'uncertainty' END AS category FROM (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark))"""


def lexicon(spark, sf):
    """A word list derived from the benchmark texts; real lists are the caller's."""
    w = table(spark, sf, "benchmark").select(F.explode(tx.tokens("text")).alias("word")).distinct()
    n = F.length("word") % 3
    return w.withColumn("category", F.when(n == 0, "positive").when(n == 1, "negative").otherwise("uncertainty"))


@query("TX5", f"""WITH {LEX_SQL}, t AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), n AS (SELECT doc_id, greatest(len({WORDS}), 1) AS n FROM documents), h AS (SELECT doc_id, count_if(category = 'positive') AS p, count_if(category = 'negative') AS q, count_if(category = 'uncertainty') AS u FROM t JOIN lx USING (word) GROUP BY 1)
SELECT n.doc_id, coalesce(p, 0) AS positive_count, coalesce(q, 0) AS negative_count, coalesce(u, 0) AS uncertainty_count, coalesce(p, 0) / n AS positive_ratio, coalesce(q, 0) / n AS negative_ratio, coalesce(u, 0) / n AS uncertainty_ratio, (coalesce(p, 0) - coalesce(q, 0)) / n AS net_tone, coalesce((p - q) / nullif(p + q, 0), 0) AS polarity
FROM n LEFT JOIN h ON n.doc_id = h.doc_id""", "positive_ratio negative_ratio uncertainty_ratio net_tone polarity")
def lexicon_tone(spark, sf):
    return tx.tone(table(spark, sf, "documents"), lexicon(spark, sf), ["positive", "negative", "uncertainty"])


@query("TX6 TX7 TX8 ST4", f"""WITH p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev_key FROM documents), t AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), f AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY 1, 2),
x AS (SELECT p.doc_id, p.prev_key, word, tf AS a, 0 AS b FROM p JOIN f ON f.doc_id = p.doc_id WHERE prev_key IS NOT NULL UNION ALL SELECT p.doc_id, p.prev_key, word, 0, tf FROM p JOIN f ON f.doc_id = p.prev_key WHERE prev_key IS NOT NULL), w AS (SELECT doc_id, word, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1, 2),
s AS (SELECT doc_id, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, count(*) AS u, count_if(b = 0) AS n, count_if(a = 0) AS g FROM w GROUP BY 1)
SELECT p.doc_id, p.prev_key, coalesce(least(ab / nullif(sqrt(CAST(aa AS DOUBLE) * bb), 0), 1), 0) AS cosine, coalesce(n / u, 0) AS new_word_frac, coalesce(g / u, 0) AS deleted_word_frac FROM p LEFT JOIN s ON p.doc_id = s.doc_id WHERE prev_key IS NOT NULL""", "cosine new_word_frac deleted_word_frac")
def document_changes(spark, sf):
    d = table(spark, sf, "documents")
    return tx.document_changes(d, tx.previous_of(d, "source", "doc_id", "doc_id"))


BM = """tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM tk GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), nd AS (SELECT count(*) AS n, (SELECT sum(dl) FROM dl) / count(*) AS avgdl FROM documents),
df AS (SELECT word, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, nd GROUP BY word, n), mi AS (SELECT avg(raw) AS m FROM df), q AS (SELECT item_id, word, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT item_id, tf.doc_id, sum(qtf * CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (word) JOIN df USING (word) JOIN dl ON dl.doc_id = tf.doc_id, nd, mi GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


@query("TX9 RK14", f"WITH {BM} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 5", "score", digits=5)
def bm25_top(spark, sf):
    return tx.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 5)


@query("TX10 RK14", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE label = 0), s AS (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], qv) / sqrt(list_dot_product(qv, qv)) AS score FROM embeddings, q)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 3""", "score", digits=5)
def dense_top(spark, sf):
    e = table(spark, sf, "embeddings")
    # the requests: the vectors of one label
    return tx.dense_top_k(e, e.filter("label = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3)


TP = r"""qt AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'), lambda t: length(t) > 2)) AS terms FROM benchmark), tp0 AS (SELECT item_id, doc_id, length(text) AS n_chars, len(list_filter(terms, lambda t: contains(lower(text), t))) AS score FROM documents, qt),
tp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n_chars, doc_id) AS rank FROM tp0 WHERE score > 0)"""


@query("TX12", f"WITH {TP} SELECT item_id, doc_id, CAST(score AS INTEGER) AS score, CAST(n_chars AS INTEGER) AS n_chars, rank FROM tp WHERE rank <= 4")
def term_presence(spark, sf):
    return tx.term_presence(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 4)


@query("TX11 ST3", f"""WITH {BM}, {TP}, u AS (SELECT item_id, doc_id, min((src, rank)) AS pos FROM (SELECT item_id, doc_id, 0 AS src, rank FROM bm WHERE rank <= 5 UNION ALL SELECT item_id, doc_id, 1, rank FROM tp WHERE rank <= 4) GROUP BY 1, 2),
o AS (SELECT u.*, len(list_filter(string_split(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), ' '), lambda w: list_contains(string_split(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')), ' '), w))) AS overlap FROM u JOIN documents d ON u.doc_id = d.doc_id JOIN benchmark b ON u.item_id = b.item_id)
SELECT item_id, doc_id, CAST(overlap AS INTEGER) AS overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, pos) AS rank FROM o QUALIFY rank <= 3""")
def hybrid_retrieval(spark, sf):
    d, q = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return tx.hybrid(tx.bm25(d, q, 5), tx.term_presence(d, q, 4), d, q, 3)


VERDICT_SQL = """v AS (SELECT conv_id, turn, 'sig-' || lpad(CAST(conv_id * 100 + turn AS VARCHAR), 8, '0') AS signal_id, CASE (conv_id + turn) % 4 WHEN 0 THEN 'veto' WHEN 1 THEN 'maybe' ELSE 'pass' END AS decision, CAST((conv_id * 7 + turn) % 13 / 10.0 AS DOUBLE) AS confidence,
 [conv_id * 3 % 1200, turn + 2000] AS cites, (conv_id + turn) % 5 AS m FROM conversations)"""


def verdict_lines(spark, sf):
    c = table(spark, sf, "conversations")
    k, m = F.col("conv_id"), (F.col("conv_id") + F.col("turn"))
    cites = F.when(m % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((k * 3 % 1200).cast("string"), F.concat(F.lit("absent-"), (F.col("turn") + 2000).cast("string"))))  # the second citation names no document at any size
    rec = F.to_json(F.struct(F.concat(F.lit("sig-"), F.lpad((k * 100 + F.col("turn")).cast("string"), 8, "0")).alias("signal_id"), F.when(m % 4 == 0, "veto").when(m % 4 == 1, "maybe").otherwise("pass").alias("decision"), F.lit(1).alias("direction"),
                             ((k * 7 + F.col("turn")) % 13 / 10.0).alias("confidence"), F.lit(15).alias("horizon_minutes"), F.lit("trending").alias("regime_tag"), F.lit("r").alias("rationale_short"), cites.alias("cited_paper_chunk_ids"), F.array().cast("array<string>").alias("contradictions_flagged")))
    return c.select("conv_id", "turn", rec.alias("value"))


@query("TX14", f"WITH {VERDICT_SQL} SELECT conv_id, turn, decision <> 'maybe' AND confidence <= 1 AS valid, CASE WHEN decision = 'pass' AND m = 0 THEN 'insufficient_evidence' ELSE decision END AS decision FROM v")
def parsed_verdicts(spark, sf):
    return tx.parse_verdicts(verdict_lines(spark, sf)).select("conv_id", "turn", "valid", "decision")


@query("TX13 ST4", f"""WITH {VERDICT_SQL}, e AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE CAST((SELECT count(*) FROM documents d WHERE d.doc_id = cites[1]) AS BIGINT) END AS ok, CASE WHEN m = 0 THEN 0 ELSE 2 END AS n FROM v WHERE decision <> 'maybe' AND confidence <= 1)
SELECT signal_id, ok AS n_valid, n - ok AS n_invalid, CASE WHEN decision = 'pass' AND ok = 0 THEN 'insufficient_evidence' ELSE decision END AS decision FROM e""")
def resolved_citations(spark, sf):
    v = tx.parse_verdicts(verdict_lines(spark, sf)).filter("valid")
    corpus = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return tx.resolve_citations(v, corpus).select("signal_id", F.size("cited_paper_chunk_ids").cast("long").alias("n_valid"), "n_invalid", "decision")


@query("TX15", """WITH s AS (SELECT o_orderkey AS signal_id, (o_custkey % 21 - 10) / 10.0 AS confidence, o_totalprice / 100000 AS trade_size_pct, CASE o_orderkey % 5 WHEN 0 THEN 'veto' ELSE 'insufficient_evidence' END AS d1, CASE o_orderkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'veto' END AS d2 FROM orders), w AS (SELECT *, abs(confidence) < 0.6 OR d2 IS NULL AS weak FROM s),
f AS (SELECT signal_id, trade_size_pct, CASE WHEN d1 = 'veto' OR weak THEN 1 ELSE 2 END AS final_tier, CASE WHEN d1 = 'veto' THEN 'veto' WHEN weak THEN 'pass' ELSE d2 END AS final_decision FROM w) SELECT signal_id, final_tier, final_decision, final_tier = 2 AND final_decision = 'pass' AND trade_size_pct > 1 AS tier3_scheduled FROM f""")
def final_verdicts(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = o.select(k.alias("signal_id"), ((F.col("o_custkey") % 21 - 10) / 10.0).alias("confidence"), (F.col("o_totalprice") / 100000).alias("trade_size_pct"))
    t1 = o.select(k.alias("signal_id"), F.when(k % 5 == 0, "veto").otherwise("insufficient_evidence").alias("decision"))
    t2 = o.filter(k % 3 != 2).select(k.alias("signal_id"), F.when(k % 3 == 0, "pass").otherwise("veto").alias("decision"))
    return tx.final_verdict(s, t1, t2).select("signal_id", "final_tier", "final_decision", "tier3_scheduled")


@query("TX16 FN6", r"""WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || '::42') AS h, lower(text) AS x FROM documents), d AS (SELECT doc_id, 'sig-' || h[1:8] AS signal_id, CAST(CAST('0x' || h[1:8] AS BIGINT) % 3 - 1 AS INTEGER) AS direction, CAST('0x' || h[9:16] AS BIGINT) % 10001 / 10000.0 AS confidence, [1, 5, 15, 30, 60][CAST('0x' || h[17:24] AS BIGINT) % 5 + 1] AS horizon_minutes,
 ['trending', 'mean_reverting', 'high_vol', 'low_vol', 'unknown'][CAST('0x' || h[25:32] AS BIGINT) % 5 + 1] AS regime_tag, x FROM h)
SELECT CAST(doc_id AS VARCHAR) AS id, signal_id, direction, confidence, horizon_minutes, regime_tag, CASE WHEN (contains(x, 'mean reversion') AND direction = 1 AND horizon_minutes <= 5) OR (contains(x, 'trending') AND direction = 0) THEN 'veto' ELSE 'pass' END AS decision FROM d""", "confidence")
def chunk_labels(spark, sf):
    return tx.label_chunks(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


@query("TX16", """SELECT CAST(d.doc_id AS VARCHAR) AS id, sha256('{"messages":[{"role":"user","content":"Rate item ' || l.doc_id || '"},{"role":"assistant","content":"' || l.quality || '"}]}') AS digest FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def chat_records(spark, sf):
    ins = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Rate item "), F.col("doc_id").cast("string")).alias("instruction"), F.col("quality").cast("string").alias("response"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("text"))
    return tx.chat_records(ins, docs).select("id", F.sha2("record", 256).alias("digest"))


@query("DQ1 WN43", """WITH @ticks, g AS (SELECT symbol, epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY symbol ORDER BY trade_id) AS g FROM ticks)
SELECT symbol, count(*) AS n, min(CASE WHEN g > 0 THEN g END) AS min_gap_us, max(g) AS max_gap_us, count_if(g >= 0) / count(g) * 100 AS monotone_pct, 0.0::DOUBLE AS duplicate_pct FROM g GROUP BY symbol""", "monotone_pct duplicate_pct", digits=4)
def tick_timestamps(spark, sf):
    return dq.tick_timestamps(ticks(spark, sf))


@query("DQ2", """WITH @ticks, m AS (SELECT *, avg(price) OVER w AS mu, stddev_samp(price) OVER w AS sd FROM ticks WINDOW w AS (PARTITION BY symbol % 5, date_trunc('minute', event_time)))
SELECT symbol % 5 AS symbol, count(*) AS n, 100.0::DOUBLE AS aggressor_pct, avg(CASE WHEN size <= 0 THEN 1.0 ELSE 0 END) * 100 AS zero_size_pct, avg(CASE WHEN price <= 0 THEN 1.0 ELSE 0 END) * 100 AS zero_price_pct, avg(CASE WHEN coalesce(sd > 0 AND abs(price - mu) > 1.2 * sd, false) THEN 1.0 ELSE 0 END) * 100 AS outlier_pct FROM m GROUP BY 1""", "aggressor_pct zero_size_pct zero_price_pct outlier_pct", digits=4)
def trade_quality(spark, sf):
    return dq.trade_quality(ticks(spark, sf).withColumn("symbol", F.col("symbol") % 5), sigma=1.2)


@query("DQ3", """SELECT CAST(user_id AS VARCHAR) AS symbol, count(*) AS n, 1.0::DOUBLE AS deep_share, 1.0::DOUBLE AS uncrossed_share, true AS all_deep, true AS all_uncrossed, 'usable' AS decision FROM events WHERE value > 0 GROUP BY 1""", "deep_share uncrossed_share")
def book_snapshots(spark, sf):
    return dq.book_snapshots(mk.parse_depth_update(event_json(spark, sf).filter("value > 0"), "depth"), min_levels=6)


@query("DQ4", """WITH @bars, @exits, p AS (SELECT s_suppkey AS symbol FROM supplier), l AS (SELECT symbol, max(date) AS d FROM bars WHERE symbol % 9 <> 0 GROUP BY 1)
SELECT p.symbol, p.symbol % 2 = 0 AS in_reference, coalesce(exit_reason IN ('merger', 'bankruptcy', 'acquired'), false) AS has_exit_action, l.d AS last_price_date, l.d IS NOT NULL AND coalesce(exit_reason IN ('merger', 'bankruptcy', 'acquired'), false) AS final_return_computable FROM p LEFT JOIN exits e ON p.symbol = e.symbol LEFT JOIN l ON p.symbol = l.symbol""")
def probe_names(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return dq.probe_names(p, p.filter("symbol % 2 = 0"), exits(spark, sf).withColumnRenamed("exit_reason", "action"), bars(spark, sf).filter("symbol % 9 <> 0"))


@query("DQ7 AG22", """SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, count_if(o_totalprice IS NULL) AS n_null, count_if(o_totalprice <= 0) AS n_nonpositive, count_if(o_totalprice < 1000 OR o_totalprice > 400000) AS n_out_of_range, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date,
 (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1)) AS n_duplicate_keys, quantile_cont(o_totalprice, 0.01) AS q01, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.99) AS q99 FROM orders""", "q01 q50 q99", digits=4)
def panel_audit(spark, sf):
    return dq.panel_audit(table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")), "o_totalprice", "o_custkey", "d", 1000, 400000)


@query("DQ6 DQ7 AG21", """WITH @bars, g AS (SELECT symbol, min(date) AS a, max(date) AS b, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, a AS first_date, b AS last_date, n AS n_dates, CAST(b - a + 1 - n AS BIGINT) AS gap_days, (SELECT max(a) FROM g) AS window_start, (SELECT min(b) FROM g) AS window_end, (SELECT count(*) FROM g) AS n_series FROM g""")
def date_gaps(spark, sf):
    g = dq.date_gaps(bars(spark, sf))
    return g.crossJoin(dq.common_window(g))  # one-row side


@query("DQ7 DQ6", """WITH @bars SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT symbol) AS n_keys, count(DISTINCT date) AS n_dates, (SELECT avg(n) FROM (SELECT count(*) AS n FROM bars GROUP BY date)) AS rows_per_day, (SELECT avg(n) FROM (SELECT count(*) AS n FROM bars GROUP BY date)) * 64 * 365 / 1e9 AS gb_per_year FROM bars GROUP BY 1""", "rows_per_day gb_per_year")
def yearly_coverage(spark, sf):
    b = bars(spark, sf)
    return dq.per_year_coverage(b).crossJoin(dq.storage_projection(b, 64))  # one-row side


@query("DQ8", """WITH @bars, t AS (SELECT DISTINCT date FROM bars), ev AS (SELECT date FROM t WHERE day(date) = 15 UNION ALL SELECT DATE '1990-01-01') SELECT count(*) AS n_events, 0::BIGINT AS n_duplicates, (SELECT count(*) FROM (SELECT year(date), count(*) AS c FROM ev GROUP BY 1 HAVING count(*) <> 12)) AS n_years_off, count_if(date NOT IN (SELECT date FROM t)) AS n_off_calendar FROM ev""")
def event_calendar(spark, sf):
    t = bars(spark, sf).select("date").distinct()
    ev = t.filter(F.dayofmonth("date") == 15).unionByName(t.agg(F.lit("1990-01-01").cast("date").alias("date")))
    return dq.event_calendar(ev, t, 12)


@query("PRJ4 PRJ6 PRJ7 PRJ8", """WITH f AS (SELECT corr(l_extendedprice, l_extendedprice * 2) AS a, corr(l_quantity, l_extendedprice * 2) AS b, corr(l_discount, l_extendedprice * 2) AS c FROM lineitem) SELECT 'leak' AS feature, a AS corr, 0::BIGINT AS nulls, true AS leaks FROM f UNION ALL SELECT 'quantity', b, 0, false FROM f UNION ALL SELECT 'discount', c, 0, false FROM f""", "corr")
def leakage_guard(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("leak"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), (F.col("l_extendedprice") * 2).alias("future_return_1"), F.col("l_shipdate").alias("date"))
    cols = dq.feature_columns(d)
    assert cols == ["leak", "quantity", "discount"] and dq.forbidden_features(["future_return_1", "vol"]) == ["future_return_1"]
    return dq.leakage_columns(d, "future_return_1", cols)


@query("PRJ7 PRJ9 PRJ20", """WITH @bars SELECT count_if(symbol % 50 = 0) AS n_late, 0::BIGINT AS n_duplicate_keys, false AS research_grade FROM bars""")
def temporal_contract(spark, sf):
    from quantloom.functions.columns import next_weekday
    b = bars(spark, sf).withColumn("execution_date", next_weekday("date")).withColumn("feature_as_of_date", F.when(F.col("symbol") % 50 == 0, F.col("execution_date")).otherwise(F.col("date")))
    v = dq.contract_violations(b, key=("date", "symbol"))
    return dq.quality_banner(v, F.lit("partial_pit_universe")).drop("banner")


@query("AG20 AG19 SRC22", """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), g AS (SELECT h AS sha256, count(*) AS copies, min(doc_id) AS keep_id, sum(n_chars) AS total FROM d JOIN documents USING (doc_id) GROUP BY 1 HAVING count(*) > 1) SELECT sha256, copies, keep_id FROM g""")
def duplicate_texts(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"))
    from quantloom.sources.tables import duplicate_files
    return duplicate_files(d).select("sha256", "copies", F.col("keep_path").alias("keep_id"))
