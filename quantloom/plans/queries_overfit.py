"""Split, overfitting and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import by, div
from quantloom.operators import backtest as bt
from quantloom.operators import metrics as mt
from quantloom.operators import overfit as of
from quantloom.operators import signals as sg
from quantloom.operators import splits as sp
from quantloom.plans.queries_backtest import SA, SMOOTH, dd_sql, smooth
from quantloom.plans.queries_signals import universe_bars
from quantloom.plans.registry import query
from quantloom.plans.sqltext import norm_cdf, norm_ppf
from quantloom.plans.views import bars, table
from quantloom.session import stored

STRAT = f"{SMOOTH}, {SA}, st AS (SELECT date, CAST(symbol AS VARCHAR) AS strategy_id, net AS ret FROM sa)"


def strategy_returns(spark, sf):
    """One strategy per symbol: the daily net return of its own signal."""
    return bt.single_asset(smooth(spark, sf)).select("date", F.col("symbol").cast("string").alias("strategy_id"), F.col("net_return").alias("ret"))


def pbo_sql(blocks: int, drop_tail: bool, grp: str = "''") -> str:
    half = blocks // 2
    size = f"n // {blocks}"
    blk = f"CASE WHEN i < ({size}) * {blocks} THEN i // ({size}) END" if drop_tail else f"i * {blocks} // n"
    on = "(c.m >> CAST(b.block AS BIGINT)) & 1 = 1"
    side = lambda s: f"""SELECT c.m, b.grp, b.strategy_id, sum(b.n) AS n, sum(b.s) AS s, sum(b.q) AS q, avg(b.mu) AS mu FROM blk b JOIN cm c ON {s} GROUP BY 1, 2, 3"""
    return f"""dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM st)), db AS (SELECT date, {blk} AS block FROM dt), bs AS (SELECT block, count(*) AS size FROM db WHERE block IS NOT NULL GROUP BY block),
 blk AS (SELECT {grp} AS grp, strategy_id, bs.block, size AS n, coalesce(sum(ret), 0) AS s, coalesce(sum(ret * ret), 0) AS q, coalesce(sum(ret), 0) / size AS mu FROM st JOIN db ON st.date = db.date JOIN bs ON db.block = bs.block GROUP BY 1, 2, 3, 4), cm AS (SELECT unnest(range(0, {2 ** blocks})) AS m), cm2 AS (SELECT m FROM cm WHERE bit_count(m) = {half}),
 ins AS ({side(on).replace('JOIN cm c', 'JOIN cm2 c')}), oos AS ({side('NOT ' + on).replace('JOIN cm c', 'JOIN cm2 c')}),
 isr AS (SELECT m, grp, strategy_id, mu, coalesce(s / n / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0), 0) * sqrt(252) AS sr FROM ins), osr AS (SELECT m, grp, strategy_id, mu, coalesce(s / n / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0), 0) * sqrt(252) AS sr FROM oos)"""


@query("OS1", f"""WITH @bars, {STRAT}, {pbo_sql(8, True)}, star AS (SELECT m, arg_min(strategy_id, (-sr, strategy_id)) AS sid FROM isr GROUP BY m), k AS (SELECT o.m, count_if(o.sr < x.sr) AS less, count(*) AS n, any_value(x.sr) AS xs FROM osr o JOIN star s ON o.m = s.m JOIN osr x ON x.m = s.m AND x.strategy_id = s.sid GROUP BY o.m),
 l AS (SELECT *, ln((less + 1.0) / (n + 1.0) / (1 - (less + 1.0) / (n + 1.0))) AS lg FROM k) SELECT '' AS grp, avg(CASE WHEN lg <= 0 THEN 1.0 ELSE 0 END) AS pbo, quantile_cont(lg, 0.5) AS median_logit, avg(CASE WHEN xs < 0 THEN 1.0 ELSE 0 END) AS failure_rate, count(*) AS n_splits, max(n) AS n_strategies FROM l""", "pbo median_logit failure_rate")
def pbo_cscv(spark, sf):
    return of.pbo(strategy_returns(spark, sf), 8)


@query("OS2 OS3", f"""WITH @bars, {STRAT}, {pbo_sql(8, False)}, star AS (SELECT m, arg_min(strategy_id, (-mu, strategy_id)) AS sid FROM isr GROUP BY m), k AS (SELECT o.m, count_if(o.mu > x.mu) + count_if(o.mu = x.mu AND o.strategy_id < s.sid) AS above, count(*) AS n FROM osr o JOIN star s ON o.m = s.m JOIN osr x ON x.m = s.m AND x.strategy_id = s.sid GROUP BY o.m),
 l AS (SELECT *, 1 - above / (n - 1) AS pct FROM k), e AS (SELECT avg(CASE WHEN ln(least(greatest(pct, 1e-9), 1 - 1e-9) / (1 - least(greatest(pct, 1e-9), 1 - 1e-9))) < 0 THEN 1.0 ELSE 0 END) AS pbo, avg(pct) AS mean_percentile, count(*) AS n_splits, max(n) AS n_strategies FROM l)
 SELECT '' AS grp, *, CASE WHEN pbo < 0.1 THEN 'strong' WHEN pbo < 0.25 THEN 'acceptable_but_cautious' WHEN pbo < 0.5 THEN 'fragile' ELSE 'reject' END AS bucket FROM e""", "pbo mean_percentile")
def pbo_block_means(spark, sf):
    return of.pbo_on_means(strategy_returns(spark, sf), 8)


@query("OS4 OS5", f"""WITH @bars, {STRAT}, {pbo_sql(6, True, "CAST(CAST(strategy_id AS BIGINT) % 3 AS VARCHAR)")}, star AS (SELECT grp, m, arg_min(strategy_id, (-sr, strategy_id)) AS sid FROM isr GROUP BY 1, 2), k AS (SELECT o.grp, o.m, count_if(o.sr < x.sr) AS less, count(*) AS n, any_value(x.sr) AS xs FROM osr o JOIN star s ON o.m = s.m AND o.grp = s.grp JOIN osr x ON x.m = s.m AND x.strategy_id = s.sid GROUP BY 1, 2),
 l AS (SELECT *, ln((less + 1.0) / (n + 1.0) / (1 - (less + 1.0) / (n + 1.0))) AS lg FROM k) SELECT 'family' AS tier, grp AS member, avg(CASE WHEN lg <= 0 THEN 1.0 ELSE 0 END) AS pbo, quantile_cont(lg, 0.5) AS median_logit, avg(CASE WHEN xs < 0 THEN 1.0 ELSE 0 END) AS failure_rate, count(*) AS n_splits, max(n) AS n_strategies FROM l GROUP BY grp""", "pbo median_logit failure_rate")
def pbo_by_family(spark, sf):
    r = strategy_returns(spark, sf).withColumn("family", F.col("strategy_id").cast("long") % 3)
    assert of.partitions_for(2400) == 8
    return of.pbo_tiers(r, 6, {"all": None, "family": "family"}).filter("tier = 'family'")


MOM = """mo AS (SELECT strategy_id, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) / stddev_samp(ret) AS ds FROM st GROUP BY 1), m4 AS (SELECT mo.strategy_id, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, any_value(ds) AS ds, avg(power(ret - mean, 3)) / power(any_value(sd), 3) AS g3, avg(power(ret - mean, 4)) / power(any_value(sd), 4) AS g4 FROM st JOIN mo ON st.strategy_id = mo.strategy_id GROUP BY mo.strategy_id),
md AS (SELECT *, sqrt(greatest(1 - g3 * ds + (g4 - 1) / 4 * ds * ds, 1e-12)) AS den FROM m4)"""
E_MAX = f"((1 - 0.5772156649015329) * {norm_ppf('1 - 1.0 / k')} + 0.5772156649015329 * {norm_ppf('1 - 1.0 / (k * exp(1.0))')})"


@query("OS6 FN9", f"""WITH @bars, {STRAT}, {MOM}, pool AS (SELECT CAST(count(*) AS DOUBLE) AS k, var_samp(ds) AS v FROM m4), em AS (SELECT sqrt(v) * {E_MAX} AS e FROM pool), z AS (SELECT *, ds * sqrt(n - 1) / den AS z0, (ds - e) * sqrt(n - 1) / den AS z1 FROM md, em)
SELECT strategy_id, n, ds * sqrt(252) AS sharpe, g3 AS skew, g4 AS kurt, {norm_cdf('z0')} AS psr_zero, {norm_cdf('z1')} AS dsr, e * sqrt(252) AS expected_max_sharpe FROM z""", "sharpe skew kurt psr_zero dsr expected_max_sharpe", digits=5)
def deflated_sharpe(spark, sf):
    return of.deflated_sharpe(of.return_moments(strategy_returns(spark, sf))).select("strategy_id", "n", "sharpe", "skew", "kurt", "psr_zero", "dsr", "expected_max_sharpe")


@query("OS7 OS8", f"""WITH @bars, {STRAT}, {MOM}, e AS (SELECT {E_MAX} AS e FROM (SELECT 100.0::DOUBLE AS k)), z AS (SELECT *, (ds - greatest(e / sqrt(n - 1), 0)) * sqrt(n - 1) / den AS z FROM md, e WHERE n >= 5 AND sd > 0), bb AS (SELECT arg_max(strategy_id, (ds, strategy_id)) AS best, max(ds) * sqrt(252) AS bs, arg_max(n, (ds, strategy_id)) AS bn, count(*) AS t FROM m4),
 p AS (SELECT best, 1 - {norm_cdf('bs * sqrt(bn / 365.0)')} AS raw_p, t, bs, {norm_ppf('1 - 1.0 / greatest(t, 2)')} AS en FROM bb)
SELECT strategy_id, z AS z_score, {norm_cdf('z')} AS probability, greatest(e / sqrt(n - 1), 0) * sqrt(252) AS benchmark_annual_sharpe, best AS best_id, raw_p, least(1, raw_p * t) AS bonferroni_p, en AS expected_max_noise_z, bs - en AS deflated_sharpe_proxy FROM z, p""", "z_score probability benchmark_annual_sharpe raw_p bonferroni_p expected_max_noise_z deflated_sharpe_proxy", digits=5)
def deflated_by_count(spark, sf):
    m = of.return_moments(strategy_returns(spark, sf))
    d = of.deflated_sharpe_by_count(m, 100).select("strategy_id", "z_score", "probability", "benchmark_annual_sharpe")
    return d.crossJoin(of.multiple_testing(m).select(F.col("strategy_id").alias("best_id"), "raw_p", "bonferroni_p", "expected_max_noise_z", "deflated_sharpe_proxy"))  # one-row side


@query("OS9", f"""WITH @bars, {STRAT}, s AS (SELECT strategy_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, row_number() OVER (ORDER BY strategy_id) AS i FROM st GROUP BY 1), t AS (SELECT tier, least(tier, (SELECT count(*) FROM s)) AS k FROM (SELECT unnest([3, 10, 50]) AS tier))
SELECT tier, k AS n_trials, (SELECT max(sharpe) FROM s WHERE i <= k) AS empirical_max, (SELECT sqrt(var_samp(sharpe)) FROM s) * {E_MAX} AS theoretical_max FROM t""", "empirical_max theoretical_max", digits=5)
def expected_against_best(spark, sf):
    return of.expected_against_best(of.return_moments(strategy_returns(spark, sf)), (3, 10, 50))


@query("OS10")
def stationary_bootstrap(spark, sf):
    return of.stationary_bootstrap(strategy_returns(spark, sf))


def finished(source: str, column: str) -> str:
    """The 32-bit finaliser of the keyed draws over ``column``, a step per level so that no expression doubles."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        source = f"SELECT * REPLACE ((xor({column}, {column} >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT AS {column}) FROM ({source})"
    return f"SELECT * REPLACE (xor({column}, {column} >> 16) AS {column}) FROM ({source})"


DRAWS = "SELECT strategy_id, t, len, k, least(len, t - b * len) AS take, key, (k * nb + b)::UBIGINT AS h FROM c, (SELECT unnest(range(0, 1000)) AS k), (SELECT unnest(range(0, (SELECT max(nb) FROM c))) AS b) WHERE b < nb"
DRAWS = finished(f"SELECT * REPLACE (xor(h, key) AS h) FROM ({finished(DRAWS, 'h')})", "h")


@query("OS11", f"""WITH @bars, {STRAT}, c0 AS (SELECT strategy_id, avg(ret) AS c, count(*) AS t, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252) AS ps, greatest(1, CAST(round_even(power(count(*), 1.0 / 3.0), 0) AS BIGINT)) AS len FROM st GROUP BY 1),
 c AS (SELECT *, CAST(ceil(t / len) AS BIGINT) AS nb, ('0x' || substr(md5('17|' || strategy_id), 1, 8))::UBIGINT AS key FROM c0 WHERE t >= 5),
 p AS (SELECT st.strategy_id, row_number() OVER w AS i, sum(ret - c) OVER w AS s1, sum((ret - c) * (ret - c)) OVER w AS s2 FROM st JOIN c ON st.strategy_id = c.strategy_id WINDOW w AS (PARTITION BY st.strategy_id ORDER BY date)), p0 AS (SELECT * FROM p UNION ALL SELECT strategy_id, 0, 0.0, 0.0 FROM c),
 d AS (SELECT *, CAST(floor((h + 0.5) / 4294967296.0 * t) AS BIGINT) AS lo, CAST(floor((h + 0.5) / 4294967296.0 * t) AS BIGINT) + take AS hi FROM ({DRAWS})),
 e AS (SELECT d.strategy_id, k, d.t, sum(z.s1 - a.s1 + CASE WHEN hi > d.t THEN w.s1 ELSE 0 END) AS s1, sum(z.s2 - a.s2 + CASE WHEN hi > d.t THEN w.s2 ELSE 0 END) AS s2 FROM d JOIN p0 a ON a.strategy_id = d.strategy_id AND a.i = lo JOIN p0 z ON z.strategy_id = d.strategy_id AND z.i = CASE WHEN hi > d.t THEN hi - d.t ELSE hi END JOIN p w ON w.strategy_id = d.strategy_id AND w.i = d.t GROUP BY ALL),
 s AS (SELECT e.strategy_id, (s1 / e.t + c) / nullif(sqrt(greatest(s2 - s1 * s1 / e.t, 0) / (e.t - 1)), 0) * sqrt(252) AS sharpe FROM e JOIN c ON e.strategy_id = c.strategy_id), q AS (SELECT strategy_id, quantile_cont(coalesce(sharpe, 0), 0.025) AS l, quantile_cont(coalesce(sharpe, 0), 0.975) AS u, count(*) AS n FROM s GROUP BY 1)
SELECT c0.strategy_id, CASE WHEN n IS NULL THEN 'not_enough_observations' ELSE 'computed' END AS status, ps AS point_sharpe, coalesce(l, 0) AS ci_lower_95, coalesce(u, 0) AS ci_upper_95, coalesce(n, 0) AS resamples, t AS observations, len AS block_length FROM c0 LEFT JOIN q ON c0.strategy_id = q.strategy_id""", "point_sharpe ci_lower_95 ci_upper_95", digits=5)
def circular_bootstrap(spark, sf):
    return of.circular_bootstrap(strategy_returns(spark, sf))


@query("OS12", """WITH @bars, b AS (SELECT symbol, date, close, high / close AS h, row_number() OVER w AS i, ln(close) - ln(lag(close) OVER w) AS l FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, perm_id ORDER BY CASE WHEN i = 1 THEN '' ELSE substr(md5('42:0|' || symbol || '|' || date || '|' || perm_id), 1, 13) END, date) AS slot FROM b, (SELECT unnest(range(0, 2)) AS perm_id)),
 q AS (SELECT symbol, perm_id, slot, h, sum(coalesce(l, 0)) OVER (PARTITION BY symbol, perm_id ORDER BY slot) AS path FROM p), c AS (SELECT symbol, close AS c0 FROM b WHERE i = 1)
SELECT CAST(q.perm_id AS INTEGER) AS perm_id, q.symbol, count(*) AS n, avg(ln(c0 * exp(path))) AS mean_log_close, max(ln(c0 * exp(path) * h)) AS max_log_high FROM q JOIN c ON q.symbol = c.symbol GROUP BY 1, 2""", "mean_log_close max_log_high", digits=5)
def permuted_paths(spark, sf):
    d = of.permuted_bars(bars(spark, sf), 2)
    return d.groupBy("perm_id", "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log("close")).alias("mean_log_close"), F.max(F.log("high")).alias("max_log_high"))


@query("OS12 OS14 RK10")
def permutation_control(spark, sf):
    b = universe_bars(spark, sf)
    runs = of.permuted_bars(b, 5).unionByName(b.withColumn("perm_id", F.lit(-1)))
    # a permuted universe is one more universe: the grid runs over all of them in one plan
    d = runs.withColumn("symbol", F.concat_ws("#", F.col("symbol").cast("string"), F.col("perm_id").cast("string"))).drop("perm_id")
    s = bt.single_asset(sg.signal_table(d, ["TS_MOMENTUM", "ROC", "DONCHIAN_BREAKOUT"], [20, 60], [1.0, 2.0]), sg.SPEC)
    r = s.withColumn("perm_id", F.split("symbol", "#")[1].cast("int")).withColumn("strategy_id", sg.strategy_id(*sg.SPEC)).select("perm_id", "date", "strategy_id", F.col("net_return").alias("ret"))
    best = of.grid_sharpes(r, 0.3, 5, ["perm_id", "strategy_id"]).groupBy("perm_id").agg(F.max("is_sharpe").alias("best_sharpe"))
    return of.permutation_p_value(best)


@query("OS13")
def correlation_clusters(spark, sf):
    base = stored(strategy_returns(spark, sf))
    # near-copies of every fourth strategy make clusters that can be counted
    copies = base.filter(F.col("strategy_id").cast("long") % 4 == 0).withColumn("strategy_id", F.concat("strategy_id", F.lit("c"))).withColumn("ret", F.col("ret") * 2.0)
    r = base.unionByName(copies)
    c = of.components(r.select("strategy_id").distinct(), of.correlation_edges(r, 0.9))
    m = of.return_moments(r).select("strategy_id", "sharpe", F.lit(1.0).alias("turnover"), F.col("sharpe").alias("dsr"), (-F.col("sd")).alias("drawdown"))
    return of.representatives(c, m)


@query("OS14 OS18 PRJ12", f"""WITH @bars, {STRAT}, dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM st)), ids AS (SELECT DISTINCT strategy_id FROM st), f AS (SELECT ids.strategy_id, dt.i, floor(n * 0.7) AS cut, coalesce(ret, 0) AS ret FROM ids CROSS JOIN dt LEFT JOIN st ON st.strategy_id = ids.strategy_id AND st.date = dt.date)
SELECT strategy_id, coalesce(avg(CASE WHEN i < cut THEN ret END) / nullif(stddev_samp(CASE WHEN i < cut THEN ret END), 0), 0) * sqrt(252) AS is_sharpe, coalesce(avg(CASE WHEN i >= cut + 10 THEN ret END) / nullif(stddev_samp(CASE WHEN i >= cut + 10 THEN ret END), 0), 0) * sqrt(252) AS oos_sharpe FROM f GROUP BY 1""", "is_sharpe oos_sharpe", digits=5)
def grid_sharpes(spark, sf):
    return of.grid_sharpes(strategy_returns(spark, sf))


@query("RK11", f"""WITH @bars, {STRAT}, m AS (SELECT strategy_id, floor(avg(ret) / stddev_samp(ret) * 200) AS sharpe, floor(stddev_samp(ret) * 20000) AS risk, floor(avg(abs(ret)) * 20000) AS turnover FROM st GROUP BY 1)
SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.sharpe >= a.sharpe AND b.risk <= a.risk AND b.turnover <= a.turnover AND (b.sharpe > a.sharpe OR b.risk < a.risk OR b.turnover < a.turnover))""", "sharpe risk turnover")
def pareto_front(spark, sf):
    m = strategy_returns(spark, sf).groupBy("strategy_id").agg(F.floor(F.avg("ret") / F.stddev_samp("ret") * 200).cast("double").alias("sharpe"), F.floor(F.stddev_samp("ret") * 20000).cast("double").alias("risk"), F.floor(F.avg(F.abs("ret")) * 20000).cast("double").alias("turnover"))
    return of.pareto_front(m, "sharpe", ["risk", "turnover"])


@query("OS16 OS17 OS15", f"""WITH @bars, {STRAT}, m AS (SELECT strategy_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, sum(ret) AS total, count(*) AS n FROM st GROUP BY 1), g AS (SELECT *, list_filter([CASE WHEN sharpe > 0.5 THEN NULL ELSE 'sharpe' END, CASE WHEN total > 0 THEN NULL ELSE 'total' END, CASE WHEN n >= 100 THEN NULL ELSE 'history' END], lambda x: x IS NOT NULL) AS bl FROM m)
SELECT strategy_id, list_aggregate(bl, 'string_agg', ',') AS blockers, len(bl) = 0 AS passed FROM g""".replace("list_aggregate(bl, 'string_agg', ',')", "array_to_string(bl, ',')"))
def success_gate(spark, sf):
    m = strategy_returns(spark, sf).groupBy("strategy_id").agg(mt.sharpe("ret").alias("sharpe"), F.sum("ret").alias("total"), F.count(F.lit(1)).alias("n"))
    g = of.gate_table(m, [("sharpe", F.col("sharpe") > 0.5), ("total", F.col("total") > 0), ("history", F.col("n") >= 100)])
    return g.select("strategy_id", F.array_join("blockers", ",").alias("blockers"), "passed")


@query("OS17", f"""WITH @bars, {STRAT}, m AS (SELECT strategy_id, avg(ret) AS a FROM st GROUP BY 1) SELECT 0 AS stage_no, 'generated' AS stage, count(*) AS n FROM m UNION ALL SELECT 1, 'positive', count(*) FROM m WHERE a > 0 UNION ALL SELECT 2, 'strong', count(*) FROM m WHERE a > 1e-4""")
def selection_funnel(spark, sf):
    m = strategy_returns(spark, sf).groupBy("strategy_id").agg(F.avg("ret").alias("a"))
    return of.funnel([("generated", m), ("positive", m.filter("a > 0")), ("strong", m.filter("a > 1e-4"))])


@query("OS18", """WITH @scored, q AS (SELECT quantile_cont(CASE WHEN date < DATE '1999-01-01' THEN abs(pred) END, 0.9) AS t FROM scored) SELECT date, count(*) AS n, avg(y) AS mean_y, any_value(t) AS threshold FROM scored, q WHERE abs(pred) >= t - 1e-9 GROUP BY date""", "mean_y threshold")
def dev_threshold(spark, sf):
    from quantloom.plans.views import scored
    d = of.dev_threshold(scored(spark, sf), "pred", F.col("date") < F.lit("1999-01-01").cast("date"), 0.9)
    return d.filter(F.abs("pred") >= F.col("threshold") - 1e-9).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), F.max("threshold").alias("threshold"))


DT = "dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"


@query("PRJ12 PRJ13 PRJ14", f"""WITH @bars, {DT} SELECT date, idx >= n - greatest(CAST(round_even(n * 0.2, 0) AS BIGINT), 1) AS holdout_round, idx >= round_even(n * (1 - 0.2), 0) AS holdout_keep, idx >= n - greatest(CAST(floor(n * 0.2) AS BIGINT), 1) AS holdout_floor, CAST(least(idx // greatest(n // 5, 1), 4) AS INTEGER) AS block,
 CASE WHEN idx < floor(n * 0.6) THEN 'development' WHEN idx < floor(n * (0.6 + 0.2)) THEN 'validation' ELSE 'holdout' END AS period FROM dt""")
def holdout_splits(spark, sf):
    b = bars(spark, sf)
    d = sp.chronological_blocks(b, 5).join(sp.three_way(b, 0.6, 0.2), "date")
    for r in ("round", "keep", "floor"):
        d = d.join(sp.holdout_dates(b, 0.2, r).withColumn(f"holdout_{r}", F.lit(True)), "date", "left").withColumn(f"holdout_{r}", F.coalesce(f"holdout_{r}", F.lit(False)))
    return d


@query("CV1 JN19", """WITH o AS (SELECT DISTINCT CAST(o_orderkey % 997 AS BIGINT) AS date_id FROM orders), d AS (SELECT *, row_number() OVER (ORDER BY date_id) - 1 AS idx, count(*) OVER () AS n FROM o), f AS (SELECT d.*, fold, idx >= fold * (n // 5) AND idx < CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS t FROM d, (SELECT unnest(range(0, 5)) AS fold)),
 b AS (SELECT fold, min(date_id) AS lo, max(date_id) AS hi FROM f WHERE t GROUP BY 1) SELECT date_id, CAST(f.fold AS INTEGER) AS fold, CASE WHEN t THEN 'test' ELSE 'train' END AS role FROM f JOIN b ON f.fold = b.fold WHERE t OR date_id < lo - 5 OR date_id > hi + 5""")
def purged_kfold(spark, sf):
    return sp.purged_kfold(table(spark, sf, "orders").select((F.col("o_orderkey") % 997).alias("date_id")), 5)


@query("CV2 JN19", f"""WITH @bars, {DT}, c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM (SELECT unnest(range(0, 8)) AS a), (SELECT unnest(range(0, 8)) AS b) WHERE a < b), x AS (SELECT date, idx, least(idx // (n // 8), 7) AS blk, split, a, b FROM dt, c), t AS (SELECT *, blk IN (a, b) AS test, max(CASE WHEN blk IN (a, b) THEN idx END) OVER (PARTITION BY split) AS hi,
 max(CASE WHEN blk IN (a, b) THEN 1 ELSE 0 END) OVER (PARTITION BY split ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS soon FROM x)
SELECT CAST(split AS INTEGER) AS split, CASE WHEN test THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM t WHERE test OR (soon = 0 AND NOT (idx > hi AND idx < hi + 1 + 5)) GROUP BY 1, 2""")
def combinatorial_splits(spark, sf):
    d = sp.combinatorial_splits(bars(spark, sf))
    return d.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("CV3", f"""WITH @bars, {DT}, f AS (SELECT *, greatest(1, n // 5) AS sz FROM dt, (SELECT unnest(range(0, 4)) AS fold)), v AS (SELECT *, idx >= (fold + 1) * sz AND idx < least(n, (fold + 1) * sz + sz) AS val FROM f), b AS (SELECT fold, min(date) AS fs, max(date) AS en FROM v WHERE val GROUP BY 1)
SELECT v.date, CAST(v.fold AS INTEGER) AS fold, CASE WHEN val THEN 'validation' ELSE 'train' END AS role FROM v JOIN b ON v.fold = b.fold LEFT JOIN b p ON p.fold = v.fold - 1 WHERE val OR (idx < (v.fold + 1) * sz AND v.date <= b.fs - 10 AND NOT coalesce(v.date > p.en AND v.date <= p.en + 5, false))""")
def expanding_folds(spark, sf):
    return sp.expanding_folds(bars(spark, sf), 4, 10, 5)


@query("CV4", """WITH @bars, d AS (SELECT DISTINCT date FROM bars), e AS (SELECT min(date) AS s, max(date) AS e FROM d), c AS (SELECT w, s + 730 + CAST(w AS INTEGER) * 365 AS cut, s + 730 + CAST(w AS INTEGER) * 365 + 365 AS stop FROM e, (SELECT unnest(range(0, 20)) AS w) WHERE s + 730 + CAST(w AS INTEGER) * 365 + 365 <= e)
SELECT CAST(w AS INTEGER) AS "window", CASE WHEN date < cut THEN 'train' ELSE 'validation' END AS role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM d, c WHERE date < stop GROUP BY 1, 2""")
def rolling_year_windows(spark, sf):
    d = sp.rolling_year_windows(bars(spark, sf), 2, 1)
    return d.groupBy("window", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("CV5", f"""WITH @bars, {DT}, k AS (SELECT n, greatest(CAST(ceil((n - 500 - 250) / 200) AS BIGINT), 0) + 1 AS folds FROM dt LIMIT 1), f AS (SELECT dt.date, dt.idx, fold, folds FROM dt, k, (SELECT unnest(range(0, 100)) AS fold) WHERE fold < folds AND fold >= greatest(folds - 3, 0))
SELECT CAST(fold - greatest(folds - 3, 0) AS INTEGER) AS fold, CASE WHEN idx < 500 + fold * 200 THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM f WHERE idx < 500 + fold * 200 + 250 GROUP BY 1, 2""")
def walk_forward(spark, sf):
    d = sp.walk_forward(bars(spark, sf), 500, 250, 200, last_folds=3)
    return d.groupBy(F.col("fold").cast("int").alias("fold"), "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("CV6", f"""WITH @bars, {DT}, f AS (SELECT *, greatest(1, n // 5) AS sz FROM dt, (SELECT unnest(range(0, 4)) AS fold)), v AS (SELECT *, idx >= (fold + 1) * sz AND idx < least(n, (fold + 1) * sz + sz) AS val FROM f), b AS (SELECT fold, min(date) AS fs, max(date) AS en FROM v WHERE val GROUP BY 1),
r AS (SELECT v.date, v.fold, CASE WHEN val THEN 'validation' ELSE 'train' END AS role FROM v JOIN b ON v.fold = b.fold LEFT JOIN b p ON p.fold = v.fold - 1 WHERE val OR (idx < (v.fold + 1) * sz AND v.date <= b.fs - 10 AND NOT coalesce(v.date > p.en AND v.date <= p.en + 5, false))),
j AS (SELECT r.*, volume FROM bars JOIN r ON bars.date = r.date), m AS (SELECT fold, avg(volume) AS mu, stddev_pop(volume) AS sd, max(date) AS fit_until FROM j WHERE role = 'train' GROUP BY 1)
SELECT CAST(j.fold AS INTEGER) AS fold, role, count(*) AS n, avg((volume - mu) / sd) AS mean_scaled, stddev_samp((volume - mu) / sd) AS sd_scaled, max(fit_until) AS fit_until FROM j JOIN m ON j.fold = m.fold GROUP BY 1, 2""", "mean_scaled sd_scaled")
def fold_scaler(spark, sf):
    b = bars(spark, sf)
    folds = sp.expanding_folds(b, 4, 10, 5)
    assert sp.overlap_rows(folds).limit(1).count() == 0
    d = sp.fold_scaler(b.select("symbol", "date", "volume"), folds, ["volume"])
    return d.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("mean_scaled"), F.stddev_samp("volume").alias("sd_scaled"), F.max("fit_until").alias("fit_until"))
