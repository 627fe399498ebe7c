"""Review queries: baskets without a sector, shares, crisis windows, sector sleeves, named gates, validation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import by, clip, div
from quantloom.operators import aggregates as ag
from quantloom.operators import backtest as bt
from quantloom.operators import gates as gt
from quantloom.operators import reviews as rv
from quantloom.plans.queries_backtest import BOOK_SQL, book_panel, dd_sql
from quantloom.plans.registry import query
from quantloom.plans.views import bars, sectors

# Returns of the bound bars, clipped: closes of neighbouring dates differ by a factor of up to two.
PANEL = """pn AS (SELECT symbol, date, least(greatest(coalesce(close / lag(close) OVER k - 1, 0), -0.05), 0.05) AS ret, sign(close / open - 1) AS signal FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY date))"""
NET = f"""{PANEL}, ps AS (SELECT *, coalesce(lag(signal) OVER k, 0) AS pos FROM pn WINDOW k AS (PARTITION BY symbol ORDER BY date)),
nt AS (SELECT *, pos * ret - abs(pos - coalesce(lag(pos) OVER k, 0)) * 1e-4 AS net FROM ps WINDOW k AS (PARTITION BY symbol ORDER BY date))"""
STARTS = [(f"from_{y}", f"{y}-01-01") for y in range(1996, 2001)]
WINDOWS = [("autumn_1998", "1998-10-01", "1998-12-31"), ("spring_2000", "2000-02-19", "2000-04-30"), ("year_2001", "2001-01-01", "2001-12-31")]
STARTS_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}')" for n, a in STARTS) + ") AS v(start, lo)"
WINDOWS_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WINDOWS) + ") AS v(label, lo, hi)"


def panel(spark, sf):
    d = bars(spark, sf)
    return d.select("symbol", "date", clip(F.coalesce(div("close", F.lag("close").over(by())) - 1, F.lit(0.0)), -0.05, 0.05).alias("ret"), F.signum(F.col("close") / F.col("open") - 1).alias("signal"))


def net_returns(spark, sf):
    return bt.timing(panel(spark, sf), round_trip_bps=1.0)


def sector_names(spark, sf):
    return sorted(r[0] for r in sectors(spark, sf).select("sector").distinct().collect())  # a handful


@query("BT23", f"""WITH @bars, @sectors, {NET}, g AS (SELECT sector, date, sum(net) AS s, count(net) AS n FROM nt JOIN sectors USING (symbol) GROUP BY 1, 2), w AS (SELECT date, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1),
x AS (SELECT 'none' AS excluded, date, s / n AS net FROM w UNION ALL SELECT k.sector, w.date, (w.s - coalesce(g.s, 0)) / (w.n - coalesce(g.n, 0)) FROM w CROSS JOIN (SELECT DISTINCT sector FROM sectors) k LEFT JOIN g ON g.date = w.date AND g.sector = k.sector WHERE w.n > coalesce(g.n, 0)),
y AS (SELECT excluded, start, date, net FROM x JOIN {STARTS_SQL} ON date >= lo), m AS (SELECT excluded, start, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, product(1 + net) - 1 AS total_return, count(*) AS n_days FROM y GROUP BY 1, 2)
SELECT m.*, max_drawdown FROM m JOIN {dd_sql('y', 'net', 'excluded, start')} d USING (excluded, start)""", "sharpe total_return max_drawdown")
def leave_group_out(spark, sf):
    d = net_returns(spark, sf).join(sectors(spark, sf), "symbol")
    return rv.leave_group_out(d, "sector", sector_names(spark, sf), STARTS).select("excluded", "start", "sharpe", "total_return", "n_days", "max_drawdown")


@query("BT23 AG9", f"""WITH @bars, @sectors, {NET}, u AS (SELECT 'group' AS kind, sector AS name, net FROM nt JOIN sectors USING (symbol) UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), net FROM nt JOIN sectors USING (symbol)), p AS (SELECT kind, name, sum(net) AS pnl FROM u GROUP BY 1, 2)
SELECT *, pnl / sum(pnl) OVER (PARTITION BY kind) AS share FROM p""", "pnl share", digits=5)
def pnl_shares(spark, sf):
    return rv.pnl_shares(net_returns(spark, sf).join(sectors(spark, sf), "symbol"), "sector")


@query("BT23 MT12", f"""WITH @bars, {NET}, b AS (SELECT date, avg(net) AS strategy, avg(ret) AS bench FROM nt GROUP BY 1), l AS (SELECT b.*, coalesce(label, 'calm') AS label FROM b LEFT JOIN {WINDOWS_SQL} ON date BETWEEN lo AND hi),
u AS (SELECT label, 'strategy' AS side, date, strategy AS r FROM l UNION ALL SELECT label, 'bench', date, bench FROM l), m AS (SELECT label, side, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, product(1 + r) - 1 AS ret, count(*) AS n_days FROM u GROUP BY 1, 2),
f AS (SELECT m.*, max_drawdown AS dd FROM m JOIN {dd_sql('u', 'r', 'label, side')} d USING (label, side))
SELECT s.label, s.ret AS strategy_return, s.dd AS strategy_drawdown, s.sharpe AS strategy_sharpe, b.ret AS bench_return, b.dd AS bench_drawdown, b.sharpe AS bench_sharpe, s.n_days, s.dd - b.dd AS avoided_drawdown, s.ret - b.ret AS relative_return FROM f s JOIN f b ON s.label = b.label AND s.side = 'strategy' AND b.side = 'bench'""",
       "strategy_return strategy_drawdown strategy_sharpe bench_return bench_drawdown bench_sharpe avoided_drawdown relative_return", digits=5)
def crisis_windows(spark, sf):
    b = net_returns(spark, sf).groupBy("date").agg(F.avg("net_return").alias("net_return"), F.avg("ret").alias("bench_return"))
    return rv.crisis_windows(b, WINDOWS)


SECTOR_BOOK_SQL = BOOK_SQL.replace("AS dv FROM bars),", "AS dv, sector FROM bars JOIN sectors USING (symbol)),").replace("PARTITION BY execution_date", "PARTITION BY sector, execution_date").replace("SELECT execution_date, symbol, close, open AS fill,", "SELECT sector, execution_date, symbol, close, open AS fill,") \
    .replace("SELECT execution_date, row_number() OVER (ORDER BY execution_date) AS no FROM (SELECT DISTINCT execution_date FROM bk)", "SELECT sector, execution_date, row_number() OVER (PARTITION BY sector ORDER BY execution_date) AS no FROM (SELECT DISTINCT sector, execution_date FROM bk)") \
    .replace("JOIN dy USING (execution_date)", "JOIN dy USING (sector, execution_date)").replace("SELECT coalesce(a.no, b.no + 1) AS no,", "SELECT coalesce(a.sector, b.sector) AS sector, coalesce(a.no, b.no + 1) AS no,").replace("ON a.no = b.no + 1 AND", "ON a.sector = b.sector AND a.no = b.no + 1 AND") \
    .replace("JOIN dy ON m.no = dy.no", "JOIN dy ON m.no = dy.no AND m.sector = dy.sector")
SLEEVES_SQL = f"""{SECTOR_BOOK_SQL}, sv AS (SELECT sector, date, (sum(CASE WHEN sp <> 0 AND cp IS NOT NULL AND ct IS NOT NULL THEN sp * (ct / cp - 1) ELSE 0 END) + sum(CASE WHEN sn <> sp AND fill IS NOT NULL AND ct IS NOT NULL THEN (sn - sp) / fill * (ct - fill) ELSE 0 END)
 - sum(abs(sn - sp)) * 0.5e-4 - sum(abs(sn - sp) * 15 * CASE WHEN isnew AND date < DATE '2001-04-09' THEN 2.5 ELSE 1 END / 2 / 1e4) - sum(CASE WHEN sn < 0 THEN -sn * 100 / 1e4 / 252 ELSE 0 END) - greatest(sum(abs(sn)) - 1e6, 0) * 0.05 / 252) / 1e6 AS net_return FROM m2 GROUP BY 1, 2)"""
PHASES = [("development", "1992-01-01", "1998-12-31"), ("holdout", "1999-01-01", "2002-12-31"), ("whole", "1992-01-01", "2002-12-31")]
PHASES_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PHASES) + ") AS v(label, lo, hi)"


def sector_books(spark, sf):
    return bt.book_backtest(book_panel(spark, sf), q=0.1, min_names=2, keys=["sector"])


@query("BT22 BT7", f"WITH @bars, @sectors, {SLEEVES_SQL} SELECT * FROM sv", "net_return")
def sector_books_daily(spark, sf):
    return sector_books(spark, sf).select("sector", "date", "net_return")


@query("BT22 AG14 MT12", f"""WITH @bars, @sectors, {SLEEVES_SQL}, gr AS (SELECT d.date, k.sector, coalesce(net_return, 0) AS x FROM (SELECT DISTINCT date FROM sv) d CROSS JOIN (SELECT DISTINCT sector FROM sectors) k LEFT JOIN sv ON sv.date = d.date AND sv.sector = k.sector),
iv AS (SELECT *, 1 / greatest(coalesce(CASE WHEN count(x) OVER w >= 60 THEN stddev_samp(x) OVER w END, 0.02), 0.0005) AS iv FROM gr WINDOW w AS (PARTITION BY sector ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), ag AS (SELECT date, sum(iv * x) / sum(iv) AS net FROM iv GROUP BY 1),
al AS (SELECT label, date, net FROM ag JOIN {PHASES_SQL} ON date BETWEEN lo AND hi), am AS (SELECT label, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, product(1 + net) - 1 AS total_return, count(*) AS n_days FROM al GROUP BY 1),
ss AS (SELECT label, sector, sum(net_return) AS s FROM sv JOIN {PHASES_SQL} ON date BETWEEN lo AND hi GROUP BY 1, 2), sh AS (SELECT label, count_if(s > 0) AS n_positive, coalesce(max(greatest(s, 0)) / nullif(sum(greatest(s, 0)), 0), 0) AS max_sector_share FROM ss GROUP BY 1)
SELECT am.*, max_drawdown, n_positive, max_sector_share FROM am JOIN {dd_sql('al', 'net', 'label')} d USING (label) JOIN sh USING (label)""", "sharpe total_return max_drawdown max_sector_share", digits=5)
def sector_sleeves(spark, sf):
    s = sector_books(spark, sf).select("sector", "date", "net_return")
    book = ag.equal_risk(s, sector_names(spark, sf), ret="net_return")
    return rv.sleeve_phases(s, book, PHASES)


METRICS_SQL = f"""{PANEL}, lg AS (SELECT *, coalesce(lag(signal, 1) OVER k, 0) AS p0, coalesce(lag(signal, 2) OVER k, 0) AS p1, coalesce(lag(signal, 3) OVER k, 0) AS p2 FROM pn WINDOW k AS (PARTITION BY symbol ORDER BY date)),
tn AS (SELECT *, abs(p0 - coalesce(lag(p0) OVER k, 0)) AS t0, abs(p1 - coalesce(lag(p1) OVER k, 0)) AS t1, abs(p2 - coalesce(lag(p2) OVER k, 0)) AS t2, date < DATE '1997-01-01' AS dev FROM lg WINDOW k AS (PARTITION BY symbol ORDER BY date)),
nv AS (SELECT symbol, date, dev, p0 * ret - t0 * 2e-4 AS b, p0 * ret - t0 * 4e-4 AS c2, p1 * ret - t1 * 2e-4 AS d1, p2 * ret - t2 * 2e-4 AS d2, -p0 * ret - t0 * 2e-4 AS i FROM tn),
mo AS (SELECT symbol, max(abs(v)) / nullif(sum(abs(v)), 0) AS share FROM (SELECT symbol, date_trunc('month', date) AS mth, sum(b) AS v FROM nv WHERE dev GROUP BY 1, 2) GROUP BY 1),
me AS (SELECT symbol, {', '.join(f"coalesce(avg({c}) FILTER (WHERE {w}) / nullif(stddev_samp({c}) FILTER (WHERE {w}), 0), 0) * sqrt(252) AS {n}" for n, c, w in (('dev_sharpe', 'b', 'dev'), ('holdout_sharpe', 'b', 'NOT dev'), ('sharpe_cost_x2', 'c2', 'dev'), ('sharpe_delay_1', 'd1', 'dev'), ('sharpe_delay_2', 'd2', 'dev'), ('sharpe_inverted', 'i', 'dev')))},
  count(b) FILTER (WHERE dev) AS n_dev, count(b) FILTER (WHERE NOT dev) AS n_holdout FROM nv GROUP BY 1),
mt AS (SELECT me.*, coalesce(share, 0) AS share FROM me LEFT JOIN mo USING (symbol))"""


def validated(spark, sf):
    return rv.validation_metrics(panel(spark, sf), "1997-01-01")


@query("OS15 BT19 OS19", f"""WITH @bars, {METRICS_SQL}, f AS (SELECT *, list_filter([CASE WHEN sharpe_cost_x2 >= 0 THEN NULL ELSE 'cost_failure' END, CASE WHEN least(sharpe_delay_1, sharpe_delay_2) - dev_sharpe >= -0.5 THEN NULL ELSE 'delay_stress_fail' END, CASE WHEN share <= 0.5 THEN NULL ELSE 'single_period_dominance' END,
 CASE WHEN dev_sharpe > sharpe_inverted THEN NULL ELSE 'over_correlated_with_baseline' END, CASE WHEN holdout_sharpe >= 0 THEN NULL ELSE 'holdout_failure' END], lambda x: x IS NOT NULL) AS fc FROM mt)
SELECT symbol, dev_sharpe, holdout_sharpe, array_to_string(fc, ',') AS failure_classes, CASE WHEN len(fc) > 0 THEN 'none' WHEN symbol % 2 = 0 AND dev_sharpe >= 0.5 AND holdout_sharpe >= 0 THEN 'promotion_eligible' WHEN symbol % 2 = 0 OR (dev_sharpe >= 0.5 AND holdout_sharpe >= 0) THEN 'research_pass' ELSE 'none' END AS status FROM f""", "dev_sharpe holdout_sharpe", digits=5)
def validation_run(spark, sf):
    # the bootstrap, overfitting and placebo numbers are not SQL; constants that pass stand for them here, tests cover their rules
    d = validated(spark, sf).withColumns({"pbo": F.lit(0.1), "dsr": F.lit(0.99), "bootstrap_lower": F.lit(0.1), "sharpe_random": F.lit(-1e9)})
    v = gt.validation_status(d, new_source=F.col("symbol") % 2 == 0)
    return v.select("symbol", "dev_sharpe", "holdout_sharpe", F.array_join("failure_classes", ",").alias("failure_classes"), "status")


@query("OS16", f"""WITH @bars, {METRICS_SQL}, g AS (SELECT symbol, CASE symbol % 4 WHEN 0 THEN 'survivorship_prototype_only' WHEN 1 THEN 'pit_safe' WHEN 2 THEN 'partial_pit_universe' ELSE 'unknown' END AS label, n_holdout, (symbol % 10) / 10.0 AS capture, dev_sharpe, sharpe_inverted, holdout_sharpe, sharpe_cost_x2, sharpe_delay_1, sharpe_delay_2, share FROM mt),
x AS (SELECT *, list_filter([CASE WHEN label IN ('pit_safe', 'partial_pit_universe') THEN NULL ELSE 'data_quality' END, CASE WHEN n_holdout >= 756 THEN NULL ELSE 'holdout_length' END, CASE WHEN label <> 'pit_safe' OR capture >= 0.95 THEN NULL ELSE 'exit_audit' END, CASE WHEN dev_sharpe >= 0.7 THEN NULL ELSE 'standalone_sharpe' END,
 CASE WHEN (sharpe_inverted > 0 AND dev_sharpe >= 1.5 * sharpe_inverted) OR (sharpe_inverted <= 0 AND dev_sharpe - sharpe_inverted >= 0.5) THEN NULL ELSE 'beats_family' END, CASE WHEN holdout_sharpe <= 0 OR dev_sharpe > holdout_sharpe THEN NULL ELSE 'beats_index' END, CASE WHEN sharpe_cost_x2 > 0 THEN NULL ELSE 'borrow_x2' END, CASE WHEN sharpe_delay_1 > 0 THEN NULL ELSE 'borrow_x3' END,
 CASE WHEN sharpe_delay_2 < dev_sharpe THEN NULL ELSE 'beats_overlay' END, CASE WHEN share <= 0.35 THEN NULL ELSE 'month_share' END], lambda x: x IS NOT NULL) AS fl FROM g)
SELECT symbol, CASE WHEN symbol % 4 = 0 THEN 'suspended' ELSE array_to_string(fl, ',') END AS failures, symbol % 4 = 0 AS suspended, symbol % 4 <> 0 AND len(fl) = 0 AS passed FROM x""")
def promotion_gate(spark, sf):
    s, no = F.col("symbol"), F.lit(False)
    label = F.when(s % 4 == 0, "survivorship_prototype_only").when(s % 4 == 1, "pit_safe").when(s % 4 == 2, "partial_pit_universe").otherwise("unknown")
    d = validated(spark, sf).select(
        "symbol", label.alias("data_quality_label"), F.col("n_holdout").alias("holdout_days"), (s % 10 / 10.0).alias("capture_ratio"), F.lit(0).alias("unknown_exits"), F.col("dev_sharpe").alias("net_sharpe"), F.col("sharpe_inverted").alias("family_sharpe"),
        F.col("holdout_sharpe").alias("index_sharpe"), F.lit(-0.1).alias("max_drawdown"), F.col("sharpe_cost_x2").alias("borrow_x2_sharpe"), F.col("sharpe_delay_1").alias("borrow_x3_return"), F.col("sharpe_delay_2").alias("overlay_sharpe"), F.lit(True).alias("windows_consistent"),
        no.alias("stock_violation"), (F.col("max_month_share") > 0.35).alias("month_violation"), no.alias("sector_violation"), F.lit(True).alias("checks_green"), F.lit(True).alias("artifacts_complete"))
    return gt.success_gate(d).select("symbol", F.array_join("failures", ",").alias("failures"), "suspended", "passed")
