"""End-to-end strategy benchmark: 1500 strategies, back-test, PBO over 12 870 splits and deflated Sharpe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import backtest as bt
from quantloom.operators import overfit as of
from quantloom.operators import signals as sg
from quantloom.operators.grids import LOOKBACKS, THRESHOLDS
from quantloom.plans.queries_signals import universe_bars
from quantloom.plans.registry import query
from quantloom.session import durable

FIFTEEN = ("AROON BOLLINGER_BREAKOUT BOLLINGER_REVERT CCI DONCHIAN_BREAKOUT KELTNER_BREAKOUT LAGGED_MOMENTUM MACD MA_CROSSOVER ROC RSI_MEANREVERT "
           "STOCHASTIC TS_MOMENTUM VOLTGT_MOMENTUM ZSCORE_MEANREVERT").split()


def benchmark_returns(spark, sf: str) -> DataFrame:
    s = bt.single_asset(sg.signal_table(universe_bars(spark, sf), FIFTEEN, LOOKBACKS, THRESHOLDS), sg.SPEC)
    return s.select("date", sg.strategy_id(*sg.SPEC).alias("strategy_id"), F.col("net_return").alias("ret"))


@query("OS1 OS6 OS14 OS15")
def strategy_benchmark(spark, sf):
    """One row: PBO, failure rate, best strategy with its deflated Sharpe."""
    r = durable(benchmark_returns(spark, sf))  # written once, read by the three statistics
    p = of.pbo(r, 16)
    d = of.deflated_sharpe(of.return_moments(r))
    best = d.agg(F.max_by(F.struct("strategy_id", "sharpe", "dsr", "psr_zero", "expected_max_sharpe"), F.struct("sharpe", "strategy_id")).alias("b")).select("b.*")
    return p.crossJoin(best)  # one-row tables
