"""Named rule sets over metric rows: one row per candidate in, its verdict as columns out.

A metric that is null or NaN fails its rule unless the rule says otherwise, so a missing number never promotes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import require_columns

Rules = Sequence[tuple[str, Column]]


def _number(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def failed_rules(rules: Rules) -> Column:
    """Names of the rules that are not true, in the order of the list."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules]))


def first_class(rules: Rules, default: str = "none") -> Column:
    """Name of the first rule that is not true."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules], F.lit(default))


# ---------------------------------------------------------------- promotion of a cross-sectional book

def success_rules() -> Rules:
    """The thirteen criteria of promotion, with concentration as three rules and borrow stress as two."""
    n = _number
    label, sharpe, family = F.col("data_quality_label"), n("net_sharpe"), n("family_sharpe")
    audited = (n("capture_ratio") >= 0.95) & (F.coalesce(n("unknown_exits"), F.lit(0.0)) <= 0)
    return [
        ("data_quality", label.isin("pit_safe", "partial_pit_universe")),
        ("holdout_length", n("holdout_days") >= 756),
        ("exit_audit", (label != "pit_safe") | audited),
        ("standalone_sharpe", sharpe >= 0.7),
        ("beats_family", F.when(family > 0, sharpe >= 1.5 * family).otherwise(sharpe - family >= 0.5)),
        ("beats_index", (n("index_sharpe") <= 0) | (sharpe > n("index_sharpe"))),
        ("drawdown", n("max_drawdown") >= -0.25),
        ("borrow_x2", n("borrow_x2_sharpe") > 0),
        ("borrow_x3", n("borrow_x3_return") > 0),
        ("beats_overlay", n("overlay_sharpe") < sharpe),
        ("rolling_windows", F.col("windows_consistent")),
        ("stock_share", ~F.col("stock_violation")),
        ("month_share", ~F.col("month_violation")),
        ("sector_share", ~F.col("sector_violation")),
        ("checks_green", F.col("checks_green")),
        ("artifacts", F.col("artifacts_complete")),
    ]


SUCCESS_COLUMNS = ("data_quality_label", "holdout_days", "capture_ratio", "unknown_exits", "net_sharpe", "family_sharpe", "index_sharpe", "max_drawdown", "borrow_x2_sharpe", "borrow_x3_return",
                   "overlay_sharpe", "windows_consistent", "stock_violation", "month_violation", "sector_violation", "checks_green", "artifacts_complete")


def success_gate(metrics: DataFrame) -> DataFrame:
    """``failures``, ``suspended`` and ``passed``; a prototype universe suspends the gate and no other rule is read."""
    require_columns(metrics, SUCCESS_COLUMNS)
    prototype = F.coalesce(F.col("data_quality_label") == "survivorship_prototype_only", F.lit(False))
    d = metrics.withColumn("failures", F.when(prototype, F.array(F.lit("suspended"))).otherwise(failed_rules(success_rules())))
    return d.withColumns({"suspended": prototype, "passed": F.size("failures") == 0})


# ---------------------------------------------------------------- perpetual-futures candidates

def perp_rules() -> Rules:
    """Blocker names and limits are fixed values; a deflated probability may be missing, all else may not."""
    n = _number
    return [
        ("missing_or_high_pbo", n("pbo_probability") <= 0.25),
        ("bootstrap_ci_not_positive", n("bootstrap_ci_lower_95") > 0),
        ("low_deflated_sharpe_probability", n("deflated_sharpe_probability").isNull() | (n("deflated_sharpe_probability") >= 0.95)),
        ("low_net_daily_sharpe", n("net_daily_sharpe") >= 1.5),
        ("non_positive_net_total_return", n("net_total_return") > 0),
        ("fails_2x_cost_stress", n("cost_2x_net_total_return") > 0),
        ("fails_1_event_delay_stress", n("delay_1_event_net_total_return") > 0),
        ("performance_concentration", ~F.coalesce(F.col("concentration_blocker"), F.lit(False))),
    ]


def perp_candidates(metrics: DataFrame) -> DataFrame:
    """``blockers`` and ``research_candidate``; free data always adds a soft blocker, so nothing is promoted from here."""
    d = metrics.withColumn("_hard", failed_rules(perp_rules()))
    return d.withColumns({"blockers": F.concat("_hard", F.array(F.lit("free_data_research_only"))), "research_candidate": F.size("_hard") == 0, "promotion_eligible": F.lit(False)}).drop("_hard")


# ---------------------------------------------------------------- validation of one strategy

@dataclass(frozen=True)
class Limits:
    """Limits of a validation run."""

    pbo_max: float = 0.5
    dsr_min: float = 0.95
    cost_stress_min: float = 0.0
    bootstrap_lower_min: float = 0.0
    delay_loss: float = 0.5
    month_share_max: float = 0.5
    over_random: float = 0.1
    dev_sharpe_min: float = 0.5
    holdout_sharpe_min: float = 0.0

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) is None:
                raise ValueError(f"limit {f.name} is missing")


def failure_rules(limits: Limits) -> Rules:
    n, base = _number, _number("sharpe_base")
    delays = F.least(*[n(c) - base for c in ("sharpe_delay_1", "sharpe_delay_2")])
    return [
        ("high_pbo", n("pbo") <= limits.pbo_max),
        ("low_dsr", n("dsr") >= limits.dsr_min),
        ("cost_failure", n("sharpe_cost_x2") >= limits.cost_stress_min),
        ("insufficient_sample", n("bootstrap_lower") >= limits.bootstrap_lower_min),
        ("delay_stress_fail", delays >= -limits.delay_loss),
        ("single_period_dominance", n("max_month_share") <= limits.month_share_max),
        ("randomization_fail", n("dev_sharpe") > n("sharpe_random") + limits.over_random),
        ("over_correlated_with_baseline", n("dev_sharpe") > n("sharpe_inverted")),
        ("holdout_failure", n("holdout_sharpe") >= limits.holdout_sharpe_min),
    ]


def validation_status(metrics: DataFrame, limits: Limits = Limits(), new_source: Column | bool = False) -> DataFrame:
    """``failure_classes`` and ``status``: none, research_pass or promotion_eligible.

    A strategy on prices alone (``new_source`` false) never gets beyond research_pass, and only when both Sharpes reach their floor.
    """
    source = F.lit(new_source) if isinstance(new_source, bool) else F.coalesce(new_source, F.lit(False))
    d = metrics.withColumn("failure_classes", failed_rules(failure_rules(limits)))
    clean = F.size("failure_classes") == 0
    strong = F.coalesce((_number("dev_sharpe") >= limits.dev_sharpe_min) & (_number("holdout_sharpe") >= limits.holdout_sharpe_min), F.lit(False))
    return d.withColumn("status", F.when(~clean, "none").when(source & strong, "promotion_eligible").when(source | strong, "research_pass").otherwise("none"))


# ---------------------------------------------------------------- allocator decision

ALLOCATOR_CLASSES = (("not_group_dependent", "regime_concentration"), ("group_out_keeps_drawdown", "regime_concentration"), ("most_windows_beaten", "subsumed_by_benchmark"),
                     ("delay_holds", "execution_or_regime_instability"), ("crisis_value", "crisis_insurance_only"))


def allocator_decision(gates: DataFrame) -> DataFrame:
    """``failure`` (class of the first gate that fails) and ``advance`` for boolean gate columns."""
    require_columns(gates, [g for g, _ in ALLOCATOR_CLASSES])
    d = gates.withColumn("failure", first_class([(name, F.col(gate)) for gate, name in ALLOCATOR_CLASSES]))
    return d.withColumn("advance", F.col("failure") == "none")
