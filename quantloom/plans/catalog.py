"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

import importlib

from quantloom.plans.registry import QUERIES, Query

MODULES = ("queries_features", "queries_market", "queries_backtest", "queries_signals", "queries_overfit", "queries_text", "queries_models", "queries_streaming", "queries_io", "queries_reviews", "benchmark")


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"quantloom.plans.{module}")
    return dict(QUERIES)
