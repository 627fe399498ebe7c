"""Queries whose ranks and books read one input several times write it once: their last plan holds no scan of the order lines and no second making of the bars."""

import pytest
from test_plans import plan


@pytest.mark.parametrize("name", ["null_baselines", "book_backtest", "sensitivity_audit"])
def test_bars_are_made_once(spark, sf, name):
    assert "l_extendedprice" not in plan(spark, sf, name)
