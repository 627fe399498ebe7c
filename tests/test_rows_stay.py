"""Rows that one symbol's task already holds are not shuffled again."""

import re

from test_plans import plan


def exchanges(p):
    return [m for m in re.findall(r"Exchange hashpartitioning\(([^\n]*)", p)]


def test_rows_of_a_book_meet_the_book_before_without_a_shuffle(spark, sf):
    p = plan(spark, sf, "sensitivity_audit")
    assert "FullOuter" not in p and not any("book_no" in e for e in exchanges(p))


def test_membership_joins_before_rows_are_partitioned_by_symbol(spark, sf):
    p = plan(spark, sf, "composed_features")
    # one partitioning by symbol for each place that reads the panel (features, dispersion, its mean, ranks), none for the membership
    assert p.count("REPARTITION_BY_NUM") <= 4
