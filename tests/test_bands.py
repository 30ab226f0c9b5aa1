from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.functions import bands
from holdfast.functions.numbers import plain_number, round_dp

CUTS = [
    bands.AGE_CUT,
    bands.RECENCY_CUT,
    bands.WATCH_CUT,
    bands.TICKET_CUT,
    bands.TENURE_CUT,
    bands.OLD_RECENCY_CUT,
    bands.OLD_TENURE_CUT,
]


def values_around(edges):
    points = [float(e + d) for e in edges for d in (-0.001, 0.0, 0.001)]
    return points + [min(edges) - 50.0, max(edges) + 50.0, None]


@pytest.mark.parametrize("cut", CUTS, ids=lambda c: f"{c.column}-{c.edges[-1]}")
def test_cut_is_right_closed_and_null_outside(spark, cut):
    values = values_around(cut.edges)
    df = spark.createDataFrame([(v,) for v in values], f"{cut.column} double")
    found = [r[0] for r in df.select(cut.label()).collect()]
    binned = pd.cut(pd.Series(values, dtype=float), list(cut.edges), labels=list(cut.labels))
    assert found == [None if pd.isna(b) else b for b in binned]


@pytest.mark.parametrize("ladder", [bands.TENURE, bands.RECENCY, bands.AGE], ids=lambda x: x.column)
def test_ladder_is_total_and_ordered(spark, ladder):
    limits = [limit for limit, _ in ladder.arms]
    values = values_around(limits)
    df = spark.createDataFrame([(v,) for v in values], f"{ladder.column} double")
    labels = [text for _, text in ladder.arms] + [ladder.rest]
    for value, label, order in df.select(ladder.column, ladder.label(), ladder.order()).collect():
        place = len(limits) if value is None else int(np.searchsorted(limits, value, side="left"))
        assert (label, order) == (labels[place], place + 1)


def test_ticket_ladder_matches_exact_counts(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 1, 2, 3, 99, None)], "support_tickets int")
    assert [r[0] for r in df.select(bands.TICKETS.label()).collect()] == [
        "3+ tickets",
        "0 tickets",
        "1 ticket",
        "2 tickets",
        "3+ tickets",
        "3+ tickets",
        "3+ tickets",
    ]


def test_curve_bins_are_left_closed_with_an_open_last_bin(spark):
    values = [-0.5, 0.0, 2.99, 3.0, 56.9, 57.0, 60.0, 999.9, 1000.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(bands.curve_bin(F.col("v"), 3, 57, 1000)).collect()]
    assert found == [None, 0, 0, 3, 54, 57, 57, 57, None, None]


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-0.125,), (None,)], "v double")
    assert [r[0] for r in df.select(round_dp(F.col("v"), 2)).collect()] == [1.01, 2.68, -0.13, None]


def test_plain_number(spark):
    df = spark.createDataFrame([(3.5,), (10.0,), (100.0,), (0.0,), (15.87,)], "v double")
    assert [r[0] for r in df.select(plain_number(F.col("v"), 2)).collect()] == ["3.5", "10", "100", "0", "15.87"]
