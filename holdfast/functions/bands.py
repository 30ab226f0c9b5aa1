"""Banding: total CASE ladders, right-closed cuts and left-closed curve bins.

Everything here builds native column expressions, so a banded report stays one
scan with map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ladder:
    """Ordered arms (limit, label) and a label for everything else.

    With ``exact`` an arm matches equality, otherwise ``value <= limit``.
    """

    column: str
    arms: tuple[tuple[int, str], ...]
    rest: str
    exact: bool = False

    def _pick(self, results: Sequence[Column], rest: Column) -> Column:
        value = F.col(self.column)
        chain = F
        for (limit, _), result in zip(self.arms, results):
            chain = chain.when(value == limit if self.exact else value <= limit, result)
        return chain.otherwise(rest)

    def label(self) -> Column:
        return self._pick([F.lit(text) for _, text in self.arms], F.lit(self.rest))

    def order(self) -> Column:
        """Position of the band, for sorting axes."""
        ranks = [F.lit(i) for i in range(1, len(self.arms) + 1)]
        return self._pick(ranks, F.lit(len(self.arms) + 1))


@dataclass(frozen=True)
class Cut:
    """Right-closed intervals (edge, next edge]; NULL outside all of them."""

    column: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def label(self) -> Column:
        value = F.col(self.column)
        chain = F
        for low, high, text in zip(self.edges, self.edges[1:], self.labels):
            chain = chain.when((value > low) & (value <= high), F.lit(text))
        return chain.otherwise(F.lit(None).cast("string"))


# Band limits and labels that reports must show as they are.
TENURE = Ladder(
    "tenure_days",
    ((90, "0-90 days"), (180, "91-180 days"), (365, "181-365 days"), (730, "1-2 years")),
    "2+ years",
)
TICKETS = Ladder(
    "support_tickets", ((0, "0 tickets"), (1, "1 ticket"), (2, "2 tickets")), "3+ tickets", exact=True
)
RECENCY = Ladder(
    "days_since_login",
    ((2, "0-2 days"), (5, "3-5 days"), (10, "6-10 days"), (20, "11-20 days"), (40, "21-40 days")),
    "40+ days",
)
AGE = Ladder("age", ((24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54")), "55+")

AGE_CUT = Cut("age", (17, 24, 34, 44, 54, 100), ("18-24", "25-34", "35-44", "45-54", "55+"))
RECENCY_CUT = Cut(
    "days_since_login",
    (-1, 2, 5, 10, 20, 40, 1000),
    ("0-2d", "3-5d", "6-10d", "11-20d", "21-40d", "40d+"),
)
WATCH_CUT = Cut(
    "watch_time_hours",
    (-1, 1, 2.5, 5, 10, 1000),
    ("0-1 hr", "1-2.5 hrs", "2.5-5 hrs", "5-10 hrs", "10+ hrs"),
)
TICKET_CUT = Cut("support_tickets", (-1, 0, 1, 2, 100), ("0", "1", "2", "3+"))
TENURE_CUT = Cut(
    "tenure_days", (0, 90, 180, 365, 730, 1200), ("0-90d", "91-180d", "181-365d", "1-2yr", "2yr+")
)
# The older dashboard leaves the top band open up to 100000.
OLD_RECENCY_CUT = Cut("days_since_login", (-1, 2, 5, 10, 20, 40, 100000), RECENCY_CUT.labels)
OLD_TENURE_CUT = Cut("tenure_days", (0, 90, 180, 365, 730, 100000), TENURE_CUT.labels)


def curve_bin(value: Column, step: int, last: int, stop: int) -> Column:
    """Left edge of [lo, lo+step); the bin at ``last`` runs to ``stop``; NULL outside."""
    low = F.least(F.floor(value / step) * step, F.lit(last)).cast("int")
    return F.when((value >= 0) & (value < stop), low)


def quantile_bucket(value: Column, edges: Column) -> Column:
    """1-based right-closed bucket among sorted unique edges; the lowest edge joins bucket 1."""
    below = F.size(F.filter(edges, lambda edge: edge < value))
    return F.when(value.isNotNull(), F.greatest(F.lit(1), below))
