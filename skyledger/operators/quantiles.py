"""Exact quantiles of several columns by distributed selection.

Each round asks for an approximate quantile a little below and one a little above the wanted rank (mergeable sketches of
bounded size), then counts the rows below, at, between and above those two values. The counts say exactly where the rank
lies: at one of the two values, and the search ends, or in an open interval between values, and the next round looks
there only. A round leaves about 2 in ``ACCURACY`` of the rows, so two or three rounds suffice for any number of rows;
values that repeat often are met as one of the two values and never searched through. All columns share each round's
job. Nothing is sorted, and what a task holds are counts and sketches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 1000


@dataclass
class _Search:
    """A rank that is sought among the rows of a column in the open interval (low, high)."""

    column: str
    rank: int = 0
    rows: int = 0
    low: float | None = None
    high: float | None = None
    near: tuple[float, float] | None = None
    found: float | None = None

    def within(self) -> Column:
        c = F.col(self.column)
        inside = c.isNotNull() & ~F.isnan(c)
        if self.low is not None:
            inside &= c > self.low
        return inside if self.high is None else inside & (c < self.high)

    def sketch(self) -> Column:
        """Approximate values a little below and above the rank."""
        share, slack = self.rank / max(1, self.rows - 1), 2.0 / ACCURACY
        return F.percentile_approx(F.when(self.within(), F.col(self.column)), [max(0.0, share - slack), min(1.0, share + slack)], ACCURACY)

    def asked(self) -> Column:
        """Counts of rows below, at, between and at the two near values."""
        c, (x, y), inside = F.col(self.column), self.near, self.within()
        return F.array(F.count_if(inside & (c < x)), F.count_if(inside & (c == x)), F.count_if(inside & (c > x) & (c < y)), F.count_if(inside & (c == y) & (c > x)))

    def told(self, counts: list[int]) -> None:
        """Narrows the search by the counts below, at, between and at the near values."""
        (x, y), left = self.near, self.rank
        self.near = None
        parts = [(self.low, x, counts[0]), (x, None, counts[1]), (x, y, counts[2]), (y, None, counts[3]), (y, self.high, self.rows - sum(counts))]
        for k, (low, high, n) in enumerate(parts):
            if left < n:
                if k in (1, 3):
                    self.found = low
                else:
                    self.rank, self.rows, self.low, self.high = left, n, low, high
                return
            left -= n
        raise AssertionError("a rank beyond its rows")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column (nulls and NaN left out): the mean of the middle two of an even number of values.

    None for a column without values. ``df`` is read about five times whatever its size: let it be a narrow table.
    """
    values = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    names = values.columns
    if not names:
        return {}
    sizes = values.agg(*[F.count_if(F.col(c).isNotNull() & ~F.isnan(c)).alias(c) for c in names]).first()
    searches = [_Search(c, rank, sizes[c]) for c in names if sizes[c] for rank in sorted({(sizes[c] - 1) // 2, sizes[c] // 2})]
    while open_ := [s for s in searches if s.found is None]:
        if fresh := [s for s in open_ if s.near is None]:
            row = values.agg(*[s.sketch().alias(f"s{k}") for k, s in enumerate(fresh)]).first()
            for s, near in zip(fresh, row):
                s.near = tuple(near)
        row = values.agg(*[s.asked().alias(f"s{k}") for k, s in enumerate(open_)]).first()
        for s, cell in zip(open_, row):
            s.told(list(cell))
    middle = {c: [s.found for s in searches if s.column == c] for c in names}
    return {c: sum(middle[n]) / len(middle[n]) if middle[n] else None for n, c in zip(names, columns)}
