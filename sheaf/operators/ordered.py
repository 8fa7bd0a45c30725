"""Ordered work inside a key that may hold a third of all rows.

A plain window sorts one key in one task.  ``Ordered`` keeps that plan while every key is
small, which it checks first.  Otherwise it range-partitions the (narrow) rows by key and
order, so a hot key spans many slices, freezes the slice numbers with a checkpoint in the
shared folder, and computes prefix sums, neighbours and suffix minima in two steps: within
a slice, and over the few per-slice summaries.  Results are the same either way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.constants import ROWS_PER_SLICE
from sheaf.session import freeze

_SLICE = "__slice"


def key_sizes(df: DataFrame, keys: list[str], weight: Column | None = None) -> tuple[int, int]:
    """(weight of the biggest key, weight of all rows), by partial aggregation of the keys alone."""
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    row = per_key.agg(F.max("n").alias("biggest"), F.sum("n").alias("total")).first()
    return row["biggest"] or 0, row["total"] or 0


class Ordered:
    """Rows of ``df`` ordered by ``order`` within ``keys``; (keys, order) must be unique."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows_per_slice: int = ROWS_PER_SLICE):
        self.keys, self.order = list(keys), list(order)
        biggest, total = key_sizes(df, self.keys)
        self.sliced = biggest > rows_per_slice
        if self.sliced:
            n = 2 * math.ceil(total / rows_per_slice)
            ranged = df.repartitionByRange(n, *self.keys, *self.order)
            df = freeze(ranged.withColumn(_SLICE, F.spark_partition_id()))
        self._df, self._joined = df, False

    # -- helpers -------------------------------------------------------------------------

    def _window(self, backwards=False):
        order = [F.desc(c) if backwards else F.asc(c) for c in self.order]
        return Window.partitionBy(*self.keys, *([_SLICE] if self.sliced else [])).orderBy(*order)

    def _slice_window(self):
        return Window.partitionBy(*self.keys).orderBy(_SLICE)

    def _settle(self) -> None:
        """Freeze the result of an earlier operation before it is read twice by the next one."""
        if self._joined:
            self._df, self._joined = freeze(self._df), False

    def _per_slice(self, *aggregates: Column) -> DataFrame:
        return self._df.groupBy(*self.keys, _SLICE).agg(*aggregates)

    def _with(self, df: DataFrame, joined: bool = False) -> Ordered:
        out = object.__new__(Ordered)
        out.keys, out.order, out.sliced, out._df = self.keys, self.order, self.sliced, df
        out._joined = joined
        return out

    # -- operations ----------------------------------------------------------------------

    def prefix_sums(self, **weights: Column) -> Ordered:
        """Add the sum of each weight over the rows before this one."""
        self._settle()
        before = self._window().rowsBetween(Window.unboundedPreceding, -1)
        local = {n: F.coalesce(F.sum(w).over(before), F.lit(0)) for n, w in weights.items()}
        if not self.sliced:
            return self._with(self._df.withColumns(local))
        earlier = self._slice_window().rowsBetween(Window.unboundedPreceding, -1)
        offsets = self._per_slice(*[F.sum(w).alias(f"__{n}") for n, w in weights.items()]).select(
            *self.keys,
            _SLICE,
            *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in weights],
        )
        joined = self._df.withColumns(local).join(offsets, [*self.keys, _SLICE])
        total = {n: F.col(n) + F.col(f"__{n}") for n in weights}
        return self._with(joined.withColumns(total).drop(*[f"__{n}" for n in weights]), True)

    def position(self, name: str) -> Ordered:
        """Add the 0-based position within the key."""
        return self.prefix_sums(**{name: F.lit(1)})

    def neighbour(self, name: str, columns: list[str], offset: int) -> Ordered:
        """Add the struct of ``columns`` of the previous (-1) or next (1) row; null at the ends."""
        self._settle()
        packed = F.struct(*columns)
        step = F.lag if offset < 0 else F.lead
        local = step(packed, 1).over(self._window())
        if not self.sliced:
            return self._with(self._df.withColumn(name, local))
        at = F.struct(*self.order)
        edge = (F.max_by if offset < 0 else F.min_by)(packed, at)
        edges = self._per_slice(edge.alias("__edge"))
        edges = edges.withColumn("__edge", step("__edge", 1).over(self._slice_window()))
        joined = self._df.withColumn(name, local).join(edges, [*self.keys, _SLICE])
        return self._with(joined.withColumn(name, F.coalesce(name, "__edge")).drop("__edge"), True)

    def suffix_min(self, name: str, value: Column) -> Ordered:
        """Add the smallest value over the rows after this one; null on the last row."""
        self._settle()
        # backwards, because a frame that only shrinks is recomputed for every row
        local = F.min(value).over(self._window(backwards=True).rowsBetween(Window.unboundedPreceding, -1))
        if not self.sliced:
            return self._with(self._df.withColumn(name, local))
        later = Window.partitionBy(*self.keys).orderBy(F.desc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        mins = self._per_slice(F.min(value).alias("__min"))
        mins = mins.withColumn("__min", F.min("__min").over(later))
        joined = self._df.withColumn(name, local).join(mins, [*self.keys, _SLICE])
        return self._with(joined.withColumn(name, F.least(name, "__min")).drop("__min"), True)

    def prefix_best(self, name: str, value: Column, largest: bool = True) -> Ordered:
        """Add the largest (or smallest) value over the rows before this one; null where there is none.

        With a struct that begins with the order columns, the largest is the latest.
        """
        self._settle()
        best, either = (F.max, F.greatest) if largest else (F.min, F.least)
        local = best(value).over(self._window().rowsBetween(Window.unboundedPreceding, -1))
        if not self.sliced:
            return self._with(self._df.withColumn(name, local))
        earlier = self._slice_window().rowsBetween(Window.unboundedPreceding, -1)
        bests = self._per_slice(best(value).alias("__best"))
        bests = bests.withColumn("__best", best("__best").over(earlier))
        joined = self._df.withColumn(name, local).join(bests, [*self.keys, _SLICE])
        return self._with(joined.withColumn(name, either(name, "__best")).drop("__best"), True)

    def joined_with(self, other: DataFrame) -> Ordered:
        """Add the columns of ``other`` (keys…, order…, more) to the rows it has; the slices stay."""
        return self._with(self._df.join(other, [*self.keys, *self.order], "left"), True)

    def frozen(self) -> Ordered:
        """The same rows, computed once."""
        return self._with(freeze(self._df))

    def with_columns(self, **columns: Column) -> Ordered:
        """Add row-local columns."""
        return self._with(self._df.withColumns(columns), self._joined)

    def without(self, *names: str) -> Ordered:
        """Drop columns."""
        return self._with(self._df.drop(*names), self._joined)

    def to_df(self) -> DataFrame:
        return self._df.drop(_SLICE)
