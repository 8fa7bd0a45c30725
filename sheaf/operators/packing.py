"""Concatenate ordered texts per key into parts of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.constants import BROADCAST_BYTES, PART_BYTES, ROWS_PER_SLICE, SHARD_ROWS
from sheaf.operators.ordered import Ordered, key_sizes
from sheaf.operators.sizes import small_side, text_bytes
from sheaf.session import freeze


class Parts:
    """Numbered parts of the keys that need more than one.

    ``placed``: keys…, order…, part of each row with text; ``bounds``: keys…, part, first (its first order value).
    """

    def __init__(self, keys: list[str], order: list[str], placed: DataFrame, bounds: DataFrame, last: DataFrame | None = None):
        self.keys, self.order, self.placed, self.bounds = keys, order, placed, bounds
        # keys…, __last: parts after this one show nothing and are merged into it
        self.last = last if last is not None else freeze(bounds.groupBy(*keys).agg(F.max("part").alias("__last")))

    def ending_at(self, last: DataFrame) -> Parts:
        """The same parts with other last ones."""
        return Parts(self.keys, self.order, self.placed, self.bounds, last)


def number(
    narrow: DataFrame,
    keys: list[str],
    order: list[str],
    weight: str,
    part_bytes: int = PART_BYTES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Parts | None:
    """The parts of the keys that outgrow one; None if none does.

    ``narrow``: keys, order and weight of the rows that have text, read several times.  A part ends
    where the weight of the rows before reaches the next multiple of ``part_bytes``; multiples at
    which no row begins make no part, so parts are numbered without gaps.  Only the rows of big keys are put in order.
    """
    biggest, _ = key_sizes(narrow, keys, F.col(weight))
    if biggest <= part_bytes:
        return None
    sizes = narrow.groupBy(*keys).agg(F.sum(weight).alias("__size"))
    big = freeze(sizes.where(F.col("__size") > part_bytes).select(*keys))
    mine = narrow.join(small_side(big), keys, "left_semi")
    before = Ordered(mine, keys, order, rows_per_slice).prefix_sums(__before=F.col(weight)).to_df()
    stepped = freeze(before.select(*keys, *order, F.floor(F.col("__before") / part_bytes).alias("__step")))
    begins = freeze(stepped.groupBy(*keys, "__step").agg(F.min(F.struct(*order)).alias("first")))
    bounds = freeze(Ordered(begins, keys, ["__step"], rows_per_slice).position("part").to_df().withColumn("part", F.col("part").cast("bigint")))
    placed = stepped.join(small_side(bounds.drop("first")), [*keys, "__step"]).drop("__step")
    return Parts(keys, order, placed, bounds.drop("__step"))


# Children of one node of the index over the bounds of a key.
FAN = 64


def _by_index(rows: DataFrame, parts: Parts, limit: int) -> DataFrame | None:
    """Add ``part`` through an index over the bounds; None if it is too big to be sent to every executor.

    The bounds of a key are the leaves of a tree of FAN children a node; a row goes down from the root by one lookup a level, and
    compares itself with the bounds of one node.  No list is longer than FAN, however many parts a key has.
    """
    keys, order = parts.keys, parts.order
    if text_bytes(parts.bounds) > limit:
        return None
    most = parts.bounds.agg(F.max("part")).first()[0]
    at, found = F.struct(*order), rows.withColumn("__node", F.lit(0).cast("bigint"))
    height = 1
    while FAN**height <= most:
        height += 1
    for level in reversed(range(height)):
        step = FAN**level  # bounds below one child
        starts = parts.bounds.where(F.col("part") % step == 0)
        child = F.floor(F.col("part") / step)
        nodes = starts.groupBy(*keys, F.floor(child / FAN).alias("__node")).agg(F.array_sort(F.collect_list("first")).alias("__firsts"))
        begun = F.greatest(F.size(F.filter("__firsts", lambda b: b <= at)) - 1, F.lit(0))
        found = found.join(F.broadcast(nodes), [*keys, "__node"], "left").withColumn("__node", F.col("__node") * FAN + F.coalesce(begun, F.lit(0))).drop("__firsts")
    return found.withColumnRenamed("__node", "part")


def with_part(rows: DataFrame, parts: Parts | None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``part`` (0-based) and ``parts``.

    A small table of bounds is sent to every executor as an index; else the numbered narrow rows are joined by key and order, which deals a big
    key out evenly.  A row without text belongs to no numbered row; it may stand in any part and stands in the first.
    """
    if parts is None:
        return rows.withColumns({"part": F.lit(0).cast("bigint"), "parts": F.lit(1).cast("bigint")})
    found = _by_index(rows, parts, limit)
    if found is None:
        found = rows.join(parts.placed, [*parts.keys, *parts.order], "left")
    last = F.coalesce("__last", F.lit(0))
    return found.join(small_side(parts.last), parts.keys, "left").withColumns({
        "part": F.least(F.coalesce("part", F.lit(0)), last).cast("bigint"),
        "parts": (last + 1).cast("bigint"),
    }).drop("__last")


def number_parts(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    weight: Column,
    text: str,
    part_bytes: int = PART_BYTES,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``part`` and ``parts``: only keys, order and weights of rows with text are frozen and ordered."""
    narrow = freeze(rows.where(F.col(text) != "").select(*keys, *order, weight.alias("__weight")))
    return with_part(rows, number(narrow, keys, order, "__weight", part_bytes, rows_per_slice))


def concat_parts(
    numbered: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    separator: str = "",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (key, part) with the texts of the part in order: ``text``, ``parts``."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return numbered.groupBy(*keys, "part").agg(
        F.max("parts").alias("parts"),
        *[column.alias(name) for name, column in (extra or {}).items()],
        F.array_join(F.transform(items, lambda x: x["__text"]), separator).alias(text),
    )


def number_shards(rows: DataFrame, keys: list[str], spread: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``shard``: rows of a big key spread by a hash of ``spread``, for unordered collections."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("__shards"))
    shard = F.pmod(F.xxhash64(spread), F.col("__shards"))
    return rows.join(counts, keys).withColumn("shard", shard).drop("__shards")
