"""Window forms that Spark has no syntax for, and common patterns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weftline.sources.folders import cut


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank_name: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark cuts each group to n rows before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank_name, rank).where(F.col(rank_name) <= n)


def qualify(df: DataFrame, name: str, window: Column, keep: Column) -> DataFrame:
    """QUALIFY: filter by a window expression, which stays as a column called `name`."""
    return df.withColumn(name, window).where(keep)


def groups_frame_sum(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, name: str) -> DataFrame:
    """Adds the sum over GROUPS BETWEEN before PRECEDING AND after FOLLOWING.

    Peers are summed first, so the window sees one row for each distinct value of the order and not every row.
    """
    peers = df.groupBy(*by, order).agg(F.sum(value).alias("_sum"))
    frame = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()).rowsBetween(-before, after)
    sums = peers.select(*[F.col(c).alias(f"_{c}") for c in (*by, order)], F.sum("_sum").over(frame).alias(name))
    return df.join(sums, _same(df, [*by, order])).drop(*[f"_{c}" for c in (*by, order)])


def _same(df: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality of columns with those of another frame that have an underscore in front."""
    return functools.reduce(operator.and_, [df[c].eqNullSafe(F.col(f"_{c}")) for c in columns], F.lit(True))


def _in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with _part, their range of group and order (nulls last); kept in the shared folder, where they are cut from their lineage.

    A range holds about as many rows as the others, however many a group has; this runs when it is called.
    """
    return cut(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in (*by, *order)]).withColumn("_part", F.spark_partition_id()))


def with_positions(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's place in its group (from 0), with no group in one task.

    Rows are sorted into ranges of group and order, kept once, and numbered within their range; the
    ranges' counts, one row for each range of a group, are added up. order must tell rows apart. The rows
    are sorted and kept when this is called.
    """
    dealt = _in_ranges(df, by, order)
    keys = [*by, "_part"]
    below = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    bases = counts.select(*[F.col(c).alias(f"_{c}") for c in keys], F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    placed = dealt.withColumn("_own", F.row_number().over(within) - 1).join(bases, _same(dealt, keys))
    return placed.select(*df.columns, (F.col("_own") + F.col("_base")).alias(name))


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null up to each row of its group, with no group in one task.

    Within a range of rows a window carries it; what the ranges before leave comes from one row for each
    range of a group. order must tell rows apart. The rows are sorted and kept when this is called.
    """
    dealt = _in_ranges(df.withColumn("_value", value), by, order)
    keys = [*by, "_part"]
    ordered = [F.col(c).asc_nulls_last() for c in order]
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0))
    near = dealt.withColumn("_near", own)
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = near.groupBy(*keys).agg(F.max_by("_value", place).alias("_end"))
    below = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*[F.col(c).alias(f"_{c}") for c in keys], F.last("_end", ignorenulls=True).over(below).alias("_before"))
    return near.join(before, _same(near, keys)).select(*df.columns, F.coalesce("_near", "_before").alias(name))


def rows_frame(
    df: DataFrame, by: list[str], order: list[str], agg: Callable[[WindowSpec], Column], before: int, after: int, name: str, chunk: int = 10_000
) -> DataFrame:
    """Adds agg over ROWS BETWEEN before PRECEDING AND after FOLLOWING, for groups of any size.

    A group is cut into chunks of places; a row stands in each chunk whose frames reach it.
    """
    placed = with_positions(df, by, order, "_pos")
    low, high = (F.floor((F.col("_pos") + d) / chunk) for d in (-after, before))
    spread = placed.withColumn("_chunk", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    frame = Window.partitionBy(*by, "_chunk").orderBy("_pos").rowsBetween(-before, after)
    home = F.col("_chunk") == F.floor(F.col("_pos") / chunk)
    return spread.withColumn(name, agg(frame)).where(home).select(*df.columns, name)


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles of each group; wanted: name to ("cont" or "disc", share). Nulls don't count; a group of nulls has null.

    The rows at the places that the shares fall on are picked out of the numbered rows, so no group's
    values meet in one task.
    """
    held = df.where(F.col(value).isNotNull()).select(*by, value).withColumn("_tie", F.monotonically_increasing_id())
    placed = with_positions(held, by, [value, "_tie"], "_pos")
    sizes = placed.groupBy(*by).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in by], "_n")
    rows = placed.join(sizes, _same(placed, by))
    out = []
    for name, (kind, share) in wanted.items():
        at = F.lit(share) * (F.col("_n") - 1) if kind == "cont" else F.greatest(F.ceil(F.lit(share) * F.col("_n")) - 1, F.lit(0))
        low, high = F.floor(at), F.ceil(at)
        part = at - low
        weight = F.when(low == high, F.when(F.col("_pos") == low, 1.0)).when(F.col("_pos") == low, 1 - part).when(F.col("_pos") == high, part)
        out.append(F.sum(F.col(value) * weight).alias(name))
    found = rows.groupBy(*by).agg(*out).select(*[F.col(c).alias(f"_{c}") for c in by], *wanted)
    groups = df.select(*by).distinct()
    return groups.join(found, _same(groups, by), "left").select(*by, *wanted) if by else found


def exclude_current(total: Column, own: Column) -> Column:
    """EXCLUDE CURRENT ROW for a sum or a count over a frame that holds the current row."""
    return total - F.coalesce(own, F.lit(0))


def sessionize(df: DataFrame, by: str, time: str, gap_seconds: int, order: list[str]) -> DataFrame:
    """Adds session (from 0 for each key): a new one starts after more than gap_seconds without a row.

    Starts are found and counted within ranges of a key's rows; whether a range's first row starts a session
    and how many started before come from one row for each range of a key, so no key is in one task. Rows
    without a time come last and start nothing. The rows are sorted and kept when this is called.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    keys, most = [by, "_part"], gap_seconds * 1_000_000
    dealt = _in_ranges(df.withColumn("_at", micros), [by], [time, *order])
    within = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in (time, *order)])
    marked = dealt.withColumn("_starts", F.when(F.col("_at") - F.lag("_at").over(within) > most, 1).otherwise(0))
    ranges = marked.groupBy(*keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("_starts").alias("_n"))
    parts = Window.partitionBy(by).orderBy("_part")
    begins = F.when(F.col("_first") - F.lag("_last").over(parts) > most, 1).otherwise(0)
    earlier = F.coalesce(F.sum(F.col("_n") + F.col("_begins")).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.withColumn("_begins", begins).select(*[F.col(c).alias(f"_{c}") for c in keys], (earlier + F.col("_begins")).alias("_base"))
    so_far = F.sum("_starts").over(within.rowsBetween(Window.unboundedPreceding, 0))
    found = marked.withColumn("_so_far", so_far).join(bases, _same(marked, keys))
    return found.select(*df.columns, (F.col("_base") + F.col("_so_far")).cast("long").alias("session"))
