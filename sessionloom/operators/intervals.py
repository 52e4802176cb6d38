"""Joins and folds on time intervals, ranks over whole tables and pairs in blocks, shared by the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bounds: tuple[str, str, str, str], width: float) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys whose closed intervals meet.

    Each side is copied into the time buckets it covers, and the equi-join on
    (keys, bucket) is kept where the bucket is the first that both cover, so
    each pair appears once. ``bounds`` names left start and end, right start
    and end; these and all other columns but the keys must differ between the
    sides. An interval of n widths becomes n + 1 rows, so the width should be
    near the usual length. Null bounds match nothing.
    """
    ls, le, rs, re_ = bounds
    cut = lambda c: F.floor(F.col(c) / width)
    spread = lambda df, a, b: df.where(F.col(b) >= F.col(a)).withColumn("_bucket", F.explode(F.sequence(cut(a), cut(b))))
    joined = spread(left, ls, le).join(spread(right, rs, re_), [*keys, "_bucket"])
    first = F.greatest(cut(ls), cut(rs))
    return joined.where((F.col("_bucket") == first) & (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le))).drop("_bucket")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, before: float, after: float) -> DataFrame:
    """Pairs with equal keys and ``lt - before <= rt <= lt + after``, by buckets of the band's width."""
    width = max(before + after, 1e-3)
    near = F.sequence(F.floor((F.col(lt) - before) / width), F.floor((F.col(lt) + after) / width))
    a = left.where(F.col(lt).isNotNull()).withColumn("_bucket", F.explode(near))
    b = right.withColumn("_bucket", F.floor(F.col(rt) / width))
    return a.join(b, [*keys, "_bucket"]).where((F.col(rt) >= F.col(lt) - before) & (F.col(rt) <= F.col(lt) + after)).drop("_bucket")


def point_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, bounds: tuple[str, str], least: float = 0.25) -> DataFrame:
    """Points and the closed intervals of any length that hold them, with equal keys.

    An interval lies in the level of its own length, whose buckets are the next
    power of two, so it covers two of them at most. A point lies in one bucket
    of each level that occurs; there are as many as the lengths have doublings
    from ``least`` on. Columns but the keys must differ between the sides; null
    bounds and points match nothing.
    """
    start, end = (F.col(b) for b in bounds)
    held = intervals.where(end >= start).withColumn("_level", F.ceil(F.log2(F.greatest(end - start, F.lit(least)))).cast("int"))
    cut = lambda t, level: F.floor(t / F.pow(F.lit(2.0), level))
    spread = held.withColumn("_bucket", F.explode(F.sequence(cut(start, F.col("_level")), cut(end, F.col("_level")))))
    levels = held.agg(F.collect_set("_level").alias("_levels"))  # one row, a number for each doubling
    placed = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_bucket", cut(F.col(at), F.col("_level")))
    return placed.join(spread, [*keys, "_level", "_bucket"]).where((F.col(at) >= start) & (F.col(at) <= end)).drop("_level", "_bucket")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, order: list[str], values: list[str], strict: bool = False) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before its time (before it, if strict).

    One union and one window, so nothing but the sort depends on how many rows
    lie between. ``order`` ranks rows of ``right`` that share a time, the last
    wins.
    """
    packed = F.struct(*[F.col(v) for v in values])
    a = left.withColumn("_t", F.col(lt)).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_value", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType)).withColumn("_order", F.lit(None).cast(right.select(F.struct(*order).alias("x")).schema["x"].dataType))
    b = right.select(*keys, F.col(rt).alias("_t"), F.lit(1 if strict else 0).alias("_side"), packed.alias("_value"), F.struct(*order).alias("_order"))
    w = W.partitionBy(*keys).orderBy("_t", "_side", F.col("_order").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    both = a.withColumn("_left", F.lit(True)).unionByName(b.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    out = both.withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where("_left")
    return out.select(*left.columns, *[F.col(f"_value.{v}").alias(v) for v in values])


def in_order(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``rank``, from 1 in the given order, and running sums {name: column}.

    Ranks and sums come from range partitions and their totals, of which there
    is one row a partition, so no single task sorts the table. The ranged rows
    are written once, as their places must not change between the two passes.
    """
    sums = {"rank": "1", **(sums or {})}
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranged")
    own = W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy("_p").agg(*[F.sum(F.expr(c)).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = totals.select("_p", *[F.coalesce(F.sum(f"_t{i}").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    return ranged.join(F.broadcast(before), "_p").select(*df.columns, *[(F.sum(F.expr(c)).over(own) + F.col(f"_b{i}")).alias(name) for i, (name, c) in enumerate(sums.items())])


def in_blocks(rows: DataFrame, others: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """Each of ``rows`` with each of ``others``, which is dealt to blocks of about ``size`` rows by its key.

    An equi-join on the block: a row is copied once for each block, so any
    number of others is met, and no side needs to fit one task.
    """
    n = max(1, -(-others.count() // size))
    dealt = others.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(dealt, "_block").drop("_block")


def running_islands(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], gap: Column | None = None) -> DataFrame:
    """``df`` with ``island``: rows whose intervals touch, or come within ``gap``, share a number."""
    before = W.partitionBy(*keys).orderBy(start, *order).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy(start, *order).rowsBetween(W.unboundedPreceding, 0)
    covered = F.max(end).over(before)
    new = F.when(covered.isNull() | (F.col(start) > covered + (gap if gap is not None else F.lit(0))), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(upto)).drop("_new")
