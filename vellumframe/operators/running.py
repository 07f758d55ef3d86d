"""Running values along an order, spread over ranges of it, so that no group and no table is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stage

Values = dict[str, Column]


def along(df: DataFrame, group: list[str], order: list[str | Column], before: Values | None = None, last: Values | None = None, following: Values | None = None, total: Values | None = None) -> DataFrame:
    """df with added columns: `before`, the sum of a value over the rows of the group before this one; `last`, the value of
    the last row up to this one that has one; `following`, that of the first row from this one on; `total`, the sum over
    the group.

    `order` puts the rows of a group in full order (names, ascending, where `last` or `following` are asked for); an empty
    group list makes the table one group. Rows are dealt to ranges of (group, order), so a group of any size is spread
    over as many tasks as its share asks for; windows hold one range of one group, and what the ranges of a group add up
    to, a row each, is carried from one to the next; a group that lies in one range needs no such row.
    """
    before, last, following, total = before or {}, last or {}, following or {}, total or {}
    names = {k: f"_along_{kind}{i}" for kind, d in (("b", before), ("l", last), ("f", following), ("t", total)) for i, k in enumerate(d)}
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df.repartitionByRange(max(1, ranges), *group, *order).withColumn("_along_range", F.spark_partition_id()), "ranges")
    key = F.struct(*order) if last or following else None
    known = lambda c: F.when(c.isNotNull(), key)
    sums = [F.sum(c).alias(names[k]) for k, c in (before | total).items()] + [F.max_by(c, known(c)).alias(names[k]) for k, c in last.items()] + [F.min_by(c, known(c)).alias(names[k]) for k, c in following.items()]
    parts = rows.groupBy("_along_range", *group).agg(*sums)
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(True))
    ahead, behind = over.orderBy("_along_range").rowsBetween(Window.unboundedPreceding, -1), over.orderBy("_along_range").rowsBetween(1, Window.unboundedFollowing)
    carried = [F.coalesce(F.sum(names[k]).over(ahead), F.lit(0)).alias(names[k]) for k in before] + [F.last(names[k], ignorenulls=True).over(ahead).alias(names[k]) for k in last]
    carried += [F.first(names[k], ignorenulls=True).over(behind).alias(names[k]) for k in following] + [F.sum(names[k]).over(over).alias(names[k]) for k in total]
    several = F.count("*").over(over).alias("_along_n")
    parts = parts.select(F.col("_along_range").alias("_along_at"), *[F.col(g).alias(f"_along_g{i}") for i, g in enumerate(group)], *carried, several)
    # only a group in several ranges carries anything: the first and the last one of a range, so at most two rows a range
    parts = F.broadcast(parts.filter("_along_n > 1").drop("_along_n"))
    same = rows["_along_range"] == parts["_along_at"]
    for i, g in enumerate(group):
        same = same & rows[g].eqNullSafe(parts[f"_along_g{i}"])
    inside = Window.partitionBy("_along_range", *group).orderBy(*order)
    up, to, on = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    own = {f"{names[k]}x": F.coalesce(F.sum(c).over(up), F.lit(0)) for k, c in before.items()} | {f"{names[k]}x": F.last(c, ignorenulls=True).over(to) for k, c in last.items()}
    own |= {f"{names[k]}x": F.first(c, ignorenulls=True).over(on) for k, c in following.items()}
    own |= {f"{names[k]}x": F.sum(c).over(Window.partitionBy("_along_range", *group)) for k, c in total.items()}
    joined = (rows.withColumns(own) if own else rows).join(parts, same, "left")
    out = [(F.col(f"{names[k]}x") + F.coalesce(names[k], F.lit(0))).alias(k) for k in before] + [F.coalesce(f"{names[k]}x", names[k]).alias(k) for k in last] + [F.coalesce(f"{names[k]}x", names[k]).alias(k) for k in following]
    return joined.select(*[F.col(c) for c in df.columns if c not in names], *out, *[F.coalesce(names[k], f"{names[k]}x").alias(k) for k in total])
