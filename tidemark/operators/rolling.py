"""Totals over trailing days for each entity, days without activity included.

Events are added up by entity and day first. The entity's calendar, from its first active day to the
end, then fills the days between: each active day brings the idle days up to the next one, so the
entity-calendar product is made by a generator inside the entity's own partition, without a cross
join and without a second shuffle. Sums over a fixed number of preceding rows are sums over days.

Rows are combined by (entity, day) before the shuffle: a hot entity has at most one row a day.

Defined cases: a null amount adds 0 and its event counts; an event without a time has no day and is
left out; a null entity is an entity of its own; events after the end day are left out; an empty
table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rolling_totals(events: DataFrame, entity: str, event_time: str, amount: str, end_day: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """(entity, day_no, day_of_entity, n, total, and for each window w: n_w, total_w, mean_w).

    day_no counts days since 1970; day_of_entity counts from 1; mean_w is total_w / w, a daily average."""
    if not windows or min(windows) < 1:
        raise ValueError("windows are positive numbers of days")
    end = F.unix_date(F.lit(end_day).cast("date"))
    daily = (
        events.select(F.col(entity).alias("__e"), F.unix_date(F.to_date(event_time)).alias("day_no"), F.col(amount).cast("long").alias("__a"))
        .where(F.col("day_no") <= end)
        .groupBy("__e", "day_no")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__a"), F.lit(0)).alias("total"))
    )
    by_day = W.partitionBy("__e").orderBy("day_no")
    upto = F.coalesce(F.lead("day_no").over(by_day) - 1, end)
    gaps = daily.withColumn("__upto", upto)
    dense = gaps.select("__e", F.col("day_no").alias("__active"), "n", "total", F.explode(F.sequence("day_no", "__upto")).alias("__day")).select(
        "__e",
        F.col("__day").alias("day_no"),
        F.when(F.col("__day") == F.col("__active"), F.col("n")).otherwise(F.lit(0)).alias("n"),
        F.when(F.col("__day") == F.col("__active"), F.col("total")).otherwise(F.lit(0)).alias("total"),
    )
    out = {"day_of_entity": F.row_number().over(by_day)}
    for w in windows:
        rows = by_day.rowsBetween(-(w - 1), 0)
        out |= {f"n_{w}": F.sum("n").over(rows), f"total_{w}": F.sum("total").over(rows)}
    full = dense.withColumns(out)
    means = {f"mean_{w}": F.col(f"total_{w}") / F.lit(w) for w in windows}
    return full.withColumns(means).withColumnRenamed("__e", entity)
