"""Groups of rows numbered over tables sorted by range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import keep


def with_starts(df: DataFrame, order: list[str], levels: list[int]) -> DataFrame:
    """Adds start_0, start_1 ...: for groups by so many of the leading columns of the order, how many rows come before the group; and whether the
    last of these groups is this row alone.  The columns are longs that aren't null."""
    starts = [f"start_{k}" for k in range(len(levels))]
    rest = [c for c in df.columns if c not in order]
    ranged = df.select(*order, *rest).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches):
        place, last, held = 0, [None] * len(levels), None

        def out(batch, following):
            """Rows of a batch; ``following`` are the ordered columns of the row after it."""
            nonlocal place
            columns = [batch.column(c).to_numpy() for c in order]
            n, added = len(columns[0]), []
            for k, level in enumerate(levels):
                new = np.ones(n, bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:level]])
                now = [int(c[0]) for c in columns[:level]]
                new[0] = last[k] is None or last[k][0] != now
                begin = np.maximum.accumulate(np.where(new, np.arange(place, place + n), 0))
                if not new[0]:
                    begin[: np.argmax(new) if new.any() else n] = last[k][1]
                last[k] = ([int(c[-1]) for c in columns[:level]], int(begin[-1]))
                added.append(begin)
            same_next = following is not None and following[: levels[-1]] == last[-1][0]
            alone = new & np.append(new[1:], not same_next)
            place += n
            return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added), pa.array(alone)], [*batch.schema.names, *starts, "alone"])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield out(held, [batch.column(c)[0].as_py() for c in order])
                held = batch
        if held is not None:
            yield out(held, None)

    kind = lambda f: f"`{f.name}` {f.dataType.simpleString()}"
    schema = ", ".join([*map(kind, ranged.schema), *(f"{c} long" for c in starts), "alone boolean"])
    local = keep(ranged.mapInArrow(run, schema))
    key = F.struct(*order)
    by_part = local.groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"), *(F.max(c).alias(f"last_{c}") for c in starts))
    along = Window.orderBy("part")  # a row for each range
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("previous", F.lag("last").over(along)).withColumn("next", F.lead("first").over(along))
    same = lambda a, b, level: F.coalesce(F.array(*(F.col(f"{a}.{c}") for c in order[:level])) == F.array(*(F.col(f"{b}.{c}") for c in order[:level])), F.lit(False))
    for c, level in zip(starts, levels):
        parts = parts.withColumn(f"on_{c}", same("first", "previous", level))
        begun = F.when(~(F.col(f"on_{c}") & (F.col(f"last_{c}") == 0)), F.col("base") + F.col(f"last_{c}"))
        parts = parts.withColumn(f"head_{c}", F.when(F.col(f"on_{c}"), F.last(begun, ignorenulls=True).over(before)).otherwise(F.col("base")))
    parts = parts.withColumn("goes_on", same("last", "next", levels[-1])).drop("n", "first", "last", "previous", "next")
    final = starts[-1]
    joined = local.join(F.broadcast(parts), "part")
    at_ends = ((F.col(final) == 0) & F.col(f"on_{final}")) | ((F.col(final) == F.col(f"last_{final}")) & F.col("goes_on"))
    whole = [F.when(F.col(c) == 0, F.col(f"head_{c}")).otherwise(F.col("base") + F.col(c)).alias(c) for c in starts]
    return joined.select(*order, *rest, *whole, (F.col("alone") & ~at_ends).alias("alone"))
