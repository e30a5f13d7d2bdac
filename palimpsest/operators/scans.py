"""Scans over a key's rows in order that don't need all of them in one task: slices, and what one slice hands to the next."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

LEAF = 1024  # steps of time that one slice of touches spans


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the key's rows up to each one; rows that tie in the order share theirs.

    Slices are range partitions of (key, order), so a key with all rows is as many tasks as there are partitions. They
    are written, as their numbers must not change. One row for each key and slice carries the sum of the slices before.
    """
    sliced = written(rows.repartitionByRange(key, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_at")).agg(F.sum(value).alias("_sum"))
    carried = sums.select("_key", "_at", F.sum("_sum").over(before).alias("_before"))
    inside = sliced.withColumn("_inside", F.sum(value).over(Window.partitionBy("_slice", key).orderBy(*order)))
    out = inside.join(carried, (F.col("_slice") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.withColumn(name, F.coalesce(F.col("_inside") + F.col("_before"), "_inside", "_before")).drop("_slice", "_inside", "_key", "_at", "_before")


def spaced(touches: DataFrame, step: int) -> DataFrame:
    """(user_id, recorded, last_recorded as microseconds) of distinct (user_id, t): a touch is recorded if it is at least ``step`` after the last recorded one.

    What happened before a slice matters by one number only, the first time x that may be recorded again, and what
    a slice makes of x changes at few touches, all in its first step of time. So a slice (LEAF steps of a user) becomes rows
    [touch, recorded, last]: for x up to that touch, so many are recorded and the last one is that. A user's slices are then
    walked in order; their number is bounded by the time that the table spans.
    """
    width = LEAF * step

    def made(column: pd.Series) -> pd.Series:
        out = []
        for times in column:
            size = len(times)
            after = times.searchsorted(times + step).tolist()
            n, last = [0] * (size + 1), list(range(size))
            for i in range(size - 1, -1, -1):  # what follows if touch i is recorded
                n[i] = n[after[i]] + 1
                last[i] = last[after[i]] if after[i] < size else i
            rows: list[list[int]] = []
            for i in range(min(size, times.searchsorted(times[0] - times[0] % width + step) + 1)):
                if rows and rows[-1][1:] == [n[i], int(times[last[i]])]:
                    rows[-1][0] = int(times[i])
                else:
                    rows.append([int(times[i]), n[i], int(times[last[i]])])
            out.append(rows)
        return pd.Series(out)

    def walked(column: pd.Series) -> pd.Series:
        out = []
        for slices in column:
            n, last = 0, None
            for rows in slices:
                at = 0 if last is None else bisect_left(rows, last + step, key=lambda r: r[0])
                if at < len(rows):
                    n, last = n + int(rows[at][1]), int(rows[at][2])
            out.append([n, last])
        return pd.Series(out)

    slice_of = F.col("t") - F.pmod("t", F.lit(width))
    slices = touches.groupBy("user_id", slice_of.alias("slice")).agg(F.sort_array(F.collect_set("t")).alias("t"))
    rows = slices.select("user_id", "slice", F.pandas_udf(made, "array<array<bigint>>")("t").alias("rows"))
    users = rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slice", "rows"))), lambda x: x["rows"]).alias("slices"))
    walk: Column = F.pandas_udf(walked, "array<bigint>")("slices")
    return users.select("user_id", walk.alias("w")).select("user_id", F.col("w")[0].alias("recorded"), F.col("w")[1].alias("last_recorded"))
