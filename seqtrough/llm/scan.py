"""Running sums within keys over rows in order, in two levels: a key of any size is dealt out over many tasks.

Rows are dealt by ranges of key and order and sorted within; each task sums up what it holds and the result is written with its
task's number. What a task's last key has so far, a row for each task, is carried into the tasks after it that go on with that
key, and added in a second pass. No task holds more than its range, and only rows of one key that are alike in the whole order stay together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def upto(df: DataFrame, key: str, order: list[str], totals: list[str]) -> DataFrame:
    """``df`` with a column upto_x for each long column x of ``totals``: its sum over the rows of the key up to and with this one.

    The key is a long column without nulls; nulls come first in the order, rows alike in all of it in any order.
    """
    kinds = dict(df.dtypes)
    names = df.columns
    more = [f"upto_{t}" for t in totals]

    def local(batches):
        task, before, at, last = TaskContext.get().partitionId(), np.zeros(len(totals), np.int64), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            group = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))  # the group's first row, -1 for one that goes on
            out = []
            for k, t in enumerate(totals):
                sums = np.concatenate([[0], np.cumsum(pc.fill_null(batch.column(names.index(t)), 0).to_numpy(zero_copy_only=False))])
                out.append(sums[1:] - np.where(group >= 0, sums[group], -before[k]))
            before, last = np.array([x[-1] for x in out]), keys[-1]
            rows = np.arange(at, at + len(keys))
            at += len(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out), pa.array(np.full(len(keys), task, np.int32)), pa.array(rows)], [*names, *more, "_task", "_row"])

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), *(f"{m} long" for m in more), "_task int", "_row long"])
    sorted_ = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = stored(sorted_.mapInArrow(local, schema))
    tasks = rows.groupBy("_task").agg(F.min_by(key, "_row").alias("first"), F.max_by(F.struct(F.col(key).alias("last"), *more), "_row").alias("end"))
    starts = tasks.select(F.col("first").alias(key), "_task", F.lit(0).alias("_ends"), *(F.lit(0).cast("long").alias(m) for m in more))
    ends = tasks.select(F.col("end.last").alias(key), "_task", F.lit(1).alias("_ends"), *(F.col(f"end.{m}") for m in more))
    earlier = Window.partitionBy(key).orderBy("_task", "_ends").rowsBetween(Window.unboundedPreceding, -1)
    carries = starts.unionByName(ends).withColumns({f"_{m}": F.sum(m).over(earlier) for m in more}).where("_ends = 0")
    carries = F.broadcast(carries.select(key, "_task", *(f"_{m}" for m in more)))  # a row for each task of the shuffle
    out = rows.join(carries, [key, "_task"], "left")
    return out.select(*(f"`{n}`" for n in names), *((F.col(m) + F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in more))
