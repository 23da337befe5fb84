"""A population's profile kept up to date as sequences arrive.

A task adds up its sequences by position, as whole numbers; the stream's state has one row of sums for each position and merges whatever comes, so the profile does not depend on how sequences
lie in batches, and a restart goes on from its checkpoint. Every batch writes the whole profile, as long as a sequence, to a folder of its number.

The population's signal length is given. Sequences of another length are set aside and counted, never mixed in. There is no time after which a sequence is too late: it
counts when it comes. A file that is put in twice is two files, and its sequences count twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.params import Params
from ..functions.sql import letters, rows_of
from ..operators.population import SCORE_UNIT, SQUARES, _moments_of
from ..operators.signals import whole_signals
from ..sources.scratch import written

SUMS = ("d_n", "d_sum", "d_square", "v_n", "v_sum", "v_square", "regions", "score", "gc")
#: The position under which sequences are counted: those of the population as d_n, others as v_n.
COUNTS = -1


def sums(sequences: DataFrame, n_signal: int, p: Params = Params()) -> DataFrame:
    """(pos, SUMS) of what each task has of ``sequences`` (seq); memory is that of one sum by position."""
    names = ["pos", *SUMS]

    def add(batches):
        total, kept, aside = np.zeros((len(SUMS), n_signal), np.int64), 0, 0
        size = n_signal + p.window - 1

        def told():
            pos = np.concatenate([np.arange(n_signal), [COUNTS]]).astype(np.int32)
            last = np.array([kept if s == "d_n" else aside if s == "v_n" else 0 for s in SUMS])
            return pa.RecordBatch.from_arrays([pa.array(pos), *(pa.array(np.append(t, x)) for t, x in zip(total, last))], names)

        for batch in batches:
            seqs = [s for s in map(letters, batch.column(0).to_pylist()) if len(s) == size]
            aside += batch.num_rows - len(seqs)
            for seq, x in zip(seqs, whole_signals(seqs, p)):
                kept += 1
                for k, values in enumerate((x.d_ok, x.d, x.d * x.d, x.v_ok, x.v, x.v * x.v)):
                    total[k] += values
                for _, s, e, *rest in rows_of(seq, x, p):
                    score, gc = rest[-3], rest[-4]
                    for k, v in ((6, 1), (7, np.floor(score * SCORE_UNIT + 0.5)), (8, np.floor(gc * 100 + 0.5))):
                        total[k, s : e + 1] += int(v)
                if kept % SQUARES == 0:
                    yield told()
                    total, kept, aside = np.zeros_like(total), 0, 0
        if kept or aside:
            yield told()

    return sequences.select("seq").mapInArrow(add, ", ".join(["pos int", *(f"{s} long" for s in SUMS)]))


def merged(partial: DataFrame) -> DataFrame:
    """One row of sums for each position."""
    return partial.groupBy("pos").agg(*(F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in SUMS))


def profile(merged: DataFrame) -> DataFrame:
    """pos, mean_perplexity, std_perplexity, mean_pds, std_pds, lpr_frequency, mean_region_score, gc_map, and n_sequences and n_aside, alike in all rows."""
    counts = merged.where(F.col("pos") == COUNTS).select(F.col("d_n").cast("long").alias("n_sequences"), F.col("v_n").cast("long").alias("n_aside"))
    rows = merged.where((F.col("pos") >= 0)).join(F.broadcast(counts)).where("n_sequences > 0")  # one row
    long = lambda c: F.col(c).cast("long")
    n = F.when(F.col("regions") > 0, F.col("regions").cast("double"))
    told = [m for k, name in (("d", "perplexity"), ("v", "pds")) for m in _moments_of(long(f"{k}_n"), long(f"{k}_sum"), F.col(f"{k}_square"), name)]
    return rows.select(
        "pos", *told, (F.col("regions").cast("double") / F.col("n_sequences").cast("double")).alias("lpr_frequency"), F.coalesce(F.col("score").cast("double") / n / SCORE_UNIT, F.lit(0.0)).alias("mean_region_score"),
        F.coalesce(F.col("gc").cast("double") / n / 10_000.0, F.lit(0.5)).alias("gc_map"), "n_sequences", "n_aside",
    )


def stream_profile(sequences: DataFrame, path: str, checkpoint: str, n_signal: int, p: Params = Params(), once: bool = True) -> StreamingQuery:
    """Keep the profile of a streaming table (seq) under ``path``; a batch that is run again replaces its folder."""

    def batch(df: DataFrame, number: int) -> None:
        # A batch's table is worked out anew each time that it is read, and in one task if its result is to be one part: so it is written by its own tasks once.
        profile(written(df)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    writer = merged(sums(sequences, n_signal, p)).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile after the last batch."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")
