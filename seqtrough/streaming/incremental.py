"""Regions of sequences as they arrive: every record stands for itself, so a stream is analysed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.params import Params
from ..operators.motifs import Motif, annotate
from ..operators.regions import regions


def stream_regions(sequences: DataFrame, path: str, checkpoint: str, p: Params = Params(), motifs: list[Motif] = (), once: bool = True) -> StreamingQuery:
    """Write the regions of a streaming table (seq_idx, sequence_id, seq) to Parquet under ``path``.

    Each batch goes to a folder of its own number and replaces it when it is run again, so a restart from
    ``checkpoint`` neither loses nor repeats regions.
    """

    def batch(df: DataFrame, number: int) -> None:
        annotate(regions(df, p), list(motifs)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = sequences.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
