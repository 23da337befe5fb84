"""FASTA text to sequences: seq_idx, sequence_id, seq, seq_len.

``seq_idx`` tells records apart whose headers are equal, and orders them as they stand in the input. Files are read record by
record, so a file of many records is many tasks' work; records are numbered by counting them in each split of a file, and no record
is moved or sorted for it. Parsed records are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

#: Splits of files whose places every task may hold.
SPLITS = 500_000
#: Letters of records that stand in a batch.
LETTERS = 1 << 22
#: Texts that a task holds at a time.
TEXTS = 512
RECORDS = "file string, block long, k long, sequence_id string, seq string"

_KEPT = bytes.maketrans(b"U", b"T")
_DELETED = bytes(c for c in range(256) if c not in b"ACGTNU")


def records(text: str, begun: bool, default_header: str) -> Iterator[tuple[str, str]]:
    """(sequence_id, seq) of the records of ``text`` that have letters; ``begun``: its first line is a header without its mark.

    Lines are stripped and blank ones skipped. Text before the first header is discarded, a blank header becomes ``default_header``.
    """
    header, body = None, []

    def letters() -> str:
        return "".join(body).upper().encode("ascii", "ignore").translate(_KEPT, _DELETED).decode()

    for number, line in enumerate(text.splitlines() or [""]):
        line = line.strip()
        if begun and number == 0 or line.startswith(">"):
            if header is not None and (seq := letters()):
                yield header, seq
            header, body = (line if begun and number == 0 else line[1:]).strip() or default_header, []
        elif header is not None:
            body.append(line)
    if header is not None and (seq := letters()):
        yield header, seq


def _records(texts: DataFrame, default_header: str) -> DataFrame:
    """RECORDS of ``texts`` (file, block, value): a value begins a file if it is the first of block 0, else a record."""

    def parse(batches):
        place, k, out, held = None, 0, [], 0
        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                first = (file, block) != place
                place, k = (file, block), 0 if first else k
                for name, seq in records(value or "", not (first and block == 0), default_header):
                    out.append((file, block, k, name, seq))
                    k, held = k + 1, held + len(seq)
                    if held > LETTERS:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    return texts.select("file", F.col("block").cast("long"), "value").mapInArrow(parse, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORDS.split(", ")])


def parse(texts: DataFrame, default_header: str = "sequence") -> DataFrame:
    """Sequences of ``texts`` (file, value, and block where a file's text comes in parts), numbered by file, block and place."""
    texts = texts if "block" in texts.columns else texts.withColumn("block", F.lit(0))
    rows = written(_records(texts, default_header))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each split of a file
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    places = written(counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    places = F.broadcast(places) if places.count() <= SPLITS else places
    return rows.join(places, ["file", "block"]).select((F.col("base") + F.col("k")).alias("seq_idx"), "sequence_id", "seq", F.length("seq").alias("seq_len"))


def read_fasta(spark: SparkSession, path: str | list[str], whole: bool = False, default_header: str = "sequence") -> DataFrame:
    """Sequences of FASTA files, directories or globs.

    Records that begin with ``>`` in the first column after a line feed are read in parallel within a file; those with indented
    headers or other line ends are found within them. ``whole`` reads each file as one value.
    """
    if whole:
        return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), default_header)
    rows = spark.read.option("lineSep", "\n>").text(path)
    return parse(rows.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value"), default_header)


def from_text(spark: SparkSession, text: str, pasted: bool = True) -> DataFrame:
    """Sequences of a text; a pasted one without a header becomes the record ``query``."""
    if pasted and text.strip() and not text.lstrip().startswith(">"):
        text = f">query\n{text}"
    return parse(spark.createDataFrame([("text", text)], "file string, value string"))


def from_table(df: DataFrame, seq_idx: str, text: str, sequence_id: str | None = None, masked: bool = True) -> DataFrame:
    """Sequences of any table of texts, sanitised; without ``masked`` N is deleted too.

    A task does it in one pass over its texts, and no filter on what comes of it works a text out again.
    """
    deleted = _DELETED if masked else _DELETED + b"N"

    def clean(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                keys, names, texts = (c.slice(at, TEXTS) for c in batch.columns)
                seqs = [None if t is None else t.upper().encode("ascii", "ignore").translate(_KEPT, deleted) for t in texts.to_pylist()]
                sizes = pa.array([None if s is None else len(s) for s in seqs], pa.int32())
                yield pa.RecordBatch.from_arrays([keys, names, pa.array(seqs, pa.binary()).cast(pa.string()), sizes], ["seq_idx", "sequence_id", "seq", "seq_len"])

    rows = df.select(F.col(seq_idx).cast("long").alias("seq_idx"), F.col(sequence_id or seq_idx).cast("string").alias("sequence_id"), F.col(text).cast("string").alias("seq"))
    return rows.mapInArrow(clean, "seq_idx long, sequence_id string, seq string, seq_len int")


def summary(sequences: DataFrame) -> DataFrame:
    """Number of records and of bases."""
    return sequences.agg(F.count("*").alias("n_sequences"), F.coalesce(F.sum("seq_len"), F.lit(0)).cast("long").alias("total_bp"))
