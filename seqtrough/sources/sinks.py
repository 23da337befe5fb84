"""Region tables to files: CSV, TSV, JSON, XLSX, BED, GFF, FASTA. Writers make a folder of parts; ``single`` makes one part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.population import occurrence_lines
from ..operators.regions import exported_columns


def write_table(regions: DataFrame, path: str, fmt: str = "csv", advanced: bool = False, single: bool = False, every_column: bool = False, by_sequence: bool = False) -> None:
    """csv, tsv, json (a record a line), json_array (the parts together are one array) or xlsx (a workbook of each part)."""
    df = regions if every_column else exported_columns(regions, advanced)
    df = df.coalesce(1) if single else df
    if by_sequence and not single:  # a folder costs far more than its bytes, by which tasks would be few
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "Sequence_ID")
    writer = df.write.mode("overwrite")
    if by_sequence:  # each task moves its own folders into place, not the driver those of all
        writer = writer.partitionBy("Sequence_ID").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    if fmt.lower() == "csv":
        writer.option("header", True).csv(path)
    elif fmt.lower() == "tsv":
        writer.option("header", True).option("sep", "\t").csv(path)
    elif fmt.lower() == "json":
        writer.json(path)
    elif fmt.lower() in ("json_array", "xlsx"):
        from .formats import register

        register(df.sparkSession)
        writer.format(fmt.lower()).save(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def four(x: str | Column) -> Column:
    """A number with four digits after the point, from whole ten-thousandths, so that every engine writes the same."""
    x = F.col(x) if isinstance(x, str) else x
    v = F.floor(x * 10_000.0 + 0.5).cast("long")
    size = F.abs(v)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.floor(size / 10_000).cast("string"), F.lit("."), F.lpad((size % 10_000).cast("string"), 4, "0"))


def bed(regions: DataFrame) -> DataFrame:
    """Sequence_ID, Start, End + 1, Region_ID, Region_Score."""
    return regions.select("Sequence_ID", "Start", (F.col("End") + 1).alias("End"), "Region_ID", "Region_Score")


def fasta_lines(regions: DataFrame) -> DataFrame:
    """A column value: header and sequence of each region."""
    head = F.concat(F.lit(">"), "Region_ID", F.lit("|"), "Sequence_ID", F.lit(":"), F.col("Start"), F.lit("-"), F.col("End"), F.lit("|Region_Score="), four("Region_Score"))
    return regions.select(F.concat_ws("\n", head, "Sequence").alias("value"))


def gff_lines(regions: DataFrame, source: str = "seqtrough", kind: str = "low_perplexity_region", escape: bool = False) -> DataFrame:
    """A column value: nine tab-separated fields, 1-based. ``escape`` encodes what attributes reserve."""
    motifs: Column = F.col("Motifs")
    if escape:
        for a, b in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C")):
            motifs = F.replace(motifs, F.lit(a), F.lit(b))
    named = [("ID", F.col("Region_ID")), *((c, four(c)) for c in ("Region_Score", "Perplexity_Depression_Score", "Persistence", "Prominence")), ("Motifs", motifs)]
    attributes = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in named))
    dot = F.lit(".")
    return regions.select(F.concat_ws("\t", "Sequence_ID", F.lit(source), F.lit(kind), (F.col("Start") + 1).cast("string"), (F.col("End") + 1).cast("string"), four("Region_Score"), dot, dot, attributes).alias("value"))


def write_lines(lines: DataFrame, path: str, header: str | None = None, single: bool = False) -> None:
    """Text; ``header`` (such as ``##gff-version 3``) is the first line of the first part. ``single`` makes one part."""
    if header:
        lines = lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).unionByName(lines)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_bed(regions: DataFrame, path: str, single: bool = False) -> None:
    df = bed(regions)
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", "\t").csv(path)


def write_occurrence(matrix: DataFrame, path: str, fmt: str = "csv", single: bool = False) -> None:
    """The occurrence matrix, the sequence first: a workbook for xlsx, tab-separated for tsv, else commas."""
    df = matrix.drop("seq_idx")
    if fmt.lower() == "xlsx":
        return write_table(df, path, fmt, single=single, every_column=True)
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", "\t" if fmt.lower() == "tsv" else ",").csv(path)


def write_occurrence_blocks(blocks: DataFrame, columns: DataFrame, path: str, fmt: str = "csv") -> None:
    """The matrix of ``occurrence_blocks`` with a column for each row of ``columns`` (column, region_id), however many: a header part, and lines of a task each."""
    sep = "\t" if fmt.lower() == "tsv" else ","
    ids = [r[0] for r in columns.orderBy("column").select("region_id").toLocalIterator()]  # the header is one line
    write_framed(occurrence_lines(blocks, len(ids), sep), path, sep.join(["sequence_id", *ids]))


def write_framed(lines: DataFrame, path: str, header: str) -> None:
    """Lines (value) in parts, ``header`` in the first one."""
    from .formats import register

    register(lines.sparkSession)
    lines.write.format("lines").option("header", header).mode("overwrite").save(path)
