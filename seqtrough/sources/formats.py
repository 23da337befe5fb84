"""FASTA, GFF and BED as Spark data sources: ``spark.read.format("fasta").load(path)``, after ``register(spark)``.

A file is read in planned splits of bytes, and a record or line belongs to the split in which it begins, so that one large file is
many tasks' work; a compressed one (``.gz``) is one task's. As a stream, files come in order of time and name, and an offset is
the last file's: a restart reads the same files again. Equality filters on the name column are taken into the reader, so that
other records are skipped before they are built.

Writers make each task's file in a folder of its own job. The commit moves the files of successful tasks into place, in order of their
partitions, puts the one header into a part before them and removes the job's folder with all that failed and repeated attempts left;
until then nothing stands under the path. An overwrite removes the old parts only once the new ones are complete, an append goes on with their numbers.

Paths are local or URIs that pyarrow opens (file, s3, gs, hdfs); files, folders and globs are read, several separated by commas.
Names that begin with a dot or an underscore are passed over.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .fasta import records
from .sinks import four

SPLIT = 64 << 20
#: Characters of the texts of a batch, and its rows.
LETTERS, ROWS = 1 << 22, 1 << 14

FASTA = "sequence_id string, seq string, file string, start long"
GFF = "seqid string, source string, type string, start long, end long, score double, strand string, phase string, attributes map<string,string>"
BED = "chrom string, start long, end long, name string, score double"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(paths: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of the files that ``paths`` name, in order of path. A path names what is under it or, with ``*`` or ``?``, what matches."""
    found = []
    for path in filter(None, map(str.strip, paths.split(","))):
        store, at = opened(path)
        scheme = path.split("://")[0] + "://" if "://" in path and not isinstance(store, fs.LocalFileSystem) else ""
        pattern = any(c in at for c in "*?[")
        base = at[: min(at.index(c) for c in "*?[" if c in at)].rpartition("/")[0] or "/" if pattern else at
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            if pattern:
                continue
            raise FileNotFoundError(path)
        inside = store.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
        for x in inside:
            hidden = any(p[:1] in "._" for p in x.path[len(base) :].split("/") if p)
            if x.type == fs.FileType.File and not hidden and (not pattern or fnmatch.fnmatch(x.path, at) or fnmatch.fnmatch(x.path, f"{at}/*")):
                found.append((scheme + x.path, x.size, x.mtime_ns or 0))
    return sorted(set(found))


@dataclass
class Split(InputPartition):
    """The records of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


def splits(files: list[tuple[str, int, int]], size: int) -> list[Split]:
    out = []
    for path, n, _ in files:
        if path.endswith(".gz"):
            out.append(Split(path, 0, 1 << 62))
        else:
            out += [Split(path, at, min(at + size, n)) for at in range(0, n, size)]
    return out


def lines(split: Split) -> Iterator[tuple[int, bytes]]:
    """Lines, with their places, from the first one that begins in the split; on beyond its end as long as they are asked for."""
    store, at = opened(split.path)
    with store.open_input_file(at) as raw:
        file = gzip.GzipFile(fileobj=raw) if at.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
        if split.start:
            file.seek(split.start - 1)
            file.readline()
        place = file.tell()
        for line in iter(file.readline, b""):
            yield place, line
            place += len(line)


def fasta_texts(split: Split) -> Iterator[tuple[int, str]]:
    """Place and text of each record of a split, from its header line up to the next one."""
    begun, body = 0, []
    for place, line in lines(split):
        if line.lstrip().startswith(b">") or not body and b">" in line:
            if body:
                yield begun, b"".join(body).decode("utf-8", "replace")
            body = []
            if place >= split.end:
                return
            begun, body = place, [line]
        elif body:
            body.append(line)
        elif place >= split.end:
            return
    if body:
        yield begun, b"".join(body).decode("utf-8", "replace")


def fasta_rows(split: Split, wanted: set[str] | None, header: str) -> Iterator[tuple]:
    for place, text in fasta_texts(split):
        if wanted is not None and "\r" not in text and text.partition("\n")[0].strip()[1:].strip() not in wanted - {header}:
            continue
        for k, (name, seq) in enumerate(records(text, False, header)):
            if wanted is None or name in wanted:
                yield name, seq, split.path, place + k


def _own(split: Split) -> Iterator[str]:
    for place, line in lines(split):
        if place >= split.end:
            return
        yield line.decode("utf-8", "replace").rstrip("\r\n")


def gff_rows(split: Split, wanted: set[str] | None) -> Iterator[tuple]:
    for line in _own(split):
        if line.startswith("#") or "\t" not in line:  # comments, and the letters of a FASTA section
            continue
        fields = line.split("\t")
        if len(fields) != 9:
            raise ValueError(f"{split.path}: {len(fields)} fields instead of 9: {line[:200]!r}")
        if wanted is not None and unquote(fields[0]) not in wanted:
            continue
        none = lambda x: None if x == "." else x
        parts = (x.partition("=") for x in fields[8].split(";") if x.strip() and x != ".")
        yield (*(none(unquote(x)) for x in fields[:3]), int(fields[3]), int(fields[4]), None if fields[5] == "." else float(fields[5]), none(fields[6]), none(fields[7]), [(unquote(k.strip()), unquote(v)) for k, _, v in parts])


def bed_rows(split: Split, wanted: set[str] | None) -> Iterator[tuple]:
    for line in _own(split):
        if not line.strip() or line.startswith(("#", "track", "browser")) and "\t" not in line:
            continue
        chrom, start, end, *more = line.split("\t")
        if wanted is None or chrom in wanted:
            yield chrom, int(start), int(end), more[0] if more and more[0] != "." else None, float(more[1]) if len(more) > 1 and more[1] != "." else None


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size > LETTERS or len(held) >= ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Files:
    """What a batch reader and a stream reader have in common."""

    def __init__(self, source: "FileSource", schema: StructType):
        self.rows, self.schema, self.name = source.rows, to_arrow_schema(schema), source.name_column
        self.path, self.size = source.options["path"], int(source.options.get("splitBytes", SPLIT))
        self.header = source.options.get("defaultHeader", "sequence")
        self.wanted: set[str] | None = None

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        more = (self.header,) if self.rows is fasta_rows else ()
        return batches(self.rows(partition, self.wanted, *more), self.schema)


class _Reader(_Files, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.name,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Split]:
        return splits(listed(self.path), self.size) or [Split("", 0, 0)]

    def read(self, partition: Split):
        return super().read(partition) if partition.path else iter(())


class _Stream(_Files, DataSourceStreamReader):
    """Whole files as they come. A file is not read again if it changes; it must be complete when it appears under its name."""

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def _after(self, offset: dict) -> list[tuple[int, str, int]]:
        return sorted((t, p, n) for p, n, t in listed(self.path) if (t, p) > (offset["time"], offset["name"]))

    def latestOffset(self) -> dict:
        found = sorted((t, p) for p, _, t in listed(self.path))
        return {"time": found[-1][0], "name": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits([(p, n, t) for t, p, n in self._after(start) if (t, p) <= (end["time"], end["name"])], self.size)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str | None


class Writer(DataSourceWriter):
    """A file of each task that has rows, moved into place at the commit. The job's folder is made before any task runs: one that outlives the job finds none.

    ``body`` writes a task's rows to a stream. ``frame`` are lines before, between and after the tasks' files, which become parts of their own, so that the parts one after another are one document.
    """

    def __init__(self, path: str, suffix: str, frame: tuple[str, str, str], body, overwrite: bool):
        self.path, self.suffix, self.frame, self.body, self.overwrite = path, suffix, frame, body, overwrite
        self.job = f"_job-{uuid.uuid4().hex}"
        store, at = opened(path)
        store.create_dir(f"{at}/{self.job}", recursive=True)

    def write(self, iterator) -> Written:
        context = TaskContext.get()
        store, at = opened(self.path)
        first = next(iterator, None)
        if first is None:
            return Written(context.partitionId(), None)
        made = f"{at}/{self.job}/{context.partitionId():06d}-{context.taskAttemptId()}"
        with store.open_output_stream(made) as out:
            self.body(out, (r for some in ((first,), iterator) for r in some))
        return Written(context.partitionId(), made)

    def commit(self, messages) -> None:
        store, at = opened(self.path)
        old = [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File]
        parts = sorted(x for x in old if os.path.basename(x).startswith("part-"))
        go_on = bool(parts) and not self.overwrite
        if go_on and (self.frame[1] or self.frame[2]):
            raise ValueError("a document of one frame cannot be appended to")
        first = int(os.path.basename(parts[-1])[5:11]) + 1 if go_on else 0
        ready = [m.path for m in sorted((m for m in messages if m and m.path), key=lambda m: m.partition)]
        if self.frame[1]:
            ready = [x for k, path in enumerate(ready) for x in ((self._line(store, at, k, self.frame[1]), path) if k else (path,))]
        ready = [self._line(store, at, "before", self.frame[0])] * bool(self.frame[0] and not go_on) + ready + [self._line(store, at, "after", self.frame[2])] * bool(self.frame[2])
        if self.overwrite:
            for x in old:
                store.delete_file(x)
        for k, x in enumerate(ready):
            store.move(x, f"{at}/part-{first + k:06d}{self.suffix}")
        self._clear()
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def _line(self, store: fs.FileSystem, at: str, name, text: str) -> str:
        if text:
            with store.open_output_stream(f"{at}/{self.job}/line-{name}") as out:
                out.write(text.encode())
        return f"{at}/{self.job}/line-{name}"

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = opened(self.path)
        if store.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.job}")


def _text(x) -> str:
    return "." if x is None else f"{x:.10g}" if isinstance(x, float) else str(x)


def lines_body(line_of, between: str = ""):
    """A writer's body: the text of each row, and ``between`` two of them."""

    def body(out, rows) -> None:
        held, first = [], True
        for row in rows:
            held.append(line_of(row) if first else between + line_of(row))
            first = False
            if len(held) >= 1024:
                out.write("".join(held).encode("utf-8", "surrogatepass"))
                held = []
        out.write("".join(held).encode("utf-8", "surrogatepass"))

    return body


def fasta_line(width: int):
    def of(row) -> str:
        name, seq = (str(row[c] or "") for c in ("sequence_id", "seq"))
        step = width or max(1, len(seq))
        return f">{' '.join(name.splitlines())}\n" + "".join(f"{seq[k : k + step]}\n" for k in range(0, len(seq), step))

    return of


def gff_line(row) -> str:
    """Nine fields; what the format reserves is written as per cent and two digits."""
    given = row.asDict()
    name = lambda c: "." if given.get(c) is None else quote(str(given[c]), safe=" !\"#$'()*+,-./:<=>?@[\\]^_`{|}~|")
    inner = lambda x: quote(str(x), safe=" !\"#$'()*+-./:<>?@[\\]^_`{|}~|")
    attributes = ";".join(f"{inner(k)}={inner('' if v is None else v)}" for k, v in (given.get("attributes") or {}).items())
    return "\t".join([name("seqid"), name("source"), name("type"), _text(given.get("start")), _text(given.get("end")), _text(given.get("score")), _text(given.get("strand")), _text(given.get("phase")), attributes or "."]) + "\n"


def bed_line(row) -> str:
    given = row.asDict()
    return "\t".join(_text(given.get(c)) for c in ("chrom", "start", "end", "name", "score")) + "\n"


class FileSource(DataSource):
    """A format of files: its columns, how a split becomes rows, and how rows become a file."""

    columns, name_column, suffix = "", "", ""
    rows = staticmethod(lambda split, wanted: iter(()))

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self, schema)

    def frame(self) -> tuple[str, str, str]:
        return "", "", ""

    def body(self, schema: StructType):
        raise NotImplementedError

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], self.suffix, self.frame(), self.body(schema), overwrite)


class FastaSource(FileSource):
    """sequence_id, seq, file and the place of the record in it. Options: splitBytes, defaultHeader, lineWidth (0: sequences in one line)."""

    columns, name_column, suffix, rows = FASTA, "sequence_id", ".fa", staticmethod(fasta_rows)

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def body(self, schema: StructType):
        return lines_body(fasta_line(int(self.options.get("lineWidth", 60))))


class GffSource(FileSource):
    """The nine columns of GFF3, attributes as a map. Options: splitBytes, version (3, or empty for no header)."""

    columns, name_column, suffix, rows = GFF, "seqid", ".gff3", staticmethod(gff_rows)

    @classmethod
    def name(cls) -> str:
        return "gff"

    def frame(self) -> tuple[str, str, str]:
        version = self.options.get("version", "3")
        return f"##gff-version {version}\n" if version else "", "", ""

    def body(self, schema: StructType):
        return lines_body(gff_line)


class BedSource(FileSource):
    """chrom, start, end, name, score; no header. Option: splitBytes."""

    columns, name_column, suffix, rows = BED, "chrom", ".bed", staticmethod(bed_rows)

    @classmethod
    def name(cls) -> str:
        return "bed"

    def body(self, schema: StructType):
        return lines_body(bed_line)


def line_rows(split: Split, wanted: set[str] | None) -> Iterator[tuple]:
    return ((line,) for line in _own(split))


def line_of(row) -> str:
    return f"{row[0] or ''}\n"


class LinesSource(FileSource):
    """value, a line each. Options: splitBytes, header (a first part of its own)."""

    columns, name_column, suffix, rows = "value string", "value", ".txt", staticmethod(line_rows)

    @classmethod
    def name(cls) -> str:
        return "lines"

    def frame(self) -> tuple[str, str, str]:
        header = self.options.get("header", "")
        return f"{header}\n" if header else "", "", ""

    def body(self, schema: StructType):
        return lines_body(line_of)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, those of ``documents`` with them; filters reach them."""
    from .documents import JsonArraySource, XlsxSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaSource, GffSource, BedSource, LinesSource, JsonArraySource, XlsxSource):
        spark.dataSource.register(source)


def gff_of(regions: DataFrame, source: str = "seqtrough", kind: str = "low_perplexity_region") -> DataFrame:
    """Regions as rows of the ``gff`` format, 1-based; attributes are the identifier, the scores with four digits, and the motifs."""
    named = [F.lit("ID"), F.col("Region_ID"), *(x for c in ("Region_Score", "Perplexity_Depression_Score", "Persistence", "Prominence") for x in (F.lit(c), four(c))), F.lit("Motifs"), F.col("Motifs")]
    none = F.lit(None).cast("string")
    return regions.select(
        F.col("Sequence_ID").alias("seqid"), F.lit(source).alias("source"), F.lit(kind).alias("type"), (F.col("Start") + 1).cast("long").alias("start"), (F.col("End") + 1).cast("long").alias("end"),
        four("Region_Score").cast("double").alias("score"), none.alias("strand"), none.alias("phase"), F.create_map(*named).alias("attributes"),
    )


def bed_of(regions: DataFrame) -> DataFrame:
    """Regions as rows of the ``bed`` format, the end beyond the last letter."""
    return regions.select(F.col("Sequence_ID").alias("chrom"), F.col("Start").cast("long").alias("start"), (F.col("End") + 1).cast("long").alias("end"), F.col("Region_ID").alias("name"), four("Region_Score").cast("double").alias("score"))
