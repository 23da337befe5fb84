"""Populations of sequences of equal length: profiles by position, consensus regions, occurrence, motif frequency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micro, rounded
from ..functions.params import MICRO, Params
from ..sources.scratch import written
from .motifs import Motif, with_hit_counts
from .regions import SQUARES, SUMS, measured_whole, of_measured, parted
from .segments import BUCKET, buckets, merge_intervals, runs
from .signals import LONG, PIECE, _dealt, _listed, _standing, cut, piece_signals

SUPPORT, GAP, GC_WINDOW = 0.5, 50, 21
SCORE_UNIT = 1e4
#: Positions whose sums a task holds.
HELD = 1 << 22
#: Consensus regions that a table may have as columns and every task may hold; sequences of a block of a matrix.
COLUMNS, ROWS = 5_000, 1_000


def eligible(sequences: DataFrame, window: int = 17) -> DataFrame:
    """One row: n_sequences, n_lengths, signal_length, eligible (two sequences or more, one signal length above 0)."""
    n = F.greatest(F.length("seq") - (window - 1), F.lit(0))
    df = sequences.agg(F.count("*").alias("n_sequences"), F.countDistinct(n).alias("n_lengths"), F.min(n).alias("signal_length"))
    return df.withColumn("eligible", (F.col("n_sequences") >= 2) & (F.col("n_lengths") == 1) & (F.col("signal_length") > 0))


def _moments(value: str, name: str) -> list[Column]:
    """Mean and population deviation of a signal, from exact sums of whole millionths."""
    v = micro(F.col(value))
    return _moments_of(F.count(v), F.sum(v), F.sum(v.cast("decimal(19,0)") * v.cast("decimal(19,0)")), name)


def _moments_of(n: Column, total: Column, square: Column, name: str) -> list[Column]:
    spread = (n.cast("decimal(19,0)") * square - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    mean = F.when(n > 0, total.cast("double") / n.cast("double") / float(MICRO))
    return [mean.alias(f"mean_{name}"), F.when(n > 0, F.sqrt(spread) / n.cast("double") / float(MICRO)).alias(f"std_{name}")]


def signal_profile(signals: DataFrame) -> DataFrame:
    """(pos, mean_perplexity, std_perplexity, mean_pds, std_pds)."""
    return signals.groupBy("pos").agg(*_moments("di", "perplexity"), *_moments("pds", "pds"))


def sequence_profile(sequences: DataFrame, p: Params = Params()) -> DataFrame:
    """``signal_profile`` from the sequences themselves: a task adds up its sequences by position, and only these sums become rows. Pieces of long ones are dealt out."""
    return _profile_of(_sums(sequences, p))


def _profile_of(sums: DataFrame) -> DataFrame:
    total = sums.groupBy("pos").agg(*(F.sum(F.col(n).cast("decimal(38,0)") if "square" in n else n).alias(n) for n in SUMS[1:]))
    return total.select("pos", *(m for k, name in (("d", "perplexity"), ("v", "pds")) for m in _moments_of(F.col(f"{k}_at"), F.col(f"{k}_total"), F.col(f"{k}_squares"), name)))


def _sums(sequences: DataFrame, p: Params) -> DataFrame:
    """SUMS by tasks."""
    rows = sequences.where(F.length("seq") >= p.window).select("seq_idx", "seq")
    names = list(SUMS)
    long = F.length("seq") > LONG

    def told(sums: dict[int, np.ndarray]):
        for low, a in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + a.shape[1], dtype=np.int32)), *map(pa.array, a)], names)

    def add(whole: bool):
        def of(batches):
            sums, held = {}, 0
            for some in _listed(_standing(batches, p, p.halo) if whole else _dealt(batches)):
                xs = [x for _, x in some]
                for x, y in zip(xs, piece_signals(xs, p)):
                    more = np.stack([y.d_ok, y.d, y.d * y.d, y.v_ok, y.v, y.v * y.v]).astype(np.int64)
                    old = sums.get(x.low)
                    if old is not None and old.shape[1] >= more.shape[1]:
                        old[:, : more.shape[1]] += more
                    else:
                        if old is not None:
                            more[:, : old.shape[1]] += old
                        sums[x.low] = more
                    held += 1
                    if held >= SQUARES or len(sums) * PIECE > HELD:
                        yield from told(sums)
                        sums, held = {}, 0
            yield from told(sums)

        return of

    schema = ", ".join(["pos int", *(f"{n} long" for n in names[1:])])
    return rows.where(~long).mapInArrow(add(True), schema).unionByName(cut(rows.where(long), p, PIECE).mapInArrow(add(False), schema))


def surveyed(sequences: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The region table and the ``signal_profile`` of ``sequences``, whose letters are worked out once for both: a task has regions and sums by position as its rows."""
    rows = written(measured_whole(sequences, p, summed=True))
    whole, long = parted(rows)
    sums = rows.where("pos is not null").select(*SUMS)
    if not long.isEmpty():
        sums = sums.unionByName(_sums(long, p))
    return of_measured(whole, long, p), _profile_of(sums)


def coverage(regions: DataFrame, n_signal: int) -> DataFrame:
    """(pos, n_regions, score, gc): covering regions, their mean score, and mean GC share, for covered positions.

    A sweep over the regions' ends: what a region adds where it begins it takes away behind its end. Running sums go bucket by bucket of
    positions, with the sums of all buckets before carried in, so rows are shuffled for ends of regions and buckets only. The stretch from one end to
    the next is dealt into positions last.
    """
    last = F.lit(n_signal - 1)
    s = F.greatest(F.lit(0), F.least(F.col("Signal_Start"), last))
    e = F.greatest(s, F.least(F.col("Signal_End"), last))
    score, gc = F.floor(F.col("Region_Score") * SCORE_UNIT + 0.5).cast("decimal(38,0)"), F.floor(F.col("GC_Content") * 100 + 0.5).cast("long")
    end = lambda pos, sign: F.struct(pos.cast("long").alias("pos"), F.lit(sign).cast("long").alias("n"), (score * sign).cast("decimal(38,0)").alias("s"), (gc * sign).cast("long").alias("g"))
    bucket = F.floor(F.col("pos") / BUCKET).cast("long")
    totals = [F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("g").alias("g")]
    ends = written(regions.select(F.explode(F.array(end(s, 1), end(e + 1, -1))).alias("x")).select("x.*").groupBy("pos").agg(*totals))
    buckets_ = regions.sparkSession.range(-(-n_signal // BUCKET)).select(F.col("id").alias("bucket"))
    sums = buckets_.join(ends.withColumn("bucket", bucket).groupBy("bucket").agg(*totals), "bucket", "left")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket of positions
    carried = sums.select((F.col("bucket") * BUCKET).alias("pos"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(t).alias(c) for c, t in (("n", "long"), ("s", "decimal(38,0)"), ("g", "long"))))
    rows = ends.unionByName(carried).where(F.col("pos") < n_signal).groupBy("pos").agg(*totals).withColumn("bucket", bucket)
    order = Window.partitionBy("bucket").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.least(F.coalesce(F.lead("pos").over(order), (F.col("bucket") + 1) * BUCKET), F.lit(n_signal))
    stretches = rows.select("pos", until.alias("until"), *(F.sum(c).over(upto).alias(c) for c in ("n", "s", "g"))).where("n > 0")
    n = F.col("n").cast("double")
    out = stretches.select(F.explode(F.sequence("pos", F.col("until") - 1)).alias("pos"), "n", "s", "g")
    return out.select(F.col("pos").cast("int").alias("pos"), F.col("n").alias("n_regions"), (F.col("s").cast("double") / n / SCORE_UNIT).alias("score"), (F.col("g").cast("double") / n / 10_000.0).alias("gc"))


def positions(df: DataFrame, n_signal: int) -> DataFrame:
    return df.sparkSession.range(n_signal).select(F.col("id").cast("int").alias("pos"))


def profile(signals: DataFrame, regions: DataFrame, n_sequences: int, n_signal: int) -> DataFrame:
    """A row for each position: signal_profile, lpr_frequency, mean_region_score, gc_map (0.5 where uncovered). ``signals`` may also be a signal_profile."""
    told = signals if "mean_pds" in signals.columns else signal_profile(signals)
    df = positions(signals, n_signal).join(told, "pos", "left").join(coverage(regions, n_signal), "pos", "left")
    frequency = F.coalesce(F.col("n_regions").cast("double"), F.lit(0.0)) / float(n_sequences)
    return df.select("pos", "mean_perplexity", "std_perplexity", "mean_pds", "std_pds", frequency.alias("lpr_frequency"), F.coalesce("score", F.lit(0.0)).alias("mean_region_score"), F.coalesce("gc", F.lit(0.5)).alias("gc_map"))


def window_totals(letters: bytes, low: int, high: int, first: int, size: int, half: int) -> np.ndarray:
    """G and C in the window around each position of [low, high) of a sequence of ``size`` letters, of which ``letters`` begin at ``first``; the ends are repeated outwards."""
    gc = np.isin(np.frombuffer(letters, np.uint8), list(b"GC"))
    at = np.clip(np.arange(low - half, high + half), 0, size - 1) - first
    upto = np.concatenate([[0], np.cumsum(gc[at], dtype=np.int64)])
    return upto[2 * half + 1 :] - upto[: -2 * half - 1]


def gc_profile(sequences: DataFrame, n_signal: int, window: int = GC_WINDOW) -> DataFrame:
    """(pos, mean_gc): GC share of the window around a position, ends repeated outwards, averaged over all sequences.

    Sequences are worked out piece by piece as running sums, and a task adds up all its sequences by position before anything is shuffled. Pieces of long sequences are dealt out.
    """
    half = window // 2
    rows = sequences.where("seq <> ''").select("seq")
    long = F.length("seq") > LONG

    def dealt_out(batches):
        for batch in batches:
            for seq in batch.column(0):
                letters = seq.as_py().encode()
                for low in range(0, min(len(letters), n_signal), PIECE):
                    first, high = max(0, low - half), min(low + PIECE, len(letters), n_signal)
                    part = letters[first : high + half]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (low, high, first, len(letters), part)], ["low", "high", "first", "size", "letters"])

    def told(sums: dict[int, np.ndarray]):
        for low, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(total), dtype=np.int32)), pa.array(total)], ["pos", "t"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for low, high, first, size, letters in zip(*(batch.column(k).to_pylist() for k in range(5))):
                total = window_totals(letters, low, high, first, size, half)
                if low in sums and len(sums[low]) >= len(total):
                    sums[low][: len(total)] += total
                else:
                    total[: len(sums.get(low, ()))] += sums.get(low, 0)
                    sums[low] = total
                if len(sums) * PIECE > HELD:
                    yield from told(sums)
                    sums = {}
        yield from told(sums)

    schema = "low long, high long, first long, size long, letters binary"
    short = rows.where(~long).mapInArrow(dealt_out, schema)
    dealt = rows.where(long).mapInArrow(dealt_out, schema).repartition("low", "letters")
    n = sequences.count()
    sums = short.unionByName(dealt).mapInArrow(add, "pos int, t long").groupBy("pos").agg(F.sum("t").alias("t"))
    return sums.select("pos", (F.col("t").cast("double") / float(window) / float(max(n, 1))).alias("mean_gc"))


def within(positions: DataFrame, intervals: DataFrame, start: str = "start", end: str = "end", how: str = "inner") -> DataFrame:
    """``positions`` (pos) with the intervals that hold them: an equality join on buckets, so many intervals stay linear."""
    wide = intervals.withColumn("_bucket", F.explode(buckets(F.col(start), F.col(end))))
    rows = positions.withColumn("_bucket", F.floor(F.col("pos") / BUCKET))
    inside = (rows["_bucket"] == wide["_bucket"]) & rows["pos"].between(wide[start], wide[end])
    return rows.join(wide, inside, how).drop("_bucket")


def consensus(profile: DataFrame, support: float = SUPPORT, gap: int = GAP) -> DataFrame:
    """region_id, consensus_start, consensus_end, consensus_length, support, mean_region_score, mean_pds, mean_perplexity, mean_gc."""
    high = profile.where(F.col("lpr_frequency") >= support).select(F.lit(0).alias("pop"), "pos")
    merged = merge_intervals(runs(high, ("pop",)), gap, ("pop",)).drop("pop")
    inside = within(profile, merged)
    means = inside.groupBy("start", "end").agg(*(F.avg(c).alias(c) for c in ("lpr_frequency", "mean_region_score", "mean_pds", "mean_perplexity", "gc_map")))
    number = F.row_number().over(Window.orderBy("start"))
    return means.select(
        F.format_string("CLPR_%04d", number).alias("region_id"), F.col("start").cast("int").alias("consensus_start"), F.col("end").cast("int").alias("consensus_end"),
        (F.col("end") - F.col("start") + 1).cast("int").alias("consensus_length"), rounded(F.col("lpr_frequency"), 4).alias("support"), rounded(F.col("mean_region_score"), 6).alias("mean_region_score"),
        F.coalesce(rounded(F.col("mean_pds"), 6), F.lit(0.0)).alias("mean_pds"), F.coalesce(rounded(F.col("mean_perplexity"), 4), F.lit(0.0)).alias("mean_perplexity"), rounded(F.col("gc_map") * 100, 2).alias("mean_gc"),
    )


def summary(consensus: DataFrame) -> DataFrame:
    """The consensus table under its published names."""
    names = {"region_id": "Region_ID", "consensus_start": "Consensus_Start", "consensus_end": "Consensus_End", "consensus_length": "Length", "support": "Support", "mean_pds": "Mean_PDS", "mean_region_score": "Mean_RegionScore", "mean_perplexity": "Mean_Perplexity", "mean_gc": "GC%"}
    return consensus.select(*(F.col(a).alias(b) for a, b in names.items()))


def overlaps(regions: DataFrame, consensus: DataFrame) -> DataFrame:
    """Regions with each consensus region that they overlap, met in the first bucket that both touch."""
    c = consensus.select(F.col("region_id").alias("consensus_id"), "consensus_start", "consensus_end")
    c = c.withColumn("_bucket", F.explode(buckets(F.col("consensus_start"), F.col("consensus_end"))))
    r = regions.withColumn("_bucket", F.explode(buckets(F.col("Signal_Start"), F.col("Signal_End"))))
    first = F.floor(F.greatest("Signal_Start", "consensus_start") / BUCKET)
    return r.join(c, "_bucket").where((F.col("Signal_Start") <= F.col("consensus_end")) & (F.col("Signal_End") >= F.col("consensus_start")) & (F.col("_bucket") == first)).drop("_bucket")


def numbered(consensus: DataFrame) -> DataFrame:
    """(column, region_id): the dictionary of a matrix's columns, from 0 in order of the identifiers."""
    return consensus.select((F.row_number().over(Window.orderBy("region_id")) - 1).alias("column"), "region_id")


def occurrence_blocks(sequences: DataFrame, regions: DataFrame, consensus: DataFrame) -> DataFrame:
    """(block, seq_idx, sequence_id, upto, gaps): the occurrence matrix as blocks of rows, for any number of consensus regions.

    A block has ROWS sequences or fewer. ``upto`` tells how many entries its rows have up to and with each one; ``gaps`` has for each entry, row after row, how far its column is
    beyond the row's entry before (from -1), so that most are small. Sequences without entries are rows of none. Columns are those of ``numbered``. Only overlaps are shuffled, no cell that is 0.
    """
    columns = written(numbered(consensus))
    found = overlaps(regions.select("seq_idx", "Signal_Start", "Signal_End"), consensus).select("seq_idx", F.col("consensus_id").alias("region_id")).distinct()
    columns_ = F.broadcast(columns) if columns.count() <= COLUMNS else columns
    entries = found.join(columns_, "region_id").groupBy("seq_idx").agg(F.array_sort(F.collect_list("column")).alias("held"))
    gaps = F.transform("held", lambda x, k: x - F.coalesce(F.get("held", k - 1), F.lit(-1)))
    rows = sequences.select("seq_idx", "sequence_id").join(entries.select("seq_idx", gaps.alias("gaps")), "seq_idx", "left")
    blocks = -(-sequences.count() // ROWS)
    row = F.struct("seq_idx", "sequence_id", F.coalesce("gaps", F.array().cast("array<int>")).alias("gaps"))
    packed = rows.groupBy(F.pmod(F.xxhash64("seq_idx"), F.lit(max(blocks, 1))).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    none = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"))
    ends = F.aggregate("r", none, lambda a, x: F.struct(F.array_append(a["ends"], a["n"] + F.size(x["gaps"])).alias("ends"), (a["n"] + F.size(x["gaps"])).alias("n")), lambda a: a["ends"])
    return packed.select("block", F.col("r.seq_idx").alias("seq_idx"), F.col("r.sequence_id").alias("sequence_id"), ends.alias("upto"), F.flatten("r.gaps").alias("gaps"))


def unpacked(blocks: DataFrame) -> DataFrame:
    """(seq_idx, sequence_id, held): the columns of each row's entries."""
    kind = dict(blocks.dtypes)["seq_idx"].removeprefix("array<").removesuffix(">")
    names = ["seq_idx", "sequence_id", "held"]

    def rows(batches):
        for batch in batches:
            of = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                upto, gaps = (np.array(of[c][k].values, np.int64) for c in ("upto", "gaps"))
                starts = np.concatenate([[0], upto[:-1]])
                sums = np.concatenate([[0], np.cumsum(gaps)])
                columns = sums[1:] - np.repeat(sums[starts], upto - starts) - 1
                yield pa.RecordBatch.from_arrays([of["seq_idx"][k].values, of["sequence_id"][k].values, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(columns, pa.int32()))], names)

    return blocks.mapInArrow(rows, f"seq_idx {kind}, sequence_id string, held array<int>")


def cells(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """(seq_idx, sequence_id, region_id, present): all cells of the matrix, those that are 0 too, without a join of sequences and regions: a row becomes its cells where it is."""
    n = columns.count()
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.struct(c.alias("column"), F.array_contains("held", c).cast("tinyint").alias("present"))) if n else F.array().cast("array<struct<column:int,present:tinyint>>")
    rows = unpacked(blocks).select("seq_idx", "sequence_id", F.explode(each).alias("c")).select("seq_idx", "sequence_id", "c.*")
    columns = F.broadcast(columns) if n <= COLUMNS else columns
    return rows.join(columns, "column").select("seq_idx", "sequence_id", "region_id", "present")


def occurrence(sequences: DataFrame, regions: DataFrame, consensus: DataFrame) -> DataFrame:
    """(seq_idx, sequence_id, region_id, present): 1 where a region of the sequence overlaps the consensus region."""
    held = written(consensus)
    return cells(occurrence_blocks(sequences, regions, held), written(numbered(held)))


def occurrence_matrix(occurrence: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """A row for each sequence, a column for each consensus region: at most COLUMNS of them, as Spark's tables are wide; ``occurrence_blocks`` has any number."""
    if ids is None:
        ids = sorted(r[0] for r in occurrence.select("region_id").distinct().limit(COLUMNS + 1).collect())
        if len(ids) > COLUMNS:
            raise ValueError(f"more than {COLUMNS} consensus regions: use occurrence_blocks")
    return occurrence.groupBy("seq_idx", "sequence_id").pivot("region_id", ids).agg(F.max("present"))


def occurrence_lines(blocks: DataFrame, n_columns: int, sep: str = ",") -> DataFrame:
    """(value): a line of the matrix for each sequence, its identifier first, for any number of columns."""

    def lines(batches):
        for batch in batches:
            out = []
            for name, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                row = ["0"] * n_columns
                for c in held:
                    row[c] = "1"
                quoted = name or ""
                if any(x in quoted for x in (sep, '"', "\n", "\r")):
                    quoted = '"' + quoted.replace('"', '""') + '"'
                out.append(sep.join([quoted, *row]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return unpacked(blocks).mapInArrow(lines, "value string")


def motif_frequencies(regions: DataFrame, consensus: DataFrame, motifs: list[Motif], n_sequences: int, distinct_sequences: bool = False) -> DataFrame:
    """(region_id, motif, frequency): regions with the motif that overlap a consensus region, over the number of sequences.

    A sequence with two such regions counts twice, so a frequency can exceed 1, unless ``distinct_sequences``.
    """
    df, at = with_hit_counts(regions.where("Sequence <> ''").select("seq_idx", "Signal_Start", "Signal_End", "Sequence"), motifs)
    having = df.select("seq_idx", "Signal_Start", "Signal_End", F.filter(F.transform(at, lambda n, k: F.when(n > 0, k)), lambda k: k.isNotNull()).alias("found"))
    named = F.array(*(F.lit(m) for m, _ in motifs))
    rows = overlaps(having, consensus).select("consensus_id", "seq_idx", F.explode("found").alias("k")).select("consensus_id", "seq_idx", F.struct(F.col("k"), F.get(named, F.col("k")).alias("motif")).alias("m"))
    n = F.countDistinct("seq_idx") if distinct_sequences else F.count("*")
    return rows.groupBy(F.col("consensus_id").alias("region_id"), F.col("m.motif").alias("motif")).agg(rounded(n.cast("double") / float(n_sequences), 4).alias("frequency"))
