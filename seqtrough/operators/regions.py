"""Regions: their measures, score and rank, as a table of fixed columns."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gc_percent, micro
from ..functions.params import EPSILON, MICRO, TOP_N, Params
from ..sources.scratch import written
from .segments import near, region_bounds
from .signals import LONG, Signal, whole_signals
from .signals import signals as all_signals

#: The columns of the region table that are always exported, and those exported on request, in order.
PRIMARY = (
    "Region_ID", "Start", "End", "Length", "Mean_Perplexity", "Min_Perplexity", "Max_Perplexity", "Upstream_Mean", "Region_Mean", "Downstream_Mean",
    "Perplexity_Depression_Score", "Prominence", "Persistence", "Region_Score", "GC_Content", "Motif_Count", "Motifs", "Sequence", "Rank",
)
ADVANCED = ("Variance", "Std_Dev", "CV", "AUC_PDS", "Kadane_Core_Start", "Kadane_Core_End")

#: Of a region: where it is, sums, numbers and extremes of its perplexities (d), smoothed values (q) and scores (v), and of the smoothed values of its flanks.
MEASURES = "start int, end int, n int, d_sum long, d_n long, d_min long, d_max long, q_sum long, q_n long, q_min long, v_sum long, v_n long, v_square decimal(38,0), v_positive long, up_sum long, up_n long, dn_sum long, dn_n long"


def bounds_of(v_ok: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Merged long runs of positions with a score."""
    if np.count_nonzero(v_ok) < p.min_region:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], v_ok.astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2] - 1
    keep = ends - starts + 1 >= p.min_region
    starts, ends = starts[keep], ends[keep]
    if p.max_region < p.min_region or not len(starts):
        return []
    fresh = np.concatenate([[True], starts[1:] > ends[:-1] + p.merge_gap])
    return list(zip(starts[fresh].tolist(), ends[np.concatenate([fresh[1:], [True]])].tolist()))


def measured(x: Signal, s: int, e: int, p: Params) -> tuple:
    """MEASURES of the region [s, e]."""
    n = len(x.d)

    def of(values: np.ndarray, ok: np.ndarray, a: int, b: int) -> tuple[np.ndarray, int | None, int]:
        some = values[max(a, 0) : max(b, 0)][ok[max(a, 0) : max(b, 0)]]
        return some, int(some.sum()) if len(some) else None, len(some)

    d, d_sum, d_n = of(x.d, x.d_ok, s, e + 1)
    q, q_sum, q_n = of(x.q, x.d_ok, s, e + 1)
    v, v_sum, v_n = of(x.v, x.v_ok, s, e + 1)
    high, low = v >> 12, v & 4095  # so that squares' sums stay within 64 bits
    square = Decimal((int((high * high).sum()) << 24) + (int((high * low).sum()) << 13) + int((low * low).sum())) if v_n else None
    least = lambda a, f: int(f(a)) if len(a) else None
    flanks = (of(x.q, x.d_ok, s - p.spacer - p.flank, s - p.spacer), of(x.q, x.d_ok, e + p.spacer + 1, e + p.spacer + p.flank + 1))
    return (s, e, n, d_sum, d_n, least(d, np.min), least(d, np.max), q_sum, q_n, least(q, np.min), v_sum, v_n, square, v_n, *(y for _, *f in flanks for y in f))


#: What a task adds up over its sequences by position: numbers, sums and squares' sums of perplexities and of scores.
SUMS = ("pos", "d_at", "d_total", "d_squares", "v_at", "v_total", "v_squares")
#: Sequences whose squares' sums fit 64 bits.
SQUARES = 10_000


class _Sums:
    """SUMS of one task's sequences, of at most LONG letters each."""

    def __init__(self):
        self.held, self.sums = 0, np.zeros((len(SUMS) - 1, 0), np.int64)

    def add(self, x: Signal) -> None:
        n = len(x.d)
        if n > self.sums.shape[1]:
            self.sums = np.pad(self.sums, ((0, 0), (0, n - self.sums.shape[1])))
        for to, values in zip(self.sums, (x.d_ok, x.d, x.d * x.d, x.v_ok, x.v, x.v * x.v)):
            to[:n] += values
        self.held += 1

    def told(self) -> dict[str, pa.Array]:
        return {"pos": pa.array(np.arange(self.sums.shape[1], dtype=np.int32))} | {n: pa.array(a) for n, a in zip(SUMS[1:], self.sums)}


def measured_whole(sequences: DataFrame, p: Params = Params(), summed: bool = False) -> DataFrame:
    """MEASURES of the regions of sequences that one task holds, with sequence_id, first, last and letters: from letters to regions in one pass, only regions become rows.

    Sequences of more than LONG letters are rows without measures that have them whole as their letters. ``summed``: SUMS of the others by position are rows too, with nothing else.
    """
    kind = dict(sequences.dtypes)["seq_idx"]
    schema = f"seq_idx {kind}, sequence_id string, {MEASURES}, first int, last int, letters string"
    schema += "".join(f", {n} {'int' if n == 'pos' else 'long'}" for n in SUMS) if summed else ""
    kinds_ = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "decimal(38,0)": pa.decimal128(38, 0)}
    kinds = {x.split()[0]: kinds_.get(x.split()[1]) for x in schema.split(", ")}

    def table(columns: dict, n: int) -> pa.RecordBatch:
        """``columns`` with nulls in all others."""
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    def work(batches):
        sums = _Sums()
        for batch in batches:
            kinds["seq_idx"] = batch.schema.field(0).type
            rows, seqs = [], batch.column(2)
            short = [k for k, size in enumerate(pc.binary_length(seqs).to_pylist()) if size <= LONG]
            for k, x in zip(short, whole_signals((seqs[k].as_py().encode() for k in short), p)):
                for s, e in bounds_of(x.v_ok, p):
                    seq = seqs[k].as_py()
                    last = min(len(seq) - 1, e + p.window - 1)
                    rows.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), *measured(x, s, e, p), s, last, seq[s : last + 1]))
                if summed:
                    sums.add(x)
                    if sums.held == SQUARES:
                        yield table(sums.told(), sums.sums.shape[1])
                        sums = _Sums()
            if rows:
                yield table({n: pa.array(c, kinds[n]) for n, c in zip(kinds, zip(*rows))}, len(rows))
            for k in sorted(set(range(len(seqs))) - set(short)):
                yield table({n: batch.column(j).slice(k, 1) for n, j in (("seq_idx", 0), ("sequence_id", 1), ("letters", 2))}, 1)
        if sums.held:
            yield table(sums.told(), sums.sums.shape[1])

    # A byte a letter is moved, so that few large splits of files are many tasks' work; a letter's computation costs far more. With a number of tasks it is not coalesced by bytes.
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sequences.where(F.length("seq") >= p.window).select("seq_idx", "sequence_id", "seq").repartition(tasks, "seq_idx").mapInArrow(work, schema)


def measures(signals: DataFrame, bounds: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each region with sums over its positions and flanks; sums are exact whole millionths."""
    pos, s, e = F.col("pos"), F.col("start"), F.col("end")
    inside = pos.between(s, e)
    up = (pos >= s - (p.spacer + p.flank)) & (pos < s - p.spacer)
    dn = (pos > e + p.spacer) & (pos <= e + p.spacer + p.flank)
    whole = near(signals, bounds, p.spacer + p.flank).withColumns({"d": micro(F.col("di")), "q": micro(F.col("smoothed")), "v": micro(F.col("pds"))})
    of = lambda c, where: F.when(where, F.col(c))
    square = F.col("v").cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)")
    return whole.groupBy("seq_idx", "start", "end", "n").agg(
        F.sum(of("d", inside)).alias("d_sum"), F.count(of("d", inside)).alias("d_n"), F.min(of("d", inside)).alias("d_min"), F.max(of("d", inside)).alias("d_max"),
        F.sum(of("q", inside)).alias("q_sum"), F.count(of("q", inside)).alias("q_n"), F.min(of("q", inside)).alias("q_min"),
        F.sum(of("v", inside)).alias("v_sum"), F.count(of("v", inside)).alias("v_n"), F.sum(F.when(inside, square)).alias("v_square"),
        F.count(F.when(inside & (F.col("pds") > 0), 1)).alias("v_positive"),
        F.sum(of("q", up)).alias("up_sum"), F.count(of("q", up)).alias("up_n"), F.sum(of("q", dn)).alias("dn_sum"), F.count(of("q", dn)).alias("dn_n"),
    )


def _mean(total: str | Column, n: str | Column) -> Column:
    total, n = (F.col(x) if isinstance(x, str) else x for x in (total, n))
    return F.when(n > 0, total.cast("double") / n.cast("double") / float(MICRO))


def with_letters(measured: DataFrame, sequences: DataFrame, p: Params = Params()) -> DataFrame:
    """``measured`` with sequence_id, first, last and letters: the letters from a region's first window to the end of its last.

    A sequence meets the list of its regions once and is cut in one pass, so its letters are not repeated for each region.
    """
    listed = measured.groupBy("seq_idx").agg(F.collect_list(F.struct(*(c for c in measured.columns if c != "seq_idx"))).alias("m"))
    held = sequences.select("seq_idx", "sequence_id", "seq").join(listed, "seq_idx")
    spans = F.transform("m", lambda x: F.struct(F.greatest(x["start"], F.lit(0)).cast("int").alias("first"), F.least(F.length("seq") - 1, x["end"] + (p.window - 1)).cast("int").alias("last")))
    kinds = dict(held.dtypes)

    def cut(batches):
        for batch in batches:
            letters = [[seq[x["first"] : x["last"] + 1] for x in spans] for seq, spans in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(letters, pa.list_(pa.string()))], ["seq_idx", "sequence_id", "m", "spans", "letters"])

    lists = held.withColumn("spans", spans).mapInArrow(cut, f"seq_idx {kinds['seq_idx']}, sequence_id string, m {kinds['m']}, spans array<struct<first:int,last:int>>, letters array<string>")
    rows = lists.select("seq_idx", "sequence_id", F.explode(F.arrays_zip("m", "spans", "letters")).alias("r"))
    return rows.select("seq_idx", "sequence_id", "r.m.*", "r.spans.*", "r.letters")


def described(measured: DataFrame) -> DataFrame:
    """The region table from ``measures`` with letters."""
    df = measured
    n, total = F.col("v_n").cast("decimal(19,0)"), F.col("v_sum").cast("decimal(19,0)")
    spread = (n * F.col("v_square") - total * total).cast("double") / (F.col("v_n") * F.col("v_n")).cast("double") / float(MICRO) / float(MICRO)
    variance = F.when(F.col("v_n") >= 2, spread).otherwise(0.0)
    background = _mean(F.coalesce("up_sum", F.lit(0)) + F.coalesce("dn_sum", F.lit(0)), F.col("up_n") + F.col("dn_n"))
    df = df.select("*", F.coalesce(_mean("v_sum", "v_n"), F.lit(0.0)).alias("pds_mean"), variance.alias("variance"))
    persistence = F.when(F.col("v_n") > 0, F.col("v_positive").cast("double") / F.col("v_n").cast("double")).otherwise(0.0)
    raw = F.col("pds_mean") * persistence * F.ln((F.col("end") - F.col("start") + 1).cast("double")) / (F.col("variance") + EPSILON)
    order = Window.partitionBy("seq_idx").orderBy("start")
    out = df.withColumn("Region_Score", F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.0))))
    out = out.withColumns({"number": F.row_number().over(order), "Rank": F.row_number().over(Window.partitionBy("seq_idx").orderBy(F.desc("Region_Score"), "start"))})
    std = F.sqrt("variance")
    return out.select(
        "seq_idx",
        F.format_string("LPR_%06d", "number").alias("Region_ID"),
        F.col("start").alias("Signal_Start"), F.col("end").alias("Signal_End"),
        F.col("start").alias("Kadane_Core_Start"), F.col("end").alias("Kadane_Core_End"),
        F.col("first").alias("Start"), F.col("last").alias("End"), (F.col("last") - F.col("first") + 1).alias("Length"),
        _mean("d_sum", "d_n").alias("Mean_Perplexity"), (F.col("d_min") / float(MICRO)).alias("Min_Perplexity"), (F.col("d_max") / float(MICRO)).alias("Max_Perplexity"),
        _mean("up_sum", "up_n").alias("Upstream_Mean"), _mean("q_sum", "q_n").alias("Region_Mean"), _mean("dn_sum", "dn_n").alias("Downstream_Mean"),
        F.col("pds_mean").alias("Perplexity_Depression_Score"),
        F.coalesce(F.greatest(F.lit(0.0), background - F.col("q_min") / float(MICRO)), F.lit(0.0)).alias("Prominence"),
        persistence.alias("Persistence"), F.col("variance").alias("Variance"), std.alias("Std_Dev"),
        F.when(F.abs("pds_mean") > EPSILON, std / F.abs("pds_mean")).otherwise(0.0).alias("CV"),
        F.coalesce(F.col("v_sum") / float(MICRO), F.lit(0.0)).alias("AUC_PDS"),
        gc_percent(F.col("letters")).alias("GC_Content"),
        F.lit(0).alias("Motif_Count"), F.lit("").alias("Motifs"), F.col("letters").alias("Sequence"), F.col("sequence_id").alias("Sequence_ID"),
        "Region_Score", "Rank",
    )


def by_rows(sequences: DataFrame, p: Params = Params(), chunk: int | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Measures with letters by way of a row for each position. Signals are written once and read for bounds and for measures.

    Bounds are written too: the plan knows their size, so that few of them are broadcast and signals are not shuffled for them.
    """
    rows = written(all_signals(sequences, p, chunk)) if signals is None else signals
    return with_letters(measures(rows, written(region_bounds(rows, p)), p), sequences, p)


def regions(sequences: DataFrame, p: Params = Params(), chunk: int | None = None, signals: DataFrame | None = None) -> DataFrame:
    """The ranked region table of ``sequences``.

    A sequence of at most LONG letters is worked out from letters to regions where it is. Longer ones, or all with ``chunk``, go by pieces and rows of positions, and so do ``signals`` that are given.
    Measures are written, so that ``sequences`` are read once.
    """
    if signals is not None or chunk:
        return described(by_rows(sequences, p, chunk, signals))
    return of_measured(*parted(written(measured_whole(sequences, p))), p)


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measures, and the sequences that are too long for them, of rows of ``measured_whole``."""
    some = rows.where("start is not null" if "pos" not in rows.columns else "start is not null and pos is null").drop(*SUMS)
    return some, rows.where("start is null and letters is not null").select("seq_idx", "sequence_id", F.col("letters").alias("seq"))


def of_measured(whole: DataFrame, long: DataFrame, p: Params = Params()) -> DataFrame:
    """The region table of measures and of sequences that have none yet."""
    if long.isEmpty():
        return described(whole)
    dealt = by_rows(long, p)
    return described(whole.unionByName(dealt.select(*(F.col(c).cast(t).alias(c) for c, t in whole.dtypes))))


def top(regions: DataFrame, n: int = TOP_N) -> DataFrame:
    """The first ``n`` ranks of each sequence."""
    return regions.where(F.col("Rank") <= n)


def in_order(regions: DataFrame) -> DataFrame:
    return regions.orderBy("seq_idx", "Signal_Start")


def of_sequence(regions: DataFrame, sequence_id: str) -> DataFrame:
    """Regions of the first sequence with this identifier."""
    first = regions.where(F.col("Sequence_ID") == sequence_id)
    return first.join(first.agg(F.min("seq_idx").alias("seq_idx")), "seq_idx")


def exported_columns(df: DataFrame, advanced: bool = False) -> DataFrame:
    """Sequence_ID and the primary columns, and the advanced ones if asked for; missing ones are skipped."""
    wanted = ["Sequence_ID", *PRIMARY, *(ADVANCED if advanced else [])]
    return df.select(*[c for c in wanted if c in df.columns])
