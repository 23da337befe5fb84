"""The tables behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import Params
from ..operators.population import within

LENGTH_BINS = SCORE_BINS = 40
BOUNDARY_BINS = 60


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, low, high, n): equal bins from least to greatest value; empty bins are absent."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / float(bins)).otherwise(1.0)
    placed = v.join(F.broadcast(ends.select("lo", width.alias("w"))))  # one row
    k = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    return placed.groupBy(k.alias("bin"), "lo", "w").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def round_size(spread: Column, bins: int) -> Column:
    """The least of 1, 2 and 5 times a power of ten (for whole numbers at least 1) of which ``bins`` hold ``spread``; 1 if there is none."""
    rough = spread / float(bins)
    powers = F.array(*(F.lit(float(f"{m}e{k}")) for k in range(-6, 16) for m in (1, 2, 5)))
    return F.when(spread > 0, F.coalesce(F.get(F.filter(powers, lambda x: x >= rough), F.lit(0)), spread)).otherwise(1.0)


def round_histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, low, high, n): bins of a round size that begin at its multiples, as many as there need be but ``bins`` + 1 at most; empty bins are absent.

    Least and greatest value, which merge from any parts, choose the size.
    """
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select("lo", round_size(F.col("hi") - F.col("lo"), bins).alias("w"))
    placed = v.join(F.broadcast(ends))  # one row
    at = F.floor(F.col("v") / F.col("w"))
    first = F.floor(F.col("lo") / F.col("w"))
    counted = placed.groupBy((at - first).cast("int").alias("bin"), at.alias("at"), "w").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("at") * F.col("w")).alias("low"), ((F.col("at") + 1) * F.col("w")).alias("high"), "n")


def length_histogram(regions: DataFrame) -> DataFrame:
    return histogram(regions, F.col("Signal_End") - F.col("Signal_Start") + 1, LENGTH_BINS)


def score_histogram(regions: DataFrame) -> DataFrame:
    return histogram(regions, F.col("Region_Score"), SCORE_BINS)


def boundary_histogram(regions: DataFrame) -> DataFrame:
    """(kind, bin, low, high, n) of starts and of ends."""
    kinds = (histogram(regions, F.col(c), BOUNDARY_BINS).select(F.lit(k).alias("kind"), "*") for k, c in (("start", "Signal_Start"), ("end", "Signal_End")))
    return next(kinds).unionByName(next(kinds))


def positive_part(pds: Column) -> Column:
    return F.greatest(F.coalesce(pds, F.lit(0.0)), F.lit(0.0))


def landscape(signals: DataFrame) -> DataFrame:
    """(seq_idx, pos, di, smoothed, pds, pds_positive)."""
    return signals.select("seq_idx", "pos", "di", "smoothed", "pds", positive_part(F.col("pds")).alias("pds_positive"))


def three_windows(regions: DataFrame, sequences: DataFrame, p: Params = Params()) -> DataFrame:
    """Bounds of the upstream, region and downstream bands of each region, and of the slice shown around them. Of the sequences only lengths are joined."""
    s, e, n = F.col("Signal_Start"), F.col("Signal_End"), F.col("seq_len")
    regions = regions.select("seq_idx", "Region_ID", "Signal_Start", "Signal_End").join(sequences.select("seq_idx", "seq_len"), "seq_idx")
    pad = max(20, p.flank // 4)
    up_end, dn_start = s - p.spacer, e + p.spacer + 1
    return regions.select(
        "seq_idx", "Region_ID", (up_end - p.flank).alias("up_start"), up_end.alias("up_end"), s.alias("region_start"), e.alias("region_end"), dn_start.alias("dn_start"), (dn_start + p.flank).alias("dn_end"),
        F.greatest(up_end - p.flank - pad, F.lit(0)).alias("view_start"), F.least(dn_start + p.flank + pad, n).alias("view_end"),
    )


def ranking(regions: DataFrame) -> DataFrame:
    return regions.select("seq_idx", "Region_ID", "Region_Score").orderBy("seq_idx", F.desc("Region_Score"), "Region_ID")


def motif_bars(annotated: DataFrame) -> DataFrame:
    return annotated.select("seq_idx", "Region_ID", "Motif_Count").orderBy("seq_idx", F.desc("Motif_Count"), "Region_ID")


def heatmap(signals: DataFrame, value: str = "pds") -> DataFrame:
    """(seq_idx, pos, value): perplexity, or the depression score for any other name."""
    return signals.select("seq_idx", "pos", F.col("di" if value == "perplexity" else "pds").alias("value"))


def consensus_track(profile: DataFrame, consensus: DataFrame) -> DataFrame:
    """(pos, mean_pds, region_id): the profile with the consensus region over each position."""
    c = consensus.select("region_id", "consensus_start", "consensus_end")
    return within(profile.select("pos", "mean_pds", "lpr_frequency"), c, "consensus_start", "consensus_end", "left").select("pos", "mean_pds", "lpr_frequency", "region_id")


def top_motifs(frequencies: DataFrame, n: int = 15) -> DataFrame:
    """The motifs of greatest frequency in any consensus region."""
    return frequencies.groupBy("motif").agg(F.max("frequency").alias("max_frequency")).orderBy(F.desc("max_frequency"), "motif").limit(n)


def result_figures(regions: DataFrame, signals: DataFrame) -> DataFrame:
    """(n_regions, longest, best_score, peak): the numbers above a result."""
    r = regions.agg(F.count("*").alias("n_regions"), F.max("Length").alias("longest"), F.max("Region_Score").alias("best_score"))
    return r.join(signals.agg(F.max("pds").alias("peak_pds")))


