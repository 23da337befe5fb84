"""The analyses as SQL functions: ``regions(seq, ...)`` as a table to join laterally, ``di_profile(seq)``, ``pds_profile(seq)`` and ``gc_profile(seq)`` as arrays.

    SELECT d.id, r.* FROM sequences d, LATERAL regions(d.seq, min_region => 80) r ORDER BY d.id, r.rank

A call works on the one sequence that it is given, where that is; nothing is shuffled. Sequences are sanitised first, as files are. A null or short one has no regions, and an empty profile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import regions as R
from ..operators.population import window_totals
from ..operators.signals import PIECE, Signal, codes, perplexities, pieces, whole_signal, whole_signals
from .params import EPSILON, MICRO, Params

_KEPT = bytes.maketrans(b"U", b"T")
_DELETED = bytes(c for c in range(256) if c not in b"ACGTNU")
#: Texts that are letters at a time, and numbers that wait to be joined.
TEXTS, VALUES = 128, 1 << 18
NUMBERS = "Mean_Perplexity Min_Perplexity Max_Perplexity Upstream_Mean Region_Mean Downstream_Mean Perplexity_Depression_Score Prominence Persistence Variance Std_Dev CV AUC_PDS GC_Content Region_Score".split()
RETURNS = "Region_ID string, Signal_Start int, Signal_End int, Start int, End int, Length int, " + ", ".join(f"{n} double" for n in NUMBERS) + ", Sequence string, Rank int"


def letters(text: str | None) -> bytes:
    return (text or "").upper().encode("ascii", "ignore").translate(_KEPT, _DELETED)


def _rounded(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10.0**digits


def region_rows(text: str | None, p: Params) -> list[tuple]:
    """RETURNS of each region of one sequence, as the region table has it."""
    seq = letters(text)
    return rows_of(seq, whole_signal(seq, p), p) if len(seq) >= p.window else []


def rows_of(seq: bytes, x: Signal, p: Params) -> list[tuple]:
    """``region_rows`` of sanitised letters whose signal is known."""
    names, rows = [f.split()[0] for f in R.MEASURES.split(", ")], []
    mean = lambda total, n: None if not n else (total or 0) / n / MICRO
    for s, e in R.bounds_of(x.v_ok, p):
        m = dict(zip(names, R.measured(x, s, e, p)))
        last = min(len(seq) - 1, e + p.window - 1)
        part = seq[s : last + 1].decode()
        score, n = mean(m["v_sum"], m["v_n"]) or 0.0, m["v_n"]
        variance = float(n * int(m["v_square"]) - m["v_sum"] ** 2) / (n * n) / MICRO / MICRO if n >= 2 else 0.0
        background, persistence, std = mean((m["up_sum"] or 0) + (m["dn_sum"] or 0), m["up_n"] + m["dn_n"]), m["v_positive"] / n if n else 0.0, math.sqrt(variance)
        prominence = 0.0 if background is None or m["q_min"] is None else max(0.0, background - m["q_min"] / MICRO)
        none = lambda v: None if v is None else v / MICRO
        gc = _rounded(100.0 * (part.count("G") + part.count("C")) / max(len(part), 1), 2)
        rank_score = max(0.0, score * persistence * math.log(e - s + 1) / (variance + EPSILON))
        rows.append((s, e, s, last, last - s + 1, mean(m["d_sum"], m["d_n"]), none(m["d_min"]), none(m["d_max"]), mean(m["up_sum"], m["up_n"]), mean(m["q_sum"], m["q_n"]), mean(m["dn_sum"], m["dn_n"]), score, prominence, persistence, variance, std, std / abs(score) if abs(score) > EPSILON else 0.0, (m["v_sum"] or 0) / MICRO, gc, rank_score, part))
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][-2], rows[k][0]))
    rank = {k: r + 1 for r, k in enumerate(order)}
    return [(f"LPR_{k + 1:06d}", *row, rank[k]) for k, row in enumerate(rows)]


class Regions:
    """``regions(seq, window, sg_window, sg_order, flank, spacer, min_candidate, max_candidate, min_region, max_region, merge_gap)``; all but seq may be left out or named."""

    def eval(self, seq: str, window: int = 17, sg_window: int = 21, sg_order: int = 3, flank: int = 100, spacer: int = 50, min_candidate: int = 50, max_candidate: int = 1000, min_region: int = 100, max_region: int = 1000, merge_gap: int = 100):
        yield from region_rows(seq, Params(window, sg_window, sg_order, flank, spacer, min_candidate, max_candidate, min_region, max_region, merge_gap))


def _profile(of):
    """A function of text as an Arrow function to arrays of numbers, null where there is none."""

    @F.arrow_udf("array<double>")
    def profile(texts: pa.Array) -> pa.Array:
        sizes, parts, held, waiting = [0], [], [], 0
        for at in range(0, len(texts), TEXTS):
            for values in of([letters(t) for t in texts.slice(at, TEXTS).to_pylist()]):
                sizes.append(len(values))
                held.append(values)
                waiting += len(values)
            if waiting >= VALUES or at + TEXTS >= len(texts):
                parts.append(pa.array(np.concatenate([np.array([]), *held]), from_pandas=True))  # eight bytes a number, not one of Python's
                held, waiting = [], 0
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.concat_arrays(parts or [pa.array([], pa.float64())]))

    return profile


def _di(seqs: list[bytes]) -> Iterator[np.ndarray]:
    p = Params()
    for seq in seqs:
        yield np.concatenate([np.array([])] + [perplexities(codes(x.letters), p)[x.low - x.first : x.high - x.first] for x in pieces(seq, p, PIECE)])


def _pds(seqs: list[bytes]) -> Iterator[np.ndarray]:
    p = Params()
    found = whole_signals((seq for seq in seqs if len(seq) >= p.window), p)
    for seq in seqs:
        x = next(found) if len(seq) >= p.window else None
        yield np.array([]) if x is None else np.where(x.v_ok, x.v / float(MICRO), np.nan)


def _gc(seqs: list[bytes]) -> Iterator[np.ndarray]:
    for seq in seqs:
        yield window_totals(seq, 0, len(seq), 0, len(seq), 10) / 21.0 if seq else np.array([])


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("regions", F.udtf(Regions, returnType=RETURNS))
    for name, of in (("di_profile", _di), ("pds_profile", _pds), ("gc_profile", _gc)):
        spark.udf.register(name, _profile(of))
