"""Motifs: IUPAC codes or regular expressions, one a line, counted in regions without overlap."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bases of the ambiguity codes.
IUPAC = {
    "R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]", "K": "[GT]", "M": "[AC]",
    "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]",
}

#: The built-in motifs.
NON_B_DNA = (
    "A{7}|T{7}",
    "G{7}|C{7}",
    "G{3,5}[ACGT]{1,7}G{3,5}[ACGT]{1,7}G{3,5}[ACGT]{1,7}G{3,5}",
    "C{3,5}[ACGT]{1,7}C{3,5}[ACGT]{1,7}C{3,5}[ACGT]{1,7}C{3,5}",
)
PROMOTER = ("TATAWAWR", "BBCABW", "YYCTTTYY", "SSRCGCC", "RTDKKKK", "DSGYGGRASM", "WATCGATW", "CSARCSSAACGS", "RGWCGTG", "KCGRWCG")

Motif = tuple[str, str]  # as written, as a regular expression

_WORD = re.compile(rf"\s*[ACGT{''.join(IUPAC)}]+\s*", re.IGNORECASE)
_SPELLED = str.maketrans(IUPAC)


def pattern(text: str) -> str:
    """A word of bases and ambiguity codes as a regular expression; anything else is one already."""
    return text.strip().upper().translate(_SPELLED) if _WORD.fullmatch(text) else text.strip()


def read(text: str) -> list[Motif]:
    """(as written, regular expression) of each line that is not blank."""
    return [(line, pattern(line)) for line in filter(None, map(str.strip, text.splitlines()))]


def wrong(regex: str) -> str:
    """What is wrong with an expression for the engine that will run it, Java's, through the session; nothing without one, for then nothing can run."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(f"(?i){regex}")
    except (Py4JJavaError, IllegalArgumentException) as e:
        return str(e).splitlines()[0]
    return ""


def parse(text: str) -> list[Motif]:
    """Motifs of a text, one a line. The first invalid one raises ValueError."""
    motifs = read(text)
    for line, p in motifs:
        if said := "" if _WORD.fullmatch(line) else wrong(p):
            raise ValueError(f"motif {line!r}: {said}")
    return motifs


def motif_list(custom: str = "", non_b: bool = True, promoter: bool = True) -> list[Motif]:
    """Built-in and custom motifs in order."""
    return parse("\n".join([*(NON_B_DNA if non_b else ()), *(PROMOTER if promoter else ()), custom]))


def validated(motifs: DataFrame, motif: str = "motif") -> DataFrame:
    """``motifs`` with ``status``, valid or invalid: whether the engine that runs expressions takes the motif. Null and blank ones are neither."""
    text = F.regexp_replace(F.col(motif), r"^\s+|\s+$", "")
    word = F.col(motif).rlike(rf"^(?i:\s*[ACGT{''.join(IUPAC)}]+\s*)$")
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?i)"), text))
    return motifs.withColumn("status", F.when(F.length(text) > 0, F.when(word | compiled.isNotNull(), "valid").otherwise("invalid")))


def validate(spark: SparkSession, text: str) -> DataFrame:
    """(motif_ord, motif, status): valid or invalid, for each line that is not blank."""
    rows = [(k, name) for k, (name, _) in enumerate(read(text))]
    return validated(spark.createDataFrame(rows, "motif_ord int, motif string"))


def table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    schema = T.StructType([T.StructField("motif_ord", T.IntegerType()), T.StructField("motif", T.StringType()), T.StructField("regex", T.StringType())])
    return spark.createDataFrame([(k, m, p) for k, (m, p) in enumerate(motifs)], schema)


class Words:
    """Up to 64 words of bases and ambiguity codes, found together: a bit for each word.

    At each offset a table has, for each letter, the words that allow it there or have ended. A sequence's letters go through the tables offset by offset, so that
    what is left of a place's bits after the longest word's length are the words that begin there.
    """

    def __init__(self, words: list[str]):
        self.lengths = [len(w) for w in words]
        self.tables = np.zeros((max(self.lengths), 5), np.uint64)  # A, C, G, T, anything else or nothing
        for bit, word in enumerate(words):
            for k in range(len(self.tables)):
                allowed = range(5) if k >= len(word) else ["ACGT".index(x) for x in IUPAC.get(word[k], word[k]).strip("[]")]
                self.tables[k, list(allowed)] |= np.uint64(1 << bit)

    def begins(self, seq: bytes) -> np.ndarray:
        """For each place the words that begin there, as bits."""
        code = np.concatenate([_CODES[np.frombuffer(seq, np.uint8)], np.full(len(self.tables), 4, np.uint8)])
        out = self.tables[0, code[: len(seq)]]
        for k in range(1, len(self.tables)):
            out &= self.tables[k, code[k : k + len(seq)]]
        return out

    def counts(self, seq: bytes) -> list[int]:
        """How often each word occurs, from the left and without overlap with itself."""
        begins, out = self.begins(seq), []
        for bit, length in enumerate(self.lengths):
            at = np.flatnonzero(begins >> np.uint64(bit) & np.uint64(1))
            if len(at) > 1 and (np.diff(at) < length).any():
                n, free = 0, 0
                for x in at.tolist():
                    if x >= free:
                        n, free = n + 1, x + length
                out.append(n)
            else:
                out.append(len(at))
        return out


_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = _CODES[list(b"acgt")] = range(4)


def word_counts(seq: Column, words: list[str]) -> Column:
    """An array with the number of occurrences of each of ``words``, in one pass over a sequence."""
    found = [Words(words[k : k + 64]) for k in range(0, len(words), 64)]

    @F.arrow_udf("array<int>")
    def count(seqs: pa.Array) -> pa.Array:
        return pa.array(([n for w in found for n in w.counts((x or "").encode())] for x in seqs.to_pylist()), pa.list_(pa.int32()))

    return count(seq)


def hits(seq: Column, regex: str) -> Column:
    """Matches without overlap, upper or lower case alike."""
    return F.regexp_count(seq, F.lit(f"(?i){regex}"))


def with_hit_counts(df: DataFrame, motifs: list[Motif], seq: str = "Sequence") -> tuple[DataFrame, str]:
    """``df`` with an array of the hits of each motif in a column of a new name, and the name. Words are counted in one pass, expressions each by Spark's own."""
    words = [name.strip().upper() for name, p in motifs if _WORD.fullmatch(name) and p == pattern(name)]
    name = next(f"_hits{k}" for k in range(len(df.columns) + 1) if f"_hits{k}" not in df.columns)
    if not words:
        return df.withColumn(name, F.array(*(hits(F.col(seq), p) for _, p in motifs))), name
    place = {w: k for k, w in enumerate(dict.fromkeys(words))}
    counted = df.withColumn(f"{name}w", word_counts(F.col(seq), list(place)))
    each = (F.get(f"{name}w", F.lit(place[m.strip().upper()])) if _WORD.fullmatch(m) and p == pattern(m) else hits(F.col(seq), p) for m, p in motifs)
    return counted.withColumn(name, F.array(*each)).drop(f"{name}w"), name


def counts(regions: DataFrame, motifs: list[Motif]) -> DataFrame:
    """(seq_idx, Region_ID, motif_ord, motif, hits): a row for each region and motif."""
    df, at = with_hit_counts(regions.select("seq_idx", "Region_ID", "Sequence"), motifs)
    named = F.array(*(F.lit(m) for m, _ in motifs))
    rows = df.select("seq_idx", "Region_ID", F.posexplode(at).alias("motif_ord", "hits"))
    return rows.select("seq_idx", "Region_ID", "motif_ord", F.get(named, F.col("motif_ord")).alias("motif"), "hits")


def annotate(regions: DataFrame, motifs: list[Motif]) -> DataFrame:
    """``regions`` with Motif_Count and Motifs, ``motif:count`` joined by ``;`` for the motifs that occur."""
    if not motifs:
        return regions
    df, at = with_hit_counts(regions, motifs)
    total = F.aggregate(at, F.lit(0), lambda a, x: a + x)
    told = F.array_join(F.filter(F.zip_with(F.array(*(F.lit(m) for m, _ in motifs)), at, lambda m, n: F.when(n > 0, F.concat_ws(":", m, n.cast("string")))), lambda x: x.isNotNull()), ";")
    return df.withColumns({"Motif_Count": total, "Motifs": told}).select(*regions.columns)


def with_hits(regions: DataFrame) -> DataFrame:
    """Region_ID, Motif_Count, Motifs of the regions that have any."""
    return regions.where("Motif_Count > 0").select("seq_idx", "Region_ID", "Motif_Count", "Motifs")
