"""Quality rules: a table of thresholds compiled into one Spark projection.

Every statistic is a built-in expression over the whole text, so the rules run inside the scan's
own stage: no shuffle, no Python, and memory bounded by the longest text.

Defined results. Null and empty texts have no words, so every count is 0 and the base rule rejects
them. Repeated rows are judged each by itself. Extra columns pass through; the columns that this
module adds replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RE, unlike

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it was for on are as with he be at by this from an or a "
    "der die das und zu den mit ist von im auf sich für des ein eine nicht auch als dem "
    "de la le les et des en un une du que est pour dans qui par sur pas au avec "
    "el los las y con una por para se del no su lo al mi"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= value <= high``; ``value`` names a measure of RATIOS."""

    value: str
    low: float | None = None
    high: float | None = None


#: Measures by name, each over the counts of ``measured``.
RATIOS = {
    "symbols_per_word": lambda c: c("n_symbols") / c("n_words"),
    "marks_per_word": lambda c: c("n_marks") / c("n_words"),
    "mean_word_length": lambda c: c("word_chars") / c("n_words"),
    "upper_share": lambda c: c("n_upper") / c("word_chars"),
    "digit_share": lambda c: c("n_digits") / c("word_chars"),
    "stop_word_share": lambda c: c("n_stop_words") / c("n_words"),
    "dup_line_share": lambda c: c("n_dup_lines") / c("n_lines"),
    "repeat_word_share": lambda c: c("n_repeat_words") / c("n_words"),
}

#: The thresholds; a further rule is a further line.
RULES = (
    Rule("symbols_per_word", high=0.3),
    Rule("marks_per_word", high=0.3),
    Rule("mean_word_length", low=2.0, high=14.0),
    Rule("upper_share", high=0.4),
    Rule("digit_share", high=0.3),
    Rule("stop_word_share", low=0.02),
    Rule("dup_line_share", high=0.5),
    Rule("repeat_word_share", high=0.5),
)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RE), lambda x: x != "")


def repeat_words(words: Column, places: int = 24) -> Column:
    """Words within windows of three that the text has twice or more.

    Windows become 64-bit hashes; sorting (hash's upper bits, place) pairs as plain longs brings equal windows together, and the
    places found cover up to three words each. Where ``places`` bits are too few for a place, or two different hashes have
    the same upper bits, pairs of whole hashes and places are sorted instead, which costs more and is exact at any length.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << places) - 1)).cast("int")

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x.bitwiseXOR(y), places) == 0, F.lit(False))

    def packed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, places), places).bitwiseOR(i.cast("long"))))

    def clash(h: Column, s: Column) -> Column:
        return F.exists(F.transform(s, lambda x, i: alike(x, F.get(s, i + 1)) & (F.get(h, place(x)) != F.get(h, place(F.coalesce(F.get(s, i + 1), x))))), lambda x: x)

    def of_packed(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, i: alike(x, F.get(s, i + 1)) | alike(x, F.get(s, i - 1))), place))

    def of_pairs(h: Column) -> Column:
        def found(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))), lambda x: x["i"]))

        return bound(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found)

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def over(h: Column) -> Column:
        short = bound(packed(h), lambda s: F.when(clash(h, s), of_pairs(h)).otherwise(of_packed(s)))
        return bound(F.when(F.size(h) < F.lit(min(1 << places, 1 << 30)), short).otherwise(of_pairs(h)), covered)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(bound(windows(words), over))


def n_of(text: Column, chars: str) -> Column:
    """How many of ``chars`` the text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(text: Column) -> Column:
    """A struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    solid = F.translate(text, SPACE, "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        bound(words_of(text), of_words).alias("words"),
        bound(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != ""), of_lines).alias("lines"),
        F.length(solid).cast("long").alias("word_chars"),
        n_of(text, "#*$%&|<>").alias("n_symbols"),
        n_of(text, "!?").alias("n_marks"),
        n_of(text, "0123456789").alias("n_digits"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )


COUNTS = {
    "n_words": "words.n_words",
    "word_chars": "word_chars",
    "n_symbols": "n_symbols",
    "n_dup_lines": "lines.n_dup_lines",
    "n_repeat_words": "words.n_repeat_words",
    "n_lines": "lines.n_lines",
    "n_stop_words": "words.n_stop_words",
    "n_marks": "n_marks",
    "n_digits": "n_digits",
    "n_upper": "n_upper",
}


def counted_in(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with a struct of all counts in a column of a new name, the last, and the counts by name."""
    held = unlike(docs, "measured")
    return docs.withColumn(held, bound(measured(F.col(text)), lambda x: x)), {k: F.col(f"`{held}`.{v}") for k, v in COUNTS.items()}


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column for each count."""
    df, of = counted_in(docs, text)
    return df.withColumns(of).drop(df.columns[-1])


def verdict(rules=RULES) -> Column:
    """True where every rule holds; a ratio of nothing breaks none."""
    out = F.lit(True)
    for r in rules:
        value = RATIOS[r.value](lambda k: F.nullif(F.col(k), F.lit(0)).cast("double") if k in ("n_words", "n_lines", "word_chars") else F.col(k))
        if r.low is not None:
            out = out & F.coalesce(value >= r.low, F.lit(True))
        if r.high is not None:
            out = out & F.coalesce(value <= r.high, F.lit(True))
    return out


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept``."""
    df = counts(docs, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
