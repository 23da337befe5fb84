"""Filter interaction audit: how five text filters overlap, from the counts of their joint failures alone.

For every subset S of the filters the documents that fail all of S are counted, as sums of products of the failure flags.
These 32 numbers for each part are all that is kept. Inclusion and exclusion over the subsets of T gives what survives the filters T:
the sum of (-1)^|S| joint(S) for S within T. From the survivors follow, for each of the 120 orders and its steps, what a
filter removes after those before it, what it finds already removed, and what fails it alone. The game "documents that the filters T remove"
has the Harsanyi dividends (-1)^(|S|+1) joint(S); a filter's Shapley value is its share 1/|S| of the dividend of each S with it, and
120 times that, which is whole, is its removals summed over all orders.

Texts leave the scan as flags and a digest. Copies are found by digest: the least identifier of each digest, by a partial aggregate, meets the
rows by digest and identifier together, so a group of copies of any size is dealt out evenly. Labels meet the rows by identifier, and rows without
one are dealt by digest. Flags are counted by part before the products are formed.

Defined results. A null text is an empty one, which fails A only (and E as a copy of another empty one). A null source is the empty string.
A document whose identifier is null has no smaller ones and is none: it neither fails E nor makes others fail; it has no labels. Rows
that repeat an identifier are documents each; equal texts under one identifier are not copies of each other. A document counts as good or toxic if any of its label rows says so.
No documents, no rows. Other columns of the inputs play no part.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, strings

FILTERS = "ABCDE"
#: All filters failed, as bits: A is 1, B 2, and so on.
ALL = (1 << len(FILTERS)) - 1
#: The symbols of filter D.
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: 120 / |S|: a filter's share of a dividend, times the number of orders.
SHARES = (0, 120, 60, 40, 30, 24)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text: str) -> int:
    """The filters A to D that a text fails, as bits. Bytes are split at exactly space and the characters 9 to 13."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, UPPER))) > 5 * len(text)) << 2
        | (len(raw) != len(raw.translate(None, SYMBOLS))) << 3
    )


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest, n): documents alike in all of these, counted before they are shuffled."""

    def read(batches):
        for batch in slices(batches):
            texts = strings(batch.column(1))
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(failed, texts), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "bits", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(read, "doc_id long, part string, bits int, digest binary").groupBy("doc_id", "part", "bits", "digest").agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part by the filters that they fail, E with them."""
    rows = stored(flagged(docs))  # read twice
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # Rows without an identifier meet nothing and are dealt out by their digest.
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    key = F.coalesce(F.col("doc_id"), F.xxhash64("digest"))
    rows = rows.withColumns({"key": key, "named": F.col("doc_id").isNotNull()})
    named = lambda df: df.withColumnRenamed("doc_id", "key").withColumn("named", F.lit(True))
    rows = rows.join(named(least), ["digest", "key", "named"], "left").join(named(known), ["key", "named"], "left")
    copy = F.when(F.col("named") & F.col("first").isNull(), 1 << 4).otherwise(0)
    sums = [F.sum("n").alias("n"), *(F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic"))]
    return rows.groupBy("part", (F.col("bits") + copy).alias("bits")).agg(*sums)


def joint(cells: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of 32 counts, at S the documents that fail every filter of S: sums of products of flags."""
    product = [" * ".join(["1", *(f"getbit(bits, {k})" for k in range(len(FILTERS)) if s >> k & 1)]) for s in range(ALL + 1)]
    return cells.groupBy("part").agg(*(F.expr(f"array({', '.join(f'sum({c} * {x})' for x in product)})").alias(c) for c in ("n", "good", "toxic")))


def survivors(joint: str) -> Column:
    """The Möbius sum: at T, the documents that fail no filter of T."""
    return F.expr(f"transform(sequence(0, {ALL}), t -> aggregate(filter(sequence(0, {ALL}), s -> s & t = s), 0L, (a, s) -> a + if(bit_count(s) % 2 = 0, 1, -1) * {joint}[s]))")


def shapley(joint: str) -> Column:
    """For each filter its shares of the Harsanyi dividends of all sets with it, times 120."""
    dividend = lambda s: f"{(-1) ** (s.bit_count() + 1) * SHARES[s.bit_count()]} * {joint}[{s}]"
    return F.expr(f"array({', '.join(' + '.join(dividend(s) for s in range(ALL + 1) if s >> k & 1) for k in range(len(FILTERS)))})")


def steps() -> Column:
    """Every order's steps: filter_order, step, the filters before it as bits, the filter's number."""
    bits = lambda some: sum(1 << FILTERS.index(x) for x in some)
    rows = (f"struct('{''.join(o)}' AS filter_order, {k + 1} AS step, {bits(o[:k])} AS before, {FILTERS.index(f)} AS k)" for o in permutations(FILTERS) for k, f in enumerate(o))
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the COUNTS, for every part, order and step."""
    told = joint(cells(docs, labels))
    left = told.select("part", F.col("n").alias("joint"), *(survivors(c).alias(c) for c in ("n", "good", "toxic")), shapley("n").alias("shapley"))
    rows = left.withColumn("x", F.explode(steps())).selectExpr("*", "x.*", "shiftleft(1, x.k) AS bit", "x.before | shiftleft(1, x.k) AS after")
    lost = "{0}[before] - {0}[after]".format
    return rows.selectExpr(
        "part", "filter_order", "step", "n[after] AS kept", f"{lost('n')} AS removed", f"joint[bit] - ({lost('n')}) AS redundant", f"n[{ALL} ^ bit] - n[{ALL}] AS unique_fails",
        f"{lost('good')} AS good_lost", f"{lost('toxic')} AS toxic_lost", "shapley[k] AS shapley",
    )
