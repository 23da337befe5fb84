"""Fixity audit of WARC replicas by Merkle trees.

A record's leaf is the SHA-256 of its bytes. Records stand in the archive in the order of their identifiers; a node at level k covers a
range of FANOUT**k identifiers and the bytes of their records. Its hash is that of its children in order, each by its number, the offset
of its bytes from the node's first byte, their number, and its hash: so a node tells what its range holds and where, and a record
that goes elsewhere changes the nodes of both places. The audit compares the replicas' roots and ends there if they are equal; otherwise it
joins a level only below nodes that differ, down to the records. Places in the file follow from the ranges' byte counts on the way
down, a parent at a time, so no task orders the whole archive.

Records that share an identifier are one leaf: the sums of their hashes' four parts, which do not depend
on order, combine before the shuffle, so no such group is collected.

Defined results. Null urls and bodies are empty. Records without an identifier are one leaf, ordered
first. An empty replica misses every record; two empty ones give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 64
#: Identifiers are ordered as numbers; nulls stand before the smallest.
NULL_ID = -(1 << 63)


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC record's bytes."""
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def _record_id() -> Column:
    return F.when(F.col("node") != NULL_ID, F.col("node")).alias("record_id")


def leaves(records: DataFrame) -> DataFrame:
    """(node, hash, n_bytes, n_records) for each identifier of ``records`` (record_id, bytes), stored."""
    hashed = records.select(F.coalesce(F.col("record_id").cast("long"), F.lit(NULL_ID)).alias("node"), F.sha2("bytes", 256).alias("h"), F.octet_length("bytes").cast("long").alias("n_bytes"))
    part = lambda k: F.sum(F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)"))
    summed = hashed.groupBy("node").agg(*(part(k).alias(f"s{k}") for k in range(4)), F.min("h").alias("h"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_records"))
    many = F.sha2(F.concat_ws(":", "n_records", "s0", "s1", "s2", "s3").cast("binary"), 256)
    return stored(summed.select("node", F.when(F.col("n_records") == 1, F.col("h")).otherwise(many).alias("hash"), "n_bytes", "n_records"))


def parent(node: Column) -> Column:
    return F.floor(node / F.lit(FANOUT)).cast("long") if FANOUT & (FANOUT - 1) else F.shiftright(node, FANOUT.bit_length() - 1)


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes of every level, leaves first; each has at most FANOUT children."""
    out = [leaf]
    for _ in range(levels):
        child = F.sort_array(F.collect_list(F.struct("node", "n_bytes", "hash")))
        up = out[-1].groupBy(parent(F.col("node")).alias("up")).agg(child.alias("c"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_records").alias("n_records"))
        start = lambda i: F.aggregate(F.slice("c", F.lit(1), i), F.lit(0).cast("long"), lambda at, y: at + y["n_bytes"])
        joined = F.concat_ws("|", F.transform("c", lambda x, i: F.concat_ws(":", x["node"], start(i), x["n_bytes"], x["hash"])))
        out.append(stored(up.select(F.col("up").alias("node"), F.sha2(joined.cast("binary"), 256).alias("hash"), "n_bytes", "n_records")))
    return out


def height(*replicas: DataFrame) -> int:
    """Levels until one or two nodes (below and above zero) cover all identifiers of the replicas."""
    most = 0
    for leaf in replicas:
        low, high = leaf.agg(F.min("node"), F.max("node")).first()
        k = 0
        while low is not None and (low, high) not in ((0, 0), (-1, 0), (-1, -1)):
            low, high, k = low // FANOUT, high // FANOUT, k + 1
        most = max(most, k)
    return most


def offsets(levels: list[DataFrame]) -> DataFrame:
    """(node, offset) of the leaves: where a record begins if records stand in order."""
    root = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # at most two nodes
    above = levels[-1].select("node", F.coalesce(F.sum("n_bytes").over(root), F.lit(0)).alias("offset"))
    for level in reversed(levels[:-1]):
        before = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        inner = level.select("node", parent(F.col("node")).alias("up"), "n_bytes")
        inner = inner.select("node", "up", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("inner"))
        above = inner.join(above.select(F.col("node").alias("up"), "offset"), "up").select("node", (F.col("offset") + F.col("inner")).alias("offset"))
    return above


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """record_id, offset, n_bytes (of the primary; of the replica for extra records), status.

    status: ok, changed, missing (not in the replica), extra (only there, without an offset).
    """
    a, b = leaves(primary), leaves(replica)
    levels = height(a, b)
    left, right = tree(a, levels), tree(b, levels)
    differ = None
    for x, y in zip(reversed(left), reversed(right)):
        if differ is not None:
            x, y = (t.withColumn("up", parent(F.col("node"))).join(differ.select(F.col("node").alias("up")), "up", "left_semi").drop("up") for t in (x, y))
        both = x.select("node", F.col("hash").alias("ha"), F.col("n_bytes").alias("na")).join(y.select("node", F.col("hash").alias("hb"), F.col("n_bytes").alias("nb")), "node", "full")
        differ = stored(both.where(~F.col("ha").eqNullSafe(F.col("hb"))))
        if differ.isEmpty():  # the roots are equal
            return _placed(a, left).withColumn("status", F.lit("ok"))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    told = differ.select("node", status.alias("status"), "nb")
    kept = a.select("node", "n_bytes").join(offsets(left), "node").join(told, "node", "full")
    return kept.select(_record_id(), "offset", F.coalesce("n_bytes", "nb").alias("n_bytes"), F.coalesce("status", F.lit("ok")).alias("status"))


def _placed(leaf: DataFrame, levels: list[DataFrame]) -> DataFrame:
    return leaf.select("node", "n_bytes").join(offsets(levels), "node").select(_record_id(), "offset", "n_bytes")
