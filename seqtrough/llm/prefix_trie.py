"""Prefix trie of conversations: which beginnings they share, and what keeping each of them once saves.

A node is a distinct sequence of first turns, known by its depth and the sums of five 32-bit numbers of each turn's depth and digest.
Sums over a conversation's turns are a scan (see ``scan``), so a node's key needs no text and no turns before it, and its parent's key is a difference.

Smallest-member ownership: a node belongs to the smallest conversation that has it. Deeper nodes have fewer members, so a
conversation owns a suffix of its path, and every node is owned once. Windows mark the owned nodes, first within shares of a node's
members, about the square root of all of them, then over the first of each share, so that no window holds a node that many share. One grouping by
node then sums over its members: bytes of the path from there on, less those of them that are owned, are the bytes saved in the subtree; owned ends that
nobody continues are its leaves; owned next nodes are its children.

The identifiers that end at a node are hashed in order as a stream: ranges of node and identifier are joined into blocks of text, and a task that
hashes a node reads its blocks one by one.

Defined results. Null roles and texts are empty. Turns of a conversation are in order of turn, null first; turns of equal number in order
of the SHA-256 of role length, role and text; equal rows are turns each. Rows without conv_id belong to no conversation. A conversation may be left
without turns; it is a member of the root alone. Remainders have the sign of the identifier, as in SQL. No conversations, no rows, not even a root. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .scan import upto

#: Conversations that share a beginning, and the most turns that they may take over.
FAMILY, HEADS = 5, 9
SUMS = [f"p{k}" for k in range(5)]
UPTO = [f"upto_{s}" for s in SUMS]
#: A node's key.
NODE = ["depth", *UPTO]
#: Characters of a block of identifiers.
BLOCK = 1 << 16


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, digest, bytes) of every turn; k counts a conversation's turns from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    return upto(rows, "conv_id", ["turn", "digest"], ["one"]).select("conv_id", (F.col("upto_one") - 1).alias("k"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes): each conversation's path, the first turns of its family's first conversation and then its own."""
    known = turns.where("k = 0").select("conv_id")
    kin = F.filter(F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda x: F.try_add("conv_id", x.cast("long"))), lambda c: c.isNotNull() & (c - c % FAMILY == F.col("conv_id")))
    taken = turns.where((F.col("k") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.explode(kin).alias("conv_id"), "k", "digest", "bytes")
    taken = stored(taken.where(F.col("k") < heads(F.col("conv_id"))).join(known, "conv_id", "left_semi"))
    lengths = taken.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = turns.where(F.col("k") >= heads(F.col("conv_id"))).join(lengths, "conv_id", "left")
    depth = F.col("k") - heads(F.col("conv_id")) + F.coalesce("n", F.lit(0)) + 1
    return taken.select("conv_id", (F.col("k") + 1).alias("depth"), "digest", "bytes").unionByName(own.select("conv_id", depth.alias("depth"), "digest", "bytes"))


def paths(path: DataFrame) -> DataFrame:
    """(conv_id, NODE, bytes, upto_bytes, SUMS): the node of each depth of each path, and the bytes up to it."""
    h = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    rows = path.withColumn("h", h).select("conv_id", "depth", "bytes", *(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(s) for k, s in enumerate(SUMS)))
    return upto(rows, "conv_id", ["depth"], [*SUMS, "bytes"])


def marked(members: DataFrame, shares: int) -> DataFrame:
    """The rows of ``members`` (NODE, conv_id, length, ...) that own their node, with ``ends``: no member goes on from there."""
    share = F.pmod(F.xxhash64("conv_id"), F.lit(shares))
    ahead = F.max(F.col("length") > F.col("depth"))
    within, all_ = Window.partitionBy(*NODE, "share"), Window.partitionBy(*NODE)
    first = F.row_number().over(within.orderBy("conv_id"))
    some = members.withColumn("share", share).withColumns({"on": ahead.over(within), "first": first}).where("first = 1")
    owned = some.withColumns({"on": F.max("on").over(all_), "first": F.row_number().over(all_.orderBy("conv_id"))}).where("first = 1")
    return owned.select(*members.columns, (~F.col("on")).alias("ends"))


def hashed(ends: DataFrame) -> DataFrame:
    """(NODE, ends_sha256) of ``ends`` (NODE, conv_id): the hash of each node's identifiers in ascending order, joined by commas."""
    kinds = ", ".join(f"{c} long" for c in NODE)
    names = [*NODE, "first", "ids"]

    def blocks(batches):
        key, held, size = None, [], 0

        def block():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*key, held[0])), pa.array([",".join(map(str, held))])], names)

        for batch in batches:
            for *at, c in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if held and (at != key or size >= BLOCK):
                    yield block()
                    held, size = [], 0
                key = at
                held.append(c)
                size += len(str(c)) + 1
        if held:
            yield block()

    def digests(batches):
        key, h = None, None
        for batch in batches:
            for *at, _, ids in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if at != key:
                    if key is not None:
                        yield told(key, h)
                    key, h = at, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
        if key is not None:
            yield told(key, h)

    def told(key, h):
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([h.hexdigest()])], [*NODE, "ends_sha256"])

    dealt = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(blocks, f"{kinds}, first long, ids string")
    return dealt.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{kinds}, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    turns = stored(numbered(conversations))
    steps = stored(paths(rebuilt(turns)))
    lengths = steps.groupBy("conv_id").agg(F.max("depth").alias("length"), F.sum("bytes").alias("total"))
    convs = stored(turns.where("k = 0").select("conv_id").join(lengths, "conv_id", "left").na.fill(0))
    n, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    members = stored(steps.join(convs, "conv_id"))
    owned = marked(members.select(*NODE, "conv_id", "length", (F.col("upto_bytes") - F.col("bytes")).alias("before")), max(1, math.isqrt(n)))
    marks = stored(owned.groupBy("conv_id").agg(F.min("depth").alias("since"), F.min("before").alias("owned_from"), F.max("ends").cast("long").alias("leaf")))
    rows = members.join(marks, "conv_id", "left")
    before = F.col("upto_bytes") - F.col("bytes")
    owns = lambda depth: (F.coalesce((F.col("since") <= depth) & (depth <= F.col("length")), F.lit(False))).cast("long")
    kept = F.when(F.col("owned_from").isNotNull(), F.col("total") - F.greatest(before, "owned_from")).otherwise(0)  # bytes from here on that the member owns
    saved = F.sum(F.col("total") - before - kept)
    parent = [(F.min(F.col(u) - F.col(s))).alias(f"parent_{s}") for u, s in zip(UPTO, SUMS)]
    told = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(owns(F.col("depth") + 1)).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves")]
    below = stored(rows.groupBy(*NODE).agg(*told, saved.alias("saved_tokens"), F.min_by("since", "conv_id").alias("since"), *parent))
    zero = {c: F.lit(0).cast("long") for c in NODE}
    whole = convs.join(marks, "conv_id", "left").withColumn("depth", F.lit(0).cast("long"))
    spent = F.sum("total") - F.sum(F.coalesce(F.col("total") - F.col("owned_from"), F.lit(0)))
    root = whole.agg(*told, spent.alias("saved_tokens")).where("n_convs > 0").withColumn("n_leaves", F.greatest("n_leaves", (F.col("n_children") == 0).cast("long"))).withColumns(zero)
    # A node below the first that its owner owns has the same owner above it; of the others there is one for each conversation.
    above = below.select((F.col("depth") + 1).alias("depth"), *(F.col(u).alias(f"parent_{s}") for u, s in zip(UPTO, SUMS)), F.col("conv_id").alias("parent_conv_id"))
    looked = below.where("depth > 1 and since = depth").join(above, ["depth", *(f"parent_{s}" for s in SUMS)])
    same = below.where("depth = 1 or since < depth").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("conv_id")))
    columns = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    all_ = looked.select(columns).unionByName(same.select(columns)).unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    ends = members.where("depth = length").select(*NODE, "conv_id").unionByName(convs.where("length = 0").withColumns(zero).select(*NODE, "conv_id"))
    out = all_.join(hashed(ends), NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
