"""Similarity self-join of documents' n-gram sets by prefix trees.

Two documents link when the Jaccard similarity of their sets of distinct word n-grams reaches a share.
The sets are put in one global order, rare n-grams first; linked sets must share an n-gram of their
prefixes in that order, and so must lie in one block of documents that prefixes connect. Within a
block the sets stand in a trie. Each set walks it once, sharing the partial overlaps of common
beginnings, and leaves a subtree as soon as the sizes below it show that no set there can still reach
the share, or once all sets below are known to be in its component.

* Equal sets are one class, found by a 128-bit hash of the whole set; a class is joined once.
* The order: of the n-grams whose hash is in the lowest quarter, first those that one class alone has,
  then by how many have them, last the very frequent ones, which are known from counts within batches;
  then all others by hash. Any total order gives exact results; this one makes short prefixes rare.
  N-grams that one class alone has link nothing, so a document with enough of them is done.
* Very frequent n-grams are counted where they are found and never meet in one task.
* A block with more n-grams than a task should hold is cut into parts, and each pair of parts is joined.

Defined results. Null and empty texts have an empty set and are linked with nothing. Texts with fewer
words than n have one n-gram, the whole sequence. Each row is a document: rows that repeat an identifier
keep their own sets, and a component is named by its smallest identifier. Rows without an identifier take
part in links; a component of them alone is named null. Other input columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words, shingle_hashes, slices, stored, strings, unburdened, unlike, word_hashes
from .graph import components

#: N-grams whose hash is under 2**LOW are counted over the corpus.
LOW = 62
#: A batch of documents tells how often it has an n-gram from this count up.
OFTEN = 8
#: Most frequent n-grams that are known to every task (a bound; the order is total whatever it is).
HOT = 20_000
#: N-grams of one block that a task joins at once; larger blocks are cut into parts of half of it.
HELD = 3_000_000
#: Rows of narrow tables that may be broadcast; beyond it joins with them shuffle.
BROADCAST_ROWS = 400_000


def ngram_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams."""
    return np.unique(shingle_hashes(word_hashes(lower_words(text)), n))


def needed(size: int, num: int, den: int) -> int:
    """The smallest overlap with any set for a set of ``size`` to be linked."""
    return -(-num * size // den)


def prefix(size: int, num: int, den: int) -> int:
    return size - needed(size, num, den) + 1


def _unsigned(a: np.ndarray) -> np.ndarray:
    return a.view(np.uint64)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _summaries(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A row for each document: its set's size, hash, and the n-grams that may be in its prefix."""

    def summarise(batches):
        unburdened()
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            sizes, hashes, kept = [], [], []
            for text in strings(batch.column(1)):
                grams = ngram_set(text, n)
                low = int(np.searchsorted(grams, np.uint64(1 << LOW)))
                sizes.append(len(grams))
                hashes.append(xxhash.xxh3_128_digest(grams.tobytes()))
                kept.append(grams[: max(low, prefix(len(grams), num, den)) if len(grams) else 0])
            ends = np.cumsum([0, *map(len, kept)])
            flat = np.concatenate([*kept, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(sizes)), pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), _lists(ends, flat)], ["row", "doc_id", "n", "set", "grams"])
            row += len(sizes)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(summarise, "row long, doc_id long, n long, set binary, grams array<long>")


def _hot(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams that are frequent within batches, and their counts there: at most HOT."""

    def count(batches):
        for batch in batches:
            values, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            often = counts >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(counts[often])], ["gram", "n"])

    told = summaries.select("grams").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = sorted((r.gram, r.n) for r in told.orderBy(F.desc("n"), "gram").limit(HOT).collect())
    return np.array([g for g, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def _prefixes(classes: DataFrame, hot: tuple[np.ndarray, np.ndarray], num: int, den: int) -> DataFrame:
    """(gram, node, n): the prefix n-grams of each class that other classes have too."""
    grams, often = hot

    def among(values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grams, values)
        return (at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == values) if len(grams) else np.zeros(len(values), bool)

    def counted(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy()
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            cold = ~among(values)
            yield pa.RecordBatch.from_arrays([pa.array(values[cold]), pa.array(nodes[cold])], ["gram", "node"])

    def slim(batches):
        """What a class needs for its prefix besides the shared n-grams: how many others it has, the very frequent, those by hash."""
        for batch in slices(batches):
            lists = batch.column(2)
            rows = []
            for k, node, n in zip(range(batch.num_rows), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = lists[k].values.to_numpy()
                low = (mine >= 0) & (mine < 1 << LOW)
                known = among(mine)
                rows.append((node, n, int((low & ~known).sum()), mine[low & known], mine[~low]))
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "low", "often", "others"])

    def chosen(batches):
        for batch in slices(batches):
            nodes, keys, sizes = [], [], []
            for node, n, low, frequent, others, shared in zip(*(x.to_pylist() for x in batch.columns)):
                ranked = [(0, x["df"], x["gram"]) for x in shared or [] if 0 <= x["gram"] < 1 << LOW]
                left = prefix(n, num, den) - (low - len(ranked))  # the n-grams that it alone has come first
                if left <= 0:
                    continue
                ranked += [(1, int(often[np.searchsorted(grams, g)]), g) for g in frequent]
                met = {x["gram"] for x in shared or []} | set(np.array(others, np.int64)[among(np.array(others, np.int64))].tolist())
                ranked += [(2, g < 0, g) for g in others if g in met]  # not counted over the corpus: by hash, after the others
                for _, _, g in sorted(ranked)[:left]:
                    nodes.append(node)
                    keys.append(g)
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())], ["gram", "node", "n"])

    counts = classes.select("node", "grams").mapInArrow(counted, "gram long, node long")
    df = F.count("*").over(_by("gram"))
    shared = counts.withColumn("df", df).where("df > 1").groupBy("node").agg(F.collect_list(F.struct("gram", "df")).alias("shared"))
    rest = classes.select("node", "n", "grams").mapInArrow(slim, "node long, n long, low long, often array<long>, others array<long>")
    return rest.join(shared, "node", "left").mapInArrow(chosen, "gram long, node long, n long")


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has few enough rows; else the join shuffles both sides."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def _blocks(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """(node, label): classes that chains of shared prefix n-grams and near sizes connect.

    Sizes fall into bands as wide as the share allows, so linked sets are in one band or in neighbours;
    all of a band with one n-gram are tied to its smallest node, and neighbouring bands to each other.
    """
    band = F.floor(F.log("n") / float(np.log(den / num)) + 1e-9) if num < den else F.col("n")
    keyed = prefixes.select("gram", band.cast("long").alias("band"), "node")
    heads = stored(keyed.groupBy("gram", "band").agg(F.min("node").alias("head"), F.max("node").alias("last")))
    ties = keyed.join(heads.where("head <> last").select("gram", "band", "head"), ["gram", "band"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    upper = heads.select("gram", (F.col("band") - 1).alias("band"), F.col("head").alias("a"))
    steps = heads.join(upper, ["gram", "band"]).select("a", F.col("head").alias("b"))
    return components(ties.unionByName(steps))


class Trie:
    """Sets in global order, equal beginnings shared; a node holds a run of members' n-grams."""

    def __init__(self, sets: list[list[int]], sizes: list[int], alone: list[int]):
        """``sets`` are sorted among themselves; ``alone``: n-grams of each that no other set has."""
        self.nodes: list[tuple] = []
        self.sets = sets
        todo = [(0, len(sets), 0, -1)]
        self.below: list[list[int]] = []
        while todo:
            lo, hi, depth, parent = todo.pop()
            first, last = sets[lo], sets[hi - 1]
            end, most = depth, min(len(first), len(last))
            while end < most and first[end] == last[end]:
                end += 1
            k = len(self.nodes)
            self.nodes.append((lo, hi, first[depth:end], end, max(sizes[lo:hi]), min(sizes[lo:hi]), min(alone[lo:hi])))
            self.below.append([])
            if parent >= 0:
                self.below[parent].append(k)
            at = lo
            while at < hi and len(sets[at]) == end:
                at += 1  # these end here
            while at < hi:
                head, stop = sets[at][end], at + 1
                while stop < hi and sets[stop][end] == head:
                    stop += 1
                todo.append((at, stop, end, k))
                at = stop


def links(ids: list[int], sets: list[np.ndarray], num: int, den: int, sides: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Links that join the sets' components, not more than one fewer than sets. sides: only sets of 0 with sets of 1."""
    sizes = [len(x) for x in sets]
    if not any(sizes):
        return
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    single = int((counts == 1).sum())
    ranks = [rank[np.searchsorted(values, x)].astype(np.int32) for x in sets]
    named = np.arange(len(values)).astype(object)  # one number for an n-gram, in whichever sets it is
    del values, counts, rank
    rows = []
    for k, r in enumerate(ranks):
        alone = int((r < single).sum())
        if sizes[k] and alone <= sizes[k] - needed(sizes[k], num, den):  # else no other set can have enough of it
            rows.append((named[np.sort(r[r >= single])].tolist(), k, alone))
    rows.sort(key=lambda x: x[0])
    tree = rows if sides is None else [x for x in rows if sides[x[1]] == 1]
    probes = rows if sides is None else [x for x in rows if sides[x[1]] == 0]
    if not tree or not probes:
        return
    where = {k: i for i, (_, k, _) in enumerate(tree)}
    n_tree = [sizes[k] for _, k, _ in tree]
    a_tree = [a for _, _, a in tree]
    trie = Trie([s for s, _, _ in tree], n_tree, a_tree)
    label = np.array([k for _, k, _ in tree])  # component of each member of the tree
    mine = {k: k for _, k, _ in probes}  # and of each probe that is none
    for grams, k, alone in probes:
        have, size = set(grams), sizes[k]
        own = where.get(k, -1)
        c = label[own] if own >= 0 else mine[k]
        todo = [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            lo, hi, run, depth, longest, shortest, least_alone = trie.nodes[node]
            if hi <= own + 1 and own >= 0:
                continue  # met when those members walked
            if den * shortest * num > den * den * size or den * longest < num * size:
                continue
            if (label[lo:hi] == c).all():
                continue
            overlap += sum(g in have for g in run)
            # Y misses what it has of its own and what the walk did not find; X misses what lies behind the walk.
            missed = depth - overlap + least_alone
            if (num + den) * (longest - missed) < num * (size + longest):
                continue
            if run and alone + _passed(grams, run[-1]) - overlap > size - -(-num * (size + shortest) // (num + den)):
                continue
            at = lo
            while at < hi and len(trie.sets[at]) == depth:
                y = tree[at][1]
                if at > own and y != k and label[at] != c and den * overlap >= num * (size + n_tree[at] - overlap):
                    yield ids[k], ids[y]
                    label[label == label[at]] = c
                at += 1
            todo += [(b, overlap) for b in trie.below[node]]


def _passed(grams: list[int], last: int) -> int:
    from bisect import bisect_right

    return bisect_right(grams, last)


def _joined(docs: DataFrame, wanted: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links of the classes ``wanted`` (doc_id, set, node, block).

    Identifiers only choose the rows that are read again; a row's class is told by its set's hash, so rows that share
    an identifier, or have none, each meet their own class.
    """

    def sets(batches):
        unburdened()
        for batch in slices(batches):
            grams = [ngram_set(text, n).tobytes() for text in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, grams), pa.binary()), pa.array([len(g) // 8 for g in grams], pa.int64()), pa.array(grams, pa.binary())], ["set", "n", "grams"])

    def join(batches):
        unburdened()
        group, ids, held, sides = None, [], [], []
        for batch in batches:
            for key, node, side, grams in zip(*(x.to_pylist() for x in batch.columns)):
                if key != group:
                    yield from _linked(ids, held, sides, num, den)
                    group, ids, held, sides = key, [], [], []
                if ids and ids[-1] == node:
                    continue  # a class that several rows told
                ids.append(node)
                sides.append(side)
                held.append(np.frombuffer(grams, np.uint64))
        yield from _linked(ids, held, sides, num, den)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    named = rows.join(_small(wanted.where("doc_id IS NOT NULL").select("doc_id").distinct()), "doc_id", "left_semi")
    single = named.unionByName(rows.where("doc_id IS NULL")).dropDuplicates(["doc_id", "text"]).select("text")
    members = stored(single.mapInArrow(sets, "set binary, n long, grams binary").join(_small(wanted.select("set", "node", "block")), "set").drop("set"))
    parts = members.groupBy("block").agg(F.ceil(F.sum("n") / HELD * 2).cast("int").alias("parts"), F.max("n").alias("n")).withColumn("parts", F.when(F.col("parts") <= 2, 1).otherwise(F.col("parts")))
    large = stored(parts.where("parts > 1").select("block", "parts"))
    sized = members.join(_small(large), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), F.when(j == own, F.lit(-1)).otherwise((own > j).cast("int")).alias("side"))))
    dealt = sized.withColumn("cell", cells).select(F.concat_ws(":", "block", "cell.i", "cell.j").alias("key"), "node", F.col("cell.side").alias("side"), "grams")
    return stored(dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(join, "a long, b long"))


def _linked(ids, held, sides, num, den):
    found = list(links(ids, held, num, den, sides if sides and sides[0] >= 0 else None)) if len(ids) > 1 else []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(a row for each document: row, doc_id, n, set, ...; set, label, component_id and whether the set is its component's only one)."""
    summaries = stored(_summaries(docs, n, num, den))
    full = summaries.where("n > 0")
    classes = stored(full.groupBy("set").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")))
    nodes = stored(full.join(_small(classes.select(F.col("node").alias("row"))), "row").select(F.col("row").alias("node"), "n", "grams"))
    prefixes = stored(_prefixes(nodes, _hot(summaries), num, den))
    blocks = _blocks(prefixes, num, den)
    wanted = stored(classes.select("doc_id", "set", "node").join(blocks.withColumnRenamed("label", "block"), "node"))
    found = stored(components(_joined(docs, wanted, n, num, den)))
    named = classes.select("set", "node", F.col("doc_id").alias("least")).join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"), (F.count("*") == 1).alias("alone"))
    return summaries, stored(named.join(names, "label").select("set", "label", "component_id", "alone"))


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text): links from ``num / den`` up."""
    summaries, by_set = _components(docs, n, num, den)
    linked = summaries.where("n > 0").select("doc_id", "set", "n").join(by_set.select("set", "component_id"), "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = summaries.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text and other columns that have an order) with one row of each component.

    It is the one of the smallest identifier, rows without one last, then of the text and other columns that sort first. Rows that
    share an identifier but no component stay each, and so do rows without words. Copies are combined before they are shuffled.
    """
    _, by_set = _components(docs.select("doc_id", "text"), n, num, den)
    at, names = docs.columns.index("text"), docs.columns
    held = unlike(docs, "set")

    def told(batches):
        unburdened()
        for batch in slices(batches):
            grams = [ngram_set(text, n) for text in strings(batch.column(at))]
            own = pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in grams], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*names, held])

    rows = docs.mapInArrow(told, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{held}` binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text").alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))).alias("r")
    single = rows.where(F.col(held).isNotNull()).groupBy(F.col(held).alias("set")).agg(first).join(by_set.select("set", "label", "alone"), "set")
    several = single.where("not alone").groupBy("label").agg(F.min("r").alias("r"))
    chosen = single.where("alone").select("r").unionByName(several.select("r")).select(*(F.col(f"r.c{k}").alias(c) for k, c in enumerate(names)))
    return chosen.unionByName(rows.where(F.col(held).isNull()).select(*(f"`{c}`" for c in names)))
