"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items become lower-cased runs of letters, digits and underscores; features are five-word
shingles, weighted by how few items of the whole benchmark have them. For each item length, every window of that many words
that could still reach the threshold gets a 64-bit SimHash. A multi-index of 16-bit blocks finds all
items of that length within RADIUS bits: among four blocks at least one differs in at most RADIUS // 4
bits, and the index lists each item under all such values. Weighted Jaccard similarity of the shingles
then decides exactly.

A window reaches the threshold only if that share of its shingle weight belongs to items at all, so
other windows need no hash; nothing is lost by that. As no shingle weighs more than one that no item has, the share of known
shingles by number is at least that by weight.

* Up to ITEMS items: their index is broadcast, and one pass over the documents finds all.
* More items: a filter of all items' shingles (at most FILTER bits) is broadcast. One pass over the documents finds the stretches
  around known shingles. Stretches meet blocks of about ITEMS items by the shingles that they share, weights come from joins with the
  shingles' counts, and each block's index looks through its stretches, dealt out if they are many. The results are the same.

Defined results. Null and empty texts and items match nothing. Items shorter than five words are one
shingle of all their words. A text shorter than an item is one window. Repeated documents and items are each reported. ``clean``
passes all columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, slices, stored, strings, word_hashes

WORDS = 5
SHARE = 0.8
#: Bits by which a window's SimHash may differ; at a similarity of 0.8 about ten differ.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Items of an index. More are dealt into blocks of about as many.
ITEMS = 1000
#: Bits of the filter of all items' shingles at most: 32 MB.
FILTER = 1 << 28
#: Bytes of a bitmap that Spark aggregates.
PAGE = 4096
#: Stretches that a block's index looks through in one group.
STRETCHES = 2000
WORD = re.compile(r"\w+")


def words_of(text: str) -> np.ndarray:
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())])


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit, a row for each hash."""
    return np.unpackbits(h[:, None].view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _print(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of weighted signs; a tie counts as set."""
    return np.packbits(sums >= 0, axis=1).view(np.uint64).ravel()


def _ones(a: np.ndarray) -> np.ndarray:
    return np.unpackbits(a[:, None].view(np.uint8), axis=1).sum(axis=1)


class Item(NamedTuple):
    id: int | None
    n_words: int
    grams: np.ndarray
    weights: np.ndarray


class Index:
    """Items by length and by blocks of their fingerprints."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.bags = [bag(x.grams, x.weights) for x in items]
        self.prints = np.array([_print((_signs(x.grams) * x.weights[:, None]).sum(axis=0)[None])[0] for x in items], np.uint64)
        self.size = np.array([x.n_words for x in items])
        self.lengths = sorted(set(self.size.tolist()))
        near = [0, *(sum(1 << b for b in c) for n in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), n))]
        keys = [((self.prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF))[None] ^ np.array(near, np.uint64)[:, None] | np.uint64(b << BLOCK_BITS) for b in range(BLOCKS)]
        keys = np.concatenate(keys).astype(np.int32)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys = keys.ravel()[order]
        self.held = np.broadcast_to(np.arange(len(self.items), dtype=np.int32), keys.shape).ravel()[order]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS bits, each once."""
        pairs = []
        for b in range(BLOCKS):
            value = (((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)) | np.uint64(b << BLOCK_BITS)).astype(np.int32)
            lo, hi = np.searchsorted(self.keys, value), np.searchsorted(self.keys, value, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pairs.append(window * len(self.items) + self.held[at])
        found = np.unique(np.concatenate(pairs))
        window, item = found // len(self.items), found % len(self.items)
        close = _ones(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]

    def look(self, x: "Stretch", weight: np.ndarray, hit: np.ndarray, best: dict[int, tuple[float, int]]) -> None:
        """Take into ``best`` (item: similarity, first word) the windows of a stretch; ``hit``: which of its shingles items have."""
        s, sums = x.grams, None
        of_items = np.concatenate([[0.0], np.cumsum(weight * hit)])
        of_all = np.concatenate([[0.0], np.cumsum(weight)])
        longer = False
        for length in self.lengths:
            if min(WORDS, length) != x.k:
                continue
            n = min(length - x.k + 1, x.total)  # a text shorter than the item is one window
            if n > len(s) or longer:
                continue
            longer = n < length - x.k + 1  # all longer items have that window too
            starts = np.flatnonzero((of_items[n:] - of_items[:-n]) >= SHARE * (of_all[n:] - of_all[:-n]) - 1e-9)
            if not len(starts):
                continue
            if sums is None:
                sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_signs(s) * weight[:, None], axis=0)])
            window, item = self.near(_print(np.round(sums[starts + n] - sums[starts], 6)))
            fit = (self.size[item] >= length) if longer else (self.size[item] == length)
            for at, i in zip(starts[window[fit]].tolist(), item[fit].tolist()):
                v = similarity(bag(s[at : at + n], weight[at : at + n]), self.bags[i])
                if v >= SHARE - 1e-9 and v > best.get(i, (0.0, 0))[0]:
                    best[i] = (v, x.first + at)

    def told(self, best: dict[int, tuple[float, int]]) -> list[tuple]:
        """(item id, first word, words, similarity)."""
        return sorted(((self.items[i].id, start, int(self.size[i]), round(v, 6)) for i, (v, start) in best.items()), key=lambda r: (r[0] is not None, r))


def bag(grams: np.ndarray, weights: np.ndarray) -> dict[int, float]:
    out: dict[int, float] = defaultdict(float)
    for x, y in zip(grams.tolist(), weights.tolist()):
        out[x] += y
    return out


class Stretch(NamedTuple):
    """Shingles of ``k`` words from the word ``first`` on, of a text that has ``total`` of them."""

    first: int
    k: int
    total: int
    grams: np.ndarray


def stretches(text: str, lengths: list[int], known) -> list[tuple[Stretch, np.ndarray]]:
    """The stretches of a text within reach of shingles that ``known`` tells, and which those are."""
    words, out = words_of(text), []
    for k in sorted({min(WORDS, n) for n in lengths}):
        if len(words) < k:
            continue
        s = shingle_hashes(words, k)
        hit = known(s)
        if not hit.any():
            continue
        reach, at = max(lengths), np.flatnonzero(hit)
        for part in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1):
            lo, hi = max(0, part[0] - reach), min(len(s), part[-1] + reach + 1)
            out.append((Stretch(int(lo), k, len(s), s[lo:hi]), hit[lo:hi]))
    return out


class Whole:
    """All items in one index, with the weights of all shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        worded = [(i, w, shingle_hashes(w, WORDS)) for i, w in ((i, words_of(t or "")) for i, t in items) if len(w)]
        having = Counter(x for _, _, s in worded for x in set(s.tolist()))
        self.known = np.array(sorted(having), np.uint64)
        self.total = len(worded)
        self.of = weights_of(np.array([having[x] for x in self.known.tolist()]), self.total)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.index = Index([Item(i, len(w), s, self.weights(s)) for i, w, s in worded])

    def hits(self, s: np.ndarray) -> np.ndarray:
        hit = self.seen[(s & np.uint64((1 << 22) - 1)).astype(np.int64)]
        if hit.any():
            at = np.minimum(np.searchsorted(self.known, s[hit]), len(self.known) - 1)
            hit[hit] = self.known[at] == s[hit]
        return hit

    def weights(self, s: np.ndarray) -> np.ndarray:
        hit = self.hits(s)
        out = np.full(len(s), weights_of(np.zeros(1), self.total)[0])
        out[hit] = self.of[np.searchsorted(self.known, s[hit])]
        return out

    def matches(self, text: str) -> list[tuple]:
        """(item id, first word, words, similarity) of the best window of each item that the text has."""
        best: dict[int, tuple[float, int]] = {}
        for x, hit in stretches(text, self.index.lengths, self.hits):
            self.index.look(x, self.weights(x.grams), hit, best)
        return self.index.told(best)


def weights_of(having: np.ndarray, total: int) -> np.ndarray:
    """Weight of shingles by how many of ``total`` items have them; one that none has weighs as one that a single item has."""
    return 1.0 + np.log((total + 1.0) / np.maximum(having, 1))


def similarity(a: dict[int, float], b: dict[int, float]) -> float:
    """Weighted Jaccard: shared weight over all weight."""
    shared = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


FOUND = "doc_id long, item_id long, start long, n_words long, similarity double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 5, kinds)], [x.split()[0] for x in FOUND.split(", ")])


def _whole(items: DataFrame, session_items: int):
    """The broadcast index of all items, or None if there are more than ``session_items``."""
    if items.limit(session_items + 1).count() > session_items:
        return None
    return items.sparkSession.sparkContext.broadcast(Whole([tuple(r) for r in items.select(F.col("item_id").cast("long"), "text").collect()]))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the best window of each item in each document row that has it."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    held = _whole(items, ITEMS)
    if held is None:
        return _by_blocks(rows, items).select(*(x.split()[0] for x in FOUND.split(", ")))

    def scan(batches):
        for batch in slices(batches):
            yield _found([(i, *m) for i, t in zip(batch.column(0).to_pylist(), strings(batch.column(1))) for m in held.value.matches(t)])

    return rows.mapInArrow(scan, FOUND)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that have an item; rows and columns else as they are."""
    held = _whole(items, ITEMS)
    if held is None:
        # Whether a text has an item depends on the text alone, so texts are the key.
        key = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
        unlike = next(f"_key{k}" for k in range(len(docs.columns) + 1) if f"_key{k}" not in docs.columns)
        dirty = _by_blocks(docs.select(F.lit(0).cast("long").alias("doc_id"), "text"), items).select(F.col("text_key").alias(unlike)).distinct()
        return docs.withColumn(unlike, key).join(dirty, unlike, "left_anti").drop(unlike)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([not held.value.matches(t) for t in strings(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _shingled(items: DataFrame) -> DataFrame:
    """(item, item_id, n_words, k, grams) of the items that have words."""

    def shingles(batches):
        first = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            worded = [(i, w) for i, w in zip(batch.column(0).to_pylist(), map(words_of, strings(batch.column(1)))) if len(w)]
            columns = ([first + r for r in range(len(worded))], [i for i, _ in worded], [len(w) for _, w in worded], [shingle_hashes(w, WORDS).view(np.int64) for _, w in worded])
            first += len(worded)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["item", "item_id", "n_words", "grams"])

    return stored(items.select(F.col("item_id").cast("long"), "text").mapInArrow(shingles, "item long, item_id long, n_words long, grams array<long>"))


def _by_blocks(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``matches`` for any number of items, with text_key, the text's hash."""
    spark = rows.sparkSession
    shingled = _shingled(items)
    total = shingled.count()
    if not total:
        return spark.createDataFrame([], f"{FOUND}, text_key string")
    blocks = -(-total // ITEMS)
    lengths = [r[0] for r in shingled.select("n_words").distinct().collect()]  # a row for each length of an item
    grams = shingled.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), F.explode(F.array_distinct("grams")).alias("gram"))
    having = stored(grams.groupBy("gram").agg(F.count("*").alias("having")))
    bits = min(FILTER, 1 << max(16, int(16 * having.count()).bit_length()))
    place = F.pmod("gram", F.lit(bits))
    pages = having.groupBy(F.bitmap_bucket_number(place + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("set")).collect()  # bits / 8 bytes in all
    filled = np.zeros(-(-bits // (8 * PAGE)) * PAGE, np.uint8)
    for r in pages:
        filled[(r.page - 1) * PAGE : r.page * PAGE] = np.frombuffer(r.set, np.uint8)
    held = spark.sparkContext.broadcast(filled)

    def scan(batches):
        packed = held.value

        def known(s: np.ndarray) -> np.ndarray:
            at = (s.view(np.int64) % bits).astype(np.int64)
            return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            out = []
            for i, t in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                number += 1
                parts = stretches(t, lengths, known)
                key = hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() if parts else ""
                out += [(number, i, key, x.first, x.k, x.total, x.grams.view(np.int64)) for x, _ in parts]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 7, kinds)], ["number", "doc_id", "text_key", "first", "k", "total", "grams"])

    near = stored(rows.mapInArrow(scan, "number long, doc_id long, text_key string, first long, k int, total long, grams array<long>").withColumn("stretch", F.monotonically_increasing_id()))
    placed = near.select("stretch", F.posexplode("grams").alias("place", "gram")).join(having, "gram")
    told = stored(placed.groupBy("stretch").agg(F.collect_list(F.struct("place", "having")).alias("known")))  # a stretch is of one text
    of_blocks = grams.select("gram", "block").distinct()
    met = placed.select("stretch", "gram").join(of_blocks, "gram").select("stretch", "block").distinct()
    dealt = stored(near.join(told, "stretch").join(met, "stretch"))
    groups = dealt.groupBy("block").agg(F.ceil(F.count("*") / STRETCHES).cast("int").alias("groups"))
    part = F.pmod(F.xxhash64("number"), F.col("groups")).cast("int")  # a text's stretches stay together
    left = dealt.join(groups, "block").withColumn("part", part)
    weighed = shingled.join(shingled.select("item", F.explode("grams").alias("gram")).join(having, "gram").groupBy("item").agg(F.collect_list(F.struct("gram", "having")).alias("bag")), "item")
    right = weighed.select("item_id", "n_words", "bag", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).join(groups, "block")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def look(found: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if found.num_rows and held.num_rows:
            array = lambda of, name: np.array([x[name] for x in of], np.int64)
            index = Index([Item(i, n, array(b, "gram").view(np.uint64), weights_of(array(b, "having"), total)) for i, n, b in zip(*(held.column(c).to_pylist() for c in ("item_id", "n_words", "bag")))])
            rows = found.sort_by([("number", "ascending"), ("k", "ascending"), ("first", "ascending")])
            best: dict[int, tuple[float, int]] = {}
            text = None
            for number, doc_id, key, first, k, size, s, known in zip(*(rows.column(c).to_pylist() for c in ("number", "doc_id", "text_key", "first", "k", "total", "grams", "known"))):
                if text is not None and text[0] != number:
                    out += [(text[1], *m, text[2]) for m in index.told(best)]
                    best = {}
                text = (number, doc_id, key)
                hit, weight = np.zeros(len(s), bool), np.full(len(s), weights_of(np.zeros(1), total)[0])
                hit[array(known, "place")] = True
                weight[array(known, "place")] = weights_of(array(known, "having"), total)
                index.look(Stretch(first, k, size, np.array(s, np.int64).view(np.uint64)), weight, hit, best)
            out += [(text[1], *m, text[2]) for m in index.told(best)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
        return pa.table([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 6, kinds)], [x.split()[0] for x in FOUND.split(", ")] + ["text_key"])

    sides = (left.select("block", "part", "number", "doc_id", "text_key", "first", "k", "total", "grams", "known"), right.select("block", "part", "item_id", "n_words", "bag"))
    return sides[0].groupBy("block", "part").cogroup(sides[1].groupBy("block", "part")).applyInArrow(look, f"{FOUND}, text_key string")
