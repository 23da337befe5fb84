"""Packing documents into sequences of a fixed number of tokens by bin completion.

Documents become pieces (only those longer than a sequence are cut). How pieces combine depends on
their lengths alone, and there are at most ``size`` lengths however many documents there are: the plan
is made from that bounded histogram. Bin completion takes the longest remaining length, enumerates the
undominated fillings of the rest of its sequence, prunes by the waste that the incumbent still allows,
and applies each filling as often as the counts permit. The first incumbents are best-fit decreasing's plan and
the plan of completing each sequence by its heaviest filling. Branch-and-bound then runs on a few sequences of the better one at a time,
which are the incumbent of that search, and at last over the whole histogram; where a plan meets the lower bound there is nothing to search.

A piece finds its place by its rank among the pieces of its length: a task numbers its own pieces, and
the numbers before it come from counts by task and length. No text or id is shuffled.

Defined results. Null and empty texts are the end id alone. Rows that repeat an identifier are packed as
they come. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are not carried.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, slices, stored, strings

Plan = list[tuple[tuple[int, ...], int]]
#: Rows of the rank table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Sequences that are searched together, at most, and fillings tried in each such search.
FEW, FEW_NODES = 6, 300


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, after a shorter first one if need be."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return [(0, first)] * bool(first) + [(s, size) for s in range(first, n, size)]


PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, rank long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """The pieces of ``docs`` as a stored table, each numbered among those of its length in its task."""

    def cut(batches):
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                ids = encode.encode(text) + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                    rows.append((doc_id, k, start, length, ids[4 * start : 4 * (start + length)], task, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES))


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No plan has fewer sequences: total length, and lengths over a half that nothing small enough completes."""
    best = math.ceil(sum(n * c for n, c in counts.items()) / size)
    for least in {0, *(n for n in counts if n <= size // 2)}:
        alone = sum(c for n, c in counts.items() if n > size - least)
        halves = [(n, c) for n, c in counts.items() if size // 2 < n <= size - least]
        room = sum((size - n) * c for n, c in halves)
        small = sum(n * c for n, c in counts.items() if least <= n <= size // 2)
        best = max(best, alone + sum(c for _, c in halves) + max(0, math.ceil((small - room) / size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing over whole lengths at a time."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left: [lengths, how many such sequences]
    for n in sorted(counts, reverse=True):
        left = counts[n]
        for room in sorted(r for r in open_ if r >= n):
            while left and room >= n and open_[room]:
                lengths, times = open_[room].pop()
                each = min(room // n, max(1, -(-left // times)))
                used = min(times, left // each)
                if not used:
                    each, used = left, 1
                if used < times:
                    open_[room].append([lengths, times - used])
                open_[room - each * n].append([lengths + (n,) * each, used])
                left -= each * used
        if left:
            each = min(size // n, left)
            used, rest = divmod(left, each)
            open_[size - each * n].append([(n,) * each, used])
            if rest:
                open_[size - rest * n].append([(n,) * rest, 1])
    return [(lengths, times) for kept in open_.values() for lengths, times in kept if times]


def completed(counts: dict[int, int], size: int) -> Plan:
    """Bin completion without going back: the longest piece's sequence gets the filling that wastes least.

    Of those it takes the one of the greatest sum of squares, which no filling with a longer piece in place of its own ones dominates,
    as often as the counts permit. A step uses up all of some length but for less than a filling takes, so there are
    few for each length, however many pieces there are.
    """
    left, out = dict(counts), []
    while left:
        longest = max(left)
        left[longest] -= 1
        filling = Counter([longest, *_heaviest(left, size - longest)])
        left[longest] += 1
        times = min(left[n] // k for n, k in filling.items())
        out.append((tuple(filling.elements()), times))
        for n, k in filling.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _heaviest(counts: dict[int, int], room: int) -> list[int]:
    """The pieces of greatest total up to ``room`` and of the greatest sum of squares among those: a knapsack over exact totals."""
    best = np.full(room + 1, -1, np.int64)
    best[0] = 0
    steps = []
    for n in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        most, k = min(counts[n], room // n), 1
        while most:
            k = min(k, most)
            tried = np.where(best[: room + 1 - k * n] >= 0, best[: room + 1 - k * n] + k * n * n, -1)
            better = np.concatenate([np.zeros(k * n, bool), tried > best[k * n :]])
            best[k * n :] = np.maximum(best[k * n :], tried)
            steps.append((n, k, better))
            most -= k
            k *= 2
    total, out = int(np.flatnonzero(best >= 0)[-1]), []
    for n, k, better in reversed(steps):
        if better[total]:
            out += [n] * k
            total -= n * k
    return out


def improved(plan: Plan, size: int, least: int, rounds: int) -> Plan:
    """``plan`` after rounds of branch-and-bound over the pieces of a few of its sequences, which are the incumbent of their own search.

    What a round finds stays if its waste lies in fewer or emptier sequences (by the sum of squares), so that in the end a sequence
    can go. Ends as ``least`` sequences are left, after ``rounds`` without a better result, or five times as many in all. Alike at any
    number of pieces: it draws from the different fillings.
    """
    draw, held = random.Random(0), Counter()
    for f, times in plan:
        held[tuple(sorted(f, reverse=True))] += times
    kinds, total = list(held), sum(held.values())
    place = {f: k for k, f in enumerate(kinds)}

    def put(f: tuple[int, ...]) -> None:
        if not held[f]:
            place[f] = len(kinds)
            kinds.append(f)
        held[f] += 1

    def take(wasteful: bool) -> tuple[int, ...]:
        f = draw.choice(kinds)
        for _ in range(8):
            if not wasteful or sum(f) < size:
                break
            f = draw.choice(kinds)
        held[f] -= 1
        if not held[f]:
            last, k = kinds.pop(), place.pop(f)
            if last != f:
                kinds[k], place[last] = last, k
        return f

    idle = 0
    for _ in range(5 * rounds):
        if total <= least or not kinds or idle >= rounds:
            break
        old = [take(True)]
        number = draw.randint(2, FEW)
        while len(old) < number and kinds:
            old.append(take(draw.random() < 0.4))
        new, better = _few(old, size, FEW_NODES, draw)
        idle = 0 if better else idle + 1
        total += len(new) - len(old)
        for f in new:
            put(tuple(sorted(f, reverse=True)))
    return [(f, times) for f, times in held.items() if times]


def _few(old: list[tuple[int, ...]], size: int, nodes: int, draw: random.Random) -> tuple[list[tuple[int, ...]], bool]:
    """Bin completion of the pieces of ``old``: as few sequences and as uneven waste as a search of ``nodes`` fillings finds.

    A sequence that is not needed counts as one that wastes all its room, so the sum of squared waste covers both. A branch
    ends where even all waste that is left over, put together in as few sequences as can hold it, makes no greater sum. Also says
    whether the result is better; one that is as good as ``old`` may come in its place.
    """
    before = sum((size - sum(f)) ** 2 for f in old)
    best, worth, looks = old, before - 1, [nodes]

    def branch(left: list[int], filled: list[tuple[int, ...]], squares: int, spare: int) -> None:
        nonlocal best, worth
        empty, over = divmod(spare, size)
        if squares + empty * size * size + over * over <= worth:
            return
        if not left:
            best, worth = filled, squares + (len(old) - len(filled)) * size * size
            return
        for f in _fillings_of(left[1:], size - left[0], spare, draw, looks):
            rest, waste = left[1:], size - left[0] - sum(f)
            for n in f:
                rest.remove(n)
            branch(rest, [*filled, (left[0], *f)], squares + waste * waste, spare - waste)

    branch(sorted(chain(*old), reverse=True), [], 0, len(old) * size - sum(map(sum, old)))
    return best, worth > before


def _fillings_of(pieces: list[int], room: int, most: int, draw: random.Random, looks: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` from a few pieces, least waste first, up to ``most``; those of equal waste in a drawn order.

    Each filling is made once, and each that is made, dominated or not, is one of the ``looks`` left.
    """
    have = sorted(Counter(n for n in pieces if n <= room).items())
    draw.shuffle(have)
    sums, full = [1], (1 << room + 1) - 1
    for n, left in have:
        bits, step = sums[-1], 1
        while left:
            step = min(step, left)
            bits |= bits << n * step & full
            left -= step
            step *= 2
        sums.append(bits)

    def exact(k: int, left: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        for j in range(k - 1, -1, -1):
            if not sums[j + 1] >> left & 1:
                return
            n, c = have[j]
            for times in range(min(c, left // n), 0, -1):
                if sums[j] >> left - times * n & 1:
                    for rest in exact(j, left - times * n):
                        yield (n,) * times + rest

    for waste in range(min(room, most) + 1):
        for f in exact(len(have), room - waste) if sums[-1] >> room - waste & 1 else ():
            looks[0] -= 1
            if looks[0] < 0:
                return
            if not waste or not any(x < n <= x + waste for n, c in have if c > f.count(n) for x in {0, *f}):
                yield f


class _Search:
    """Bin completion over a histogram of lengths.

    The whole pass takes a branch's fillings as they are found and leaves out none that could beat the incumbent. The narrow
    pass tries at each branch the WIDTH of fewest pieces among the first LOOK, and so reaches far decisions soon. Each has
    ``nodes``, and LOOK fillings for each node, and ends as the lower bound is met.
    """

    LOOK = 64
    WIDTH = 3
    PASSES = ((1, True), (LOOK, False))  # fillings to choose from at first, whether all others follow

    def __init__(self, counts: dict[int, int], size: int, nodes: int):
        self.size, self.nodes = size, nodes
        self.counts = [0] * (size + 1)
        for n, c in counts.items():
            self.counts[n] = c
        self.total = sum(n * c for n, c in counts.items())
        self.least = lower_bound(counts, size)
        plans = [best_fit(counts, size)]
        if sum(t for _, t in plans[0]) > self.least:
            plans.append(completed(counts, size))
        self.most, self.best = min(((sum(t for _, t in x), x) for x in plans), key=lambda x: x[0])
        draw = random.Random(0)
        self.marks = [draw.getrandbits(128) for _ in range(size + 1)]
        self.seen: dict[int, int] = {}  # sequences before, by what is left (sum of its marks)

    def fillings(self, room: int, c: list[int], most: int) -> Iterator[tuple[int, ...]]:
        """Undominated fillings of ``room`` from ``c``, least waste first, up to ``most``: none leaves space for another piece, or for a longer one in place of one of its own."""
        have = [n for n in range(1, room + 1) if c[n]]
        full = (1 << room + 1) - 1
        sums = [1]  # bits: what the first so many lengths of ``have`` add up to; all else adds nothing once all bits are set
        for n in have:
            bits, left, step = sums[-1], min(c[n], room // n), 1
            while left:
                step = min(step, left)
                bits |= bits << n * step & full
                left -= step
                step *= 2
            sums.append(bits)
            if bits == full:
                break

        def reached(k: int, x: int) -> int:
            return sums[min(k, len(sums) - 1)] >> x & 1

        def exact(k: int, left: int) -> Iterator[tuple[int, ...]]:
            """Fillings of just ``left`` from the first ``k`` lengths, longest pieces first."""
            if not left:
                yield ()
                return
            for j in range(min(k, bisect_right(have, left)) - 1, -1, -1):
                if not reached(j + 1, left):
                    return
                n = have[j]
                for times in range(min(c[n], left // n), 0, -1):
                    if reached(j, left - times * n):
                        for rest in exact(j, left - times * n):
                            yield (n,) * times + rest

        def dominated(f: tuple[int, ...], waste: int) -> bool:
            return any(c[n] > f.count(n) for x in {0, *f} for n in have[bisect_right(have, x) : bisect_right(have, x + waste)])

        for waste in range(min(room, most) + 1):
            if reached(len(have), room - waste):
                for f in exact(len(have), room - waste):
                    self.looks -= 1
                    if self.looks < 0:
                        return
                    if not waste or not dominated(f, waste):
                        yield f

    def choices(self, longest: int, most: int, look: int, whole: bool) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings of the longest piece's sequence, each as often as the counts permit, then each less often."""
        room, c = self.size - longest, list(self.counts)
        c[longest] -= 1

        def often(f: tuple[int, ...]) -> int:
            return min((c[n] + (n == longest)) // f.count(n) for n in set(f))

        more = False
        found = self.fillings(room, c, most)
        first = sorted(islice(found, look), key=lambda f: (room - sum(f), len(f)))
        for rest in chain(first, found) if whole else first[: self.WIDTH]:
            f = (longest, *rest)
            more = more or often(f) > 1
            yield f, often(f)
        for rest in self.fillings(room, c, most) if more and whole else ():
            f = (longest, *rest)
            for times in range(often(f) - 1, 0, -1):
                yield f, times

    def run(self) -> Plan:
        if self.most > self.least:
            self.best = improved(self.best, self.size, self.least, self.nodes)
            self.most = sum(t for _, t in self.best)
        for look, whole in self.PASSES:
            self._pass(look, whole)
        return self.best

    def _pass(self, look: int, whole: bool) -> None:
        """Depth first; a node is left as soon as its waste rules out a better plan than the incumbent, or if what is left was met before."""
        plan: Plan = []
        counts, left = list(self.counts), self.nodes
        self.seen.clear()
        self.looks = self.nodes * self.LOOK
        key = sum(c * m for c, m in zip(self.counts, self.marks))
        waste = used = 0
        longest = [max(n for n, c in enumerate(self.counts) if c)]
        stack = [self.choices(longest[0], (self.most - 1) * self.size - self.total, look, whole)]
        while stack and self.most > self.least and left > 0:
            chosen = next(stack[-1], None)
            if chosen:
                left -= 1
                lengths, times = chosen
                sign = 1
                plan.append(chosen)
            else:
                stack.pop()
                longest.pop()
            while True:
                if not chosen:  # undo
                    if not plan:
                        break
                    lengths, times = plan.pop()
                    sign = -1
                for n in lengths:
                    self.counts[n] -= sign * times
                    key -= sign * times * self.marks[n]
                used += sign * times
                waste += sign * times * (self.size - sum(lengths))
                if sign < 0:
                    break
                top = longest[-1]
                while top and not self.counts[top]:
                    top -= 1
                if not top and used < self.most:
                    self.best, self.most = list(plan), used
                spare = (self.most - 1) * self.size - self.total - waste
                if top and spare >= 0 and self.seen.get(key, used + 1) > used:
                    self.seen[key] = used
                    longest.append(top)
                    stack.append(self.choices(top, spare, look, whole))
                    break
                chosen = None
        self.counts = counts


def plan(counts: dict[int, int], size: int = 1024, nodes: int = 20_000) -> Plan:
    """Which lengths share a sequence, and how often; lengths of ``size`` are none of its business."""
    counts = {n: c for n, c in counts.items() if c and n < size}
    return _Search(counts, size, nodes).run() if counts else []


def segments(plan: Plan) -> tuple[np.ndarray, ...]:
    """By (length, rank): first sequence and offset of each run of ranks. Sorted; at most a run for each place of a plan."""
    seen: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append((n, seen[n], base, offset))
            seen[n] += times
            offset += n
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return (a[:, 0] << 44) + a[:, 1], a[:, 2] - a[:, 1], a[:, 3], np.int64(base)


def place(parts: DataFrame, size: int = 1024, nodes: int = 20_000) -> DataFrame:
    """``parts`` (length, task, rank and any other columns) with sequence_id and offset in place of task and rank."""
    counted = stored(parts.groupBy("length", "task").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sums = counted.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # a row for each length
    starts, first, offsets, n_planned = segments(plan({r.length: r.n for r in sums}, size, nodes))
    small = sum(r.rows for r in sums) <= BROADCAST_ROWS
    kept = [c for c in parts.columns if c not in ("task", "rank")]
    ranked = parts.join(F.broadcast(bases) if small else bases, ["length", "task"]).select(*kept, (F.col("base") + F.col("rank")).alias("_rank"))
    at = kept.index("length")

    def seats(batches):
        for batch in batches:
            length, rank = batch.column(at).to_numpy().astype(np.int64), batch.column(len(kept)).to_numpy()
            sequence, offset = n_planned + rank, np.zeros(len(rank), np.int64)
            part = length < size
            k = np.searchsorted(starts, (length[part] << 44) + rank[part], "right") - 1
            sequence[part], offset[part] = first[k] + rank[part], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in parts.select(*kept).dtypes)
    return ranked.mapInArrow(seats, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, nodes: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    return place(pieces(docs, tokenizer, end_id, size), size, nodes)
