"""Positional signals: dinucleotide perplexity, its smoothing and the depression score.

A sequence is cut into pieces of positions, each with the letters that its positions depend on, and every piece is worked out as
arrays: letters are never rows, and nothing is shuffled. Only the results are rows, one for each position. A gap that is longer than
a piece's halo needs the nearest window without N on either side; the cut finds it in one pass and hands its letters on.

Pieces keep memory bounded, however long a sequence is. Those of long sequences are dealt out over all tasks, a byte for each letter,
so that few long sequences use the whole cluster. Running sums over a whole sequence are carried from piece to piece (``prefix_sums``);
sums over ranges are within a piece and its halo.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, reduce
from itertools import permutations
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import MICRO, Params, entropy_terms, hats
from ..sources.scratch import written

#: Positions of a piece that is worked out where its sequence is.
PIECE = 1 << 16
#: Rows of a batch that goes back to Spark.
ROWS = 1 << 16
#: Letters from which on a sequence is dealt out.
LONG = 1 << 20
#: Pieces of long sequences whose sums every task may hold.
CARRIES = 200_000


class Piece(NamedTuple):
    """Positions [low, high) of a signal of ``n``, and letters from position ``first`` on. Windows without N before and behind them, where there are any."""

    n: int
    low: int
    high: int
    first: int
    letters: bytes
    before: int | None
    before_letters: bytes | None
    after: int | None
    after_letters: bytes | None


def pieces(seq: bytes, p: Params, size: int, halo: int | None = None) -> Iterator[Piece]:
    n, halo = len(seq) - p.window + 1, p.halo if halo is None else halo
    whole = re.compile(b"[^N]{%d}" % p.window)
    before, passed, after = None, 0, -1
    for low in range(0, max(n, 0), size):
        high = min(low + size, n)
        first, last = max(low - halo, 0), min(high + halo, n)
        back = whole.search(seq[passed : first + p.window - 1][::-1]) if first > passed else None
        if back:
            before = first - 1 - back.start()
        passed = first
        if after is not None and after < last:
            found = whole.search(seq, last) if last < n else None
            after = found.start() if found else None
        at = lambda k: (k, None if k is None else seq[k : k + p.window])
        yield Piece(n, low, high, first, seq[first : last + p.window - 1], *at(before), *at(after))


class Places:
    """Where the positions of several pieces are that are worked out side by side, piece after piece, as one row of arrays."""

    def __init__(self, xs: list[Piece], p: Params):
        self.xs, self.skip = xs, p.window - 1
        self.sizes = np.array([len(x.letters) for x in xs], np.int64) - self.skip
        self.ends = np.cumsum(self.sizes)
        #: Where each piece's own positions begin among all own ones, and the end of the last.
        self.cuts = np.concatenate([[0], np.cumsum([x.high - x.low for x in xs])])

    def each(self, values) -> np.ndarray:
        """A value of each piece at all of its positions."""
        return np.repeat(np.asarray(values), self.sizes)

    @cached_property
    def piece(self) -> np.ndarray:
        return self.each(np.arange(len(self.xs)))

    @cached_property
    def start(self) -> np.ndarray:
        return self.each(self.ends - self.sizes)

    @cached_property
    def end(self) -> np.ndarray:
        return self.each(self.ends)

    @cached_property
    def row(self) -> np.ndarray:
        return np.arange(int(self.ends[-1]))

    @cached_property
    def letter(self) -> np.ndarray:
        return self.row + self.each(np.arange(len(self.xs)) * self.skip)

    @cached_property
    def pos(self) -> np.ndarray:
        return self.row + self.each([x.first for x in self.xs] - (self.ends - self.sizes))

    @cached_property
    def n(self) -> np.ndarray:
        return self.each([x.n for x in self.xs])

    @cached_property
    def own(self) -> slice | np.ndarray:
        """Positions that are the pieces' own."""
        if self.cuts[-1] == self.ends[-1]:
            return slice(None)
        return np.flatnonzero((self.pos >= self.each([x.low for x in self.xs])) & (self.pos < self.each([x.high for x in self.xs])))

    def some(self, ok: np.ndarray, p: Params) -> tuple[slice | np.ndarray, Places | None]:
        """Rows of the pieces that have a position that is ``ok``, and these pieces' places; None if there are none."""
        has = np.logical_or.reduceat(ok, self.ends - self.sizes)
        if has.all():
            return slice(None), self
        return np.flatnonzero(self.each(has)), Places([x for x, h in zip(self.xs, has) if h], p) if has.any() else None


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    out = np.full(256, -1, np.int8)
    out[list(b"ACGT")] = range(4)
    return out


def codes(letters: bytes) -> np.ndarray:
    """0 to 3 for A, C, G, T; -1 for N."""
    return _codes()[np.frombuffer(letters, np.uint8)]


def dinucleotides_of(code: np.ndarray) -> np.ndarray:
    """4 * code + next code with N as A, for all letters but the last."""
    known = np.maximum(code, 0)
    return 4 * known[:-1] + known[1:]


#: Weights of the counts 0 to 16 whose sums tell the partitions of 16, and with ones added those of less, from each other. Found by search.
WEIGHTS = (0, 0, 194, 175, 214, 180, 50, 246, 27, 172, 135, 217, 15, 73, 44, 162, 58)
_PAIRS, _QUADS = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def _partitions(m: int, most: int) -> Iterator[tuple[int, ...]]:
    if not m:
        yield ()
    for k in range(min(m, most), 0, -1):
        yield from ((k, *rest) for rest in _partitions(m - k, k))


def _perplexity(total: np.ndarray, m: int) -> np.ndarray:
    return 2.0 ** (math.log2(m) - total / float(m))


@lru_cache(maxsize=4)
def _by_counts(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Perplexity by the sum of a window's WEIGHTS, and whether it hangs on the order in which terms are added, by a rounding. (``sum`` would make up for roundings.)"""
    terms, value, open_ = entropy_terms(m), np.full(16 * 256, np.nan), np.zeros(16 * 256, bool)
    for counts in _partitions(m, m):
        totals = {reduce(add, (terms[c] for c in order), 0.0) for order in set(permutations([c for c in counts if c > 1]))}
        found = set(_perplexity(np.array(sorted(totals)), m).tolist())
        key = sum(WEIGHTS[c] for c in counts)
        value[key], open_[key] = min(found), len(found) > 1
    return value, open_


def _few(code: np.ndarray, ok: np.ndarray, m: int) -> np.ndarray:
    """``perplexities`` of windows of at most 16 dinucleotides: counts are bytes side by side in two running sums, and so few partitions of 16 there are that a table has each one's value."""
    shift = 8 * dinucleotides_of(code).astype(np.uint64)
    counts, key = [], 0
    some = np.flatnonzero(ok)
    every = 2 * len(some) > len(ok)
    for k in (0, 64):
        upto = np.zeros(len(code), np.uint64)
        np.cumsum(np.left_shift(np.uint64(1), shift - np.uint64(k)), out=upto[1:])  # a shift beyond 63 leaves nothing
        x = upto[m : m + len(ok)] - upto[: len(ok)] if every else upto[some + m] - upto[some]
        w = np.frombuffer(x.tobytes().translate(bytes(WEIGHTS).ljust(256, b"\0")), np.uint64)
        counts.append(x)
        key = key + (w & _PAIRS) + (w >> np.uint64(8) & _PAIRS)
    key = (key * _QUADS >> np.uint64(48)).view(np.int64)
    value, open_ = _by_counts(m)
    told, by_order = value.take(key), np.flatnonzero(open_.take(key))
    if len(by_order):
        terms, total = np.array(entropy_terms(m)), np.zeros(len(by_order))
        for x in counts:
            for d in range(8):
                total += terms[(x[by_order] >> np.uint64(8 * d) & np.uint64(255)).view(np.int64)]
        told[by_order] = _perplexity(total, m)
    if every:
        return np.where(ok, told, np.nan)
    out = np.full(len(ok), np.nan)
    out[some] = told
    return out


def perplexities(code: np.ndarray, p: Params) -> np.ndarray:
    """2 to the entropy of each window's dinucleotides; NaN where the window has an N. Counts are differences of running sums of a byte, as none is above 128."""
    n, m = len(code) - p.window + 1, max(p.window - 1, 1)
    masked = np.zeros(len(code) + 1, np.uint8)
    np.cumsum((code < 0).view(np.uint8), dtype=np.uint8, out=masked[1:])
    ok = masked[p.window : p.window + n] == masked[:n]
    if not ok.any():
        return np.full(n, np.nan)
    if 1 < p.window <= len(WEIGHTS):
        return _few(code, ok, m)
    din, terms, total = dinucleotides_of(code), np.array(entropy_terms(m)), np.zeros(n)
    upto = np.zeros(len(code) + 1, np.uint8)
    for d in range(16):
        np.cumsum(din == d, dtype=np.uint8, out=upto[1 : len(din) + 1])
        total += terms[upto[p.window - 1 : p.window - 1 + n] - upto[:n]]
    return np.where(ok, _perplexity(total, m), np.nan)


def _each(letters: list[bytes | None], p: Params) -> np.ndarray:
    """Perplexities of single windows; NaN where there is none."""
    out = np.full(len(letters), np.nan)
    given = [k for k, x in enumerate(letters) if x is not None]
    if given:
        out[given] = perplexities(codes(b"".join(letters[k] for k in given)), p)[:: p.window]
    return out


def filled(di: np.ndarray, at: Places, p: Params) -> np.ndarray:
    """``di`` with gaps filled linearly, and by the nearest value at the ends; NaN if all is."""
    ok = ~np.isnan(di)
    gap, known = np.flatnonzero(~ok), np.flatnonzero(ok)
    if not len(gap):
        return di
    held, piece, pos = np.concatenate([[-1], known, [len(di)]]), at.piece[gap], at.pos[gap]
    k = np.cumsum(ok)[gap]
    prv, nxt = held[k], held[k + 1]
    near, far = prv >= at.start[gap], nxt < at.end[gap]
    prv, nxt = np.maximum(prv, 0), np.minimum(nxt, len(di) - 1)
    outside = lambda values: np.array([np.nan if v is None else v for v in values], float)[piece]
    x0, x1 = np.where(near, at.pos[prv], outside([x.before for x in at.xs])), np.where(far, at.pos[nxt], outside([x.after for x in at.xs]))
    y0, y1 = np.where(near, di[prv], _each([x.before_letters for x in at.xs], p)[piece]), np.where(far, di[nxt], _each([x.after_letters for x in at.xs], p)[piece])
    between = y0 + (y1 - y0) / (x1 - x0) * (pos - x0)
    out = di.copy()
    out[gap] = np.where(np.isnan(y0), y1, np.where(np.isnan(y1), y0, between))
    return out


@lru_cache(maxsize=8)
def _hats(p: Params) -> np.ndarray:
    """``hats`` as one array, 0 beyond a window's width."""
    tables = hats(p)
    out = np.zeros((len(tables), 2 * len(tables) - 1, 2 * len(tables) - 1))
    for k, h in enumerate(tables):
        out[k, : len(h), : len(h)] = h
    return out


def smooth(values: np.ndarray, at: Places, p: Params) -> np.ndarray:
    """Savitzky-Golay values; the signal's ends follow the edge polynomial. Within half a window of a piece's cut they are not told."""
    full, _ = p.smoothing(1 << 30)
    if not full:
        return values
    table, h, pos = _hats(p), full // 2, at.pos
    out = np.full(len(values), np.nan)
    if len(values) >= full:
        inner, one = out[h : len(values) - h], np.empty(len(values) - 2 * h)
        np.multiply(table[h][h][0], values[: len(values) - 2 * h], out=inner)
        for k in range(1, full):
            inner += np.multiply(table[h][h][k], values[k : len(values) - 2 * h + k], out=one)
        out[(at.row - at.start < h) | (at.row >= at.end - h)] = np.nan
    edge = np.flatnonzero((pos < h) | (pos >= at.n - h) | (at.n < full))
    if len(edge):
        n, start, end = at.n[edge], at.start[edge], at.end[edge]
        size = np.minimum(full, n - (n % 2 == 0))
        begin = np.clip(pos[edge] - size // 2, 0, n - size)
        kind, place, total = (size - 1) // 2, pos[edge] - begin, np.zeros(len(edge))
        row = begin - pos[edge] + edge
        for k in range(full):
            total += table[kind, place, k] * values[np.clip(row + k, start, end - 1)]
        out[edge] = total
    return out


def micros(values: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Whole millionths, 0 where not ``ok``; the same arithmetic gives the same number in any engine."""
    return np.floor(np.where(ok & ~np.isnan(values), values, 0.0) * float(MICRO) + 0.5).astype(np.int64)


def range_sums(q: np.ndarray, ok: np.ndarray, at: Places, p: Params) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sum and number of the values of upstream, region and downstream around each position of the pieces' own, as differences of running sums; the number is 0 where a range leaves the signal."""
    size, room, out = len(q), at.n - at.pos, {}
    cs, cn = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    np.cumsum(np.where(ok, q, 0), out=cs[1:])
    np.cumsum(ok, out=cn[1:])
    for k, (a, b) in p.frames.items():
        total, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        low, high = max(-a, 0), min(size, size - b + 1)  # other rows' ranges leave their signals, or rows are of a halo
        if a < b and low < high:
            inside = (at.pos[low:high] >= -a) & (room[low:high] >= b)
            for sums, to in ((cs, total), (cn, count)):
                np.multiply(sums[low + b : high + b] - sums[low + a : high + a], inside, out=to[low:high])
        out[k] = total, count
    return out


def range_mean(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, total / np.maximum(count, 1) / float(MICRO), np.nan)


def depressions(ranges: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How far the region's mean lies under the mean of both sides; NaN unless under each, and where a range has no values."""
    total, count = ({k: v[j] for k, v in ranges.items()} for j in (0, 1))
    known = (count["up"] > 0) & (count["reg"] > 0) & (count["dn"] > 0)
    for k in ("up", "dn"):
        known &= total[k] * count["reg"] > total["reg"] * count[k]
    out, rows = np.full(len(known), np.nan), np.flatnonzero(known)
    up, reg, dn = (total[k][rows] / count[k][rows] for k in ("up", "reg", "dn"))
    out[rows] = ((up + dn) / 2.0 - reg) / float(MICRO)
    return out


class Signal(NamedTuple):
    """Perplexities, smoothed values and scores of positions in millionths, 0 where there are none, and where there are."""

    d: np.ndarray
    d_ok: np.ndarray
    q: np.ndarray
    v: np.ndarray
    v_ok: np.ndarray


def _perplexities(xs: list[Piece], at: Places, p: Params) -> np.ndarray:
    return perplexities(codes(b"".join(x.letters for x in xs)), p)[at.letter]


def _smoothed(di: np.ndarray, ok: np.ndarray, at: Places, p: Params, ranged: bool) -> tuple[np.ndarray, dict, slice | np.ndarray]:
    """Smoothed values in millionths, and if wanted ``range_sums`` at the rows told: those of pieces with a window without N, as others have no values."""
    q, ranges = np.zeros(len(di), np.int64), {}
    rows, some = at.some(ok, p)
    if some:
        q[rows] = part = micros(smooth(filled(di[rows], some, p), some, p), ok[rows])
        if ranged:
            ranges = range_sums(part, ok[rows], some, p)
    return q, ranges, rows


def piece_signals(xs: list[Piece], p: Params) -> list[Signal]:
    """All values of each piece's own positions; the pieces are worked out together."""
    at = Places(xs, p)
    di = _perplexities(xs, at, p)
    ok = ~np.isnan(di)
    q, ranges, rows = _smoothed(di, ok, at, p, True)
    pds = np.full(len(di), np.nan)
    if ranges:
        pds[rows] = depressions(ranges)
    has = ~np.isnan(pds)
    told = [a[at.own] for a in (micros(di, ok), ok, q, micros(pds, has), has)]
    return [Signal(*(a[low:high] for a in told)) for low, high in zip(at.cuts[:-1].tolist(), at.cuts[1:].tolist())]


def whole_signals(seqs: Iterable[bytes], p: Params) -> Iterator[Signal]:
    """All values of each sequence that one task holds, each with a window at least; long ones piece by piece."""
    parts: list[Signal] = []
    for held in _listed((x,) for seq in seqs for x in pieces(seq, p, PIECE)):
        for (x,), part in zip(held, piece_signals([x for (x,) in held], p)):
            parts.append(part)
            if x.high == x.n:
                yield parts[0] if len(parts) == 1 else Signal(*map(np.concatenate, zip(*parts)))
                parts = []


def whole_signal(seq: bytes, p: Params) -> Signal:
    return next(whole_signals([seq], p))


#: What a position can have, by name: the kind of its column.
TRACKS = {"code": "int", "din": "int", "di": "double", "x": "double", "q": "long", "smoothed": "double", "up": "double", "reg": "double", "dn": "double", "pds": "double"}
RANGES = {"up", "reg", "dn", "pds"}


def reach(p: Params, wanted: Iterable[str]) -> int:
    """Positions beyond a piece that the ``wanted`` values of its own depend on."""
    return p.halo if RANGES & set(wanted) else 2 * p.sg_window + 1


def worked_out(xs: list[Piece], p: Params, wanted: tuple[str, ...]) -> tuple[Places, dict[str, pa.Array]]:
    """The ``wanted`` values of the pieces' own positions, piece after piece."""
    at, wanted = Places(xs, p), set(wanted)
    own, out = at.own, {}
    if {"code", "din"} & wanted:
        code = codes(b"".join(x.letters for x in xs))
        din = np.append(dinucleotides_of(code), 0)  # a piece's last letter begins no window, unless it is one
        out["code"], out["din"] = (pa.array(a[at.letter][own].astype(np.int32)) for a in (code, din))
    if wanted <= out.keys():
        return at, out
    di = _perplexities(xs, at, p)
    ok = ~np.isnan(di)
    none = lambda a: pa.array(a[own], from_pandas=True)
    out["di"] = none(di)
    if wanted <= out.keys():
        return at, out
    if "x" in wanted:
        out["x"] = none(filled(di, at, p))
        if wanted <= out.keys():
            return at, out
    q, ranges, rows = _smoothed(di, ok, at, p, bool(RANGES & wanted))
    if "q" in wanted:
        out["q"] = pa.array(q[own], mask=~ok[own])
    if "smoothed" in wanted:
        out["smoothed"] = none(np.where(ok, q / float(MICRO), np.nan))
    for k in RANGES & wanted:
        values = np.full(len(di), np.nan)
        if ranges:
            values[rows] = depressions(ranges) if k == "pds" else range_mean(*ranges[k])
        out[k] = none(values)
    return at, out


def cut(sequences: DataFrame, p: Params, size: int, halo: int | None = None) -> DataFrame:
    """Pieces of ``size`` positions of every sequence (seq_idx, seq), dealt out over all tasks."""
    kind, names = dict(sequences.dtypes)["seq_idx"], Piece._fields
    schema = f"seq_idx {kind}, n int, low int, high int, first int, letters binary, before int, before_letters binary, after int, after_letters binary"

    def of(batches):
        for batch in batches:
            key_type = batch.schema.field(0).type
            for xs in _listed(((key.as_py(), x) for key, seq in zip(batch.column(0), batch.column(1)) for x in pieces(seq.as_py().encode(), p, size, halo))):
                columns = [pa.array(v, pa.binary() if "letters" in k else pa.int32()) for k, v in zip(names, zip(*(x for _, x in xs)))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in xs], key_type), *columns], ["seq_idx", *names])

    # With a number of tasks they are not coalesced by bytes: a letter's computation costs far more.
    return sequences.mapInArrow(of, schema).repartition(_tasks(sequences), "seq_idx", "low")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _listed(told: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Tuples that end with a piece in lists of about ROWS letters."""
    held, rows = [], 0
    for x in told:
        held.append(x)
        rows += len(x[-1].letters)
        if rows >= ROWS:
            yield held
            held, rows = [], 0
    if held:
        yield held


def _dealt(batches) -> Iterator[tuple]:
    """(seq_idx, piece) of rows of ``cut``, and of what stands before a piece, if rows have more."""
    for batch in batches:
        size = len(Piece._fields) + 1
        for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
            key, *rest = (v.as_py() for v in row)
            yield key, *rest[size - 1 :], Piece(*rest[: size - 1])


def _standing(batches, p: Params, halo: int) -> Iterator[tuple]:
    """(seq_idx, piece) of rows (seq_idx, seq)."""
    for batch in batches:
        for key, seq in zip(batch.column(0), batch.column(1)):
            for x in pieces(seq.as_py().encode(), p, PIECE, halo):
                yield key.as_py(), x


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _placed(keys: list, kind: str, at: Places, columns: dict) -> pa.RecordBatch:
    """``columns`` of all own positions with seq_idx, n and pos before them."""
    sizes = np.diff(at.cuts)
    seq_idx = pa.array(keys, _ARROW.get(kind)).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
    return pa.RecordBatch.from_arrays([seq_idx, pa.array(at.n[at.own].astype(np.int32)), pa.array(at.pos[at.own].astype(np.int32)), *columns.values()], ["seq_idx", "n", "pos", *columns])


def tracks(sequences: DataFrame, p: Params = Params(), chunk: int | None = None, wanted: tuple[str, ...] = ("di", "smoothed", "pds")) -> DataFrame:
    """(seq_idx, n, pos, and the ``wanted`` of TRACKS) for every window of every sequence; n is the length of the signal.

    Sequences are cut into pieces of ``chunk`` positions (PIECE, if not told) that are dealt out, a byte a letter, so that the table is read once; 0 cuts none, and
    all are worked out where they are.
    """
    kind, halo = dict(sequences.dtypes)["seq_idx"], reach(p, wanted)
    rows = sequences.where(F.length("seq") >= p.window).select("seq_idx", "seq")
    told = {"seq_idx": kind, "n": "int", "pos": "int"} | {k: TRACKS[k] for k in wanted}
    schema = ", ".join(f"{k} {t}" for k, t in told.items())

    def work(whole: bool):
        def of(batches):
            for held in _listed(_standing(batches, p, halo) if whole else _dealt(batches)):
                at, out = worked_out([x for _, x in held], p, wanted)
                yield _placed([k for k, _ in held], kind, at, {w: out[w] for w in wanted})

        return of

    if chunk == 0:
        return rows.mapInArrow(work(True), schema)
    return cut(rows, p, chunk or PIECE, halo).mapInArrow(work(False), schema)


def counts(sequences: DataFrame, p: Params = Params()) -> DataFrame:
    """(seq_idx, n_windows, n_di, n_smoothed, n_pds): how many values ``signals`` has of each sequence with a window. A task counts, so that positions are not rows."""
    kind, wanted = dict(sequences.dtypes)["seq_idx"], ("di", "smoothed", "pds")
    names = ["n_windows", *(f"n_{k}" for k in wanted)]

    def of(batches):
        for held in _listed(_dealt(batches)):
            at, out = worked_out([x for _, x in held], p, wanted)
            each = lambda has: np.add.reduceat(has.to_numpy(zero_copy_only=False), at.cuts[:-1], dtype=np.int64)
            columns = [pa.array([k for k, _ in held], _ARROW.get(kind)), pa.array(np.diff(at.cuts)), *(pa.array(each(out[k].is_valid())) for k in wanted)]
            yield pa.RecordBatch.from_arrays(columns, ["seq_idx", *names])

    rows = cut(sequences.where(F.length("seq") >= p.window).select("seq_idx", "seq"), p, PIECE, reach(p, wanted))
    parts = rows.mapInArrow(of, f"seq_idx {kind}, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("seq_idx").agg(*(F.sum(n).alias(n) for n in names))


def prefix_sums(sequences: DataFrame, p: Params = Params(), chunk: int | None = None) -> DataFrame:
    """(seq_idx, n, pos, cs, cn): sum and number of the smoothed values, in millionths, up to and with a position.

    A sequence of at most LONG letters is summed where it is. Longer ones, or all with ``chunk``, are a scan in two levels: sums of each piece, a row a piece; the sums of
    the pieces before it are joined to a piece, and it is summed from there on. Positions are rows only of the result.
    """
    kind, halo = dict(sequences.dtypes)["seq_idx"], reach(p, ("q",))
    rows = sequences.where(F.length("seq") >= p.window).select("seq_idx", "seq")
    schema = f"seq_idx {kind}, n int, pos int, cs long, cn long"

    def sums(xs: list[Piece]) -> tuple[Places, np.ndarray, np.ndarray]:
        """Running sum and number over all own positions of the pieces, with 0 before the first."""
        at, out = worked_out(xs, p, ("q",))
        zero = np.zeros(1, np.int64)
        return at, np.concatenate([zero, np.cumsum(out["q"].fill_null(0).to_numpy(zero_copy_only=False))]), np.concatenate([zero, np.cumsum(out["q"].is_valid().to_numpy(zero_copy_only=False))])

    def told(keys, at: Places, upto, base):
        sizes = np.diff(at.cuts)
        return _placed(keys, kind, at, {c: pa.array((u[1:] - np.repeat(np.array(b, np.int64), sizes)).astype(np.int64)) for c, u, b in zip(("cs", "cn"), upto, base)})

    def whole(batches):
        carried = (0, 0)
        for held in _listed(_standing(batches, p, halo)):
            at, *upto = sums([x for _, x in held])
            base: tuple[list, list] = ([], [])
            for k, (_, x) in enumerate(held):
                for b, u, c in zip(base, upto, carried):
                    b.append(u[at.cuts[k]] if x.low == 0 else b[-1] if b else -c)
            carried = tuple(int(u[-1] - b[-1]) for u, b in zip(upto, base))
            yield told([k for k, _ in held], at, upto, base)

    def totals(batches):
        for held in _listed(_dealt(batches)):
            at, *upto = sums([x for _, x in held])
            columns = [pa.array([k for k, _ in held], _ARROW.get(kind)), pa.array([x.low for _, x in held], pa.int32()), *(pa.array(np.diff(u[at.cuts]).astype(np.int64)) for u in upto)]
            yield pa.RecordBatch.from_arrays(columns, ["seq_idx", "low", "cs", "cn"])

    def carried_on(batches):
        for held in _listed(_dealt(batches)):
            at, *upto = sums([x for *_, x in held])
            base = [[u[c] - (h[k] or 0) for c, h in zip(at.cuts, held)] for k, u in zip((1, 2), upto)]
            yield told([h[0] for h in held], at, upto, base)

    def dealt(some: DataFrame) -> DataFrame:
        earlier = Window.partitionBy("seq_idx").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        totals_ = some.mapInArrow(totals, f"seq_idx {kind}, low int, cs long, cn long")
        carries = written(totals_.select("seq_idx", "low", F.sum("cs").over(earlier).alias("cs0"), F.sum("cn").over(earlier).alias("cn0")).where("low > 0"))
        carries = F.broadcast(carries) if carries.count() <= CARRIES else carries
        return some.join(carries, ["seq_idx", "low"], "left").select("seq_idx", *Piece._fields, "cs0", "cn0").repartition(_tasks(some), "seq_idx", "low").mapInArrow(carried_on, schema)

    if chunk == 0:
        return rows.mapInArrow(whole, schema)
    if chunk:
        return dealt(written(cut(rows, p, chunk, halo)))
    long = written(cut(rows.where(F.length("seq") > LONG), p, PIECE, halo))
    short = rows.where(F.length("seq") <= LONG).mapInArrow(whole, schema)
    return short if long.isEmpty() else short.unionByName(dealt(long))


def signals(sequences: DataFrame, p: Params = Params(), chunk: int | None = None) -> DataFrame:
    """(seq_idx, n, pos, di, smoothed, pds) for every window of every sequence."""
    return tracks(sequences, p, chunk)
