"""Parameters of an analysis and what follows from them on the driver: window geometry and smoothing weights."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

#: Quantisation of signals: values are whole multiples of one millionth where they are compared or summed.
MICRO = 1_000_000
EPSILON = 1e-9
TOP_N = 20


@dataclass(frozen=True)
class Params:
    """Ten whole numbers; ``of`` takes any keywords, makes them whole and ignores unknown ones."""

    window: int = 17
    sg_window: int = 21
    sg_order: int = 3
    flank: int = 100
    spacer: int = 50
    min_candidate: int = 50
    max_candidate: int = 1000
    min_region: int = 100
    max_region: int = 1000
    merge_gap: int = 100

    @classmethod
    def of(cls, **given) -> Params:
        names = {f.name for f in fields(cls)}
        return cls(**{k: int(v) for k, v in given.items() if k in names})

    def __post_init__(self):
        if not 1 <= self.window <= 128:
            raise ValueError("window must be from 1 to 128")
        if self.sg_window < 0 or self.sg_order < 0 or self.flank < 0 or self.spacer < 0:
            raise ValueError("widths must not be negative")

    @property
    def width(self) -> int:
        """Width of the candidate region around a position."""
        return min(max(round(math.sqrt(self.min_candidate * self.max_candidate)), self.min_candidate), self.max_candidate)

    @property
    def frames(self) -> dict[str, tuple[int, int]]:
        """Upstream, region and downstream as [from, to) relative to a position."""
        a = -(self.width // 2)
        b = a + self.width
        return {"up": (a - self.spacer - self.flank, a - self.spacer), "reg": (a, b), "dn": (b + self.spacer, b + self.spacer + self.flank)}

    @property
    def halo(self) -> int:
        """Positions beyond a chunk that its own positions depend on, besides gaps."""
        return max(-self.frames["up"][0], self.frames["dn"][1]) + 2 * self.sg_window + 1

    def smoothing(self, n: int) -> tuple[int, int]:
        """Window and order for a signal of ``n`` positions; (0, 0) leaves it as it is."""
        wl = min(self.sg_window, n)
        wl -= wl % 2 == 0
        po = min(self.sg_order, wl - 1)
        return (wl, po) if wl >= 3 and po >= 1 else (0, 0)


def hat(wl: int, po: int) -> list[list[float]]:
    """Row r: weights of the ``wl`` values of a window for the polynomial's value at its place r."""
    v = np.vander(np.arange(wl) - wl // 2, po + 1, increasing=True).astype(float)
    return (v @ np.linalg.pinv(v)).tolist()


def hats(p: Params) -> list[list[list[float]]]:
    """``hat`` for each odd window up to the full one, at (window - 1) / 2; a window of 1 is the identity."""
    full = p.sg_window - (p.sg_window % 2 == 0)
    return [hat(wl, min(p.sg_order, wl - 1)) if p.smoothing(wl) != (0, 0) else [[1.0 if r == k else 0.0 for k in range(wl)] for r in range(wl)] for wl in range(1, max(full, 1) + 1, 2)]


def entropy_terms(m: int) -> list[float]:
    """c * log2(c) for c = 0..m."""
    return [0.0] + [c * math.log2(c) for c in range(1, m + 1)]
