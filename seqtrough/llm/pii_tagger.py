"""Personal data by patterns and by a character-level bidirectional LSTM with a CRF on top.

The patterns' spans (``base_spans``) always stay. The tagger reads every character of every text, in windows
that overlap; each is decoded by Viterbi with learned transitions, and its spans are reconciled over the whole
text: parts of a span that neighbouring windows cut are joined, what stays cut at a window's edge is left to the
window that has it whole, and of spans that overlap the one with the better score stays. A reconciled span is
added if it meets no span of the patterns and its digits are sound (a card's checksum, an address's ranges, a phone's length).
So it finds what no pattern of the four says: secrets after their names, addresses with "(at)" and "[dot]",
numbers with other separators, and what a pattern's leftmost match spoils.

The tagger is trained in numpy, once for each driver process, on labelled spans that ``labelled`` makes from a seed, so
every process trains the same weights, whatever the table. Its activations are rational, which numpy computes fast.

Defined results. Null and empty texts have no spans. Repeated rows are tagged each. ``masked`` and
``tagged`` pass other columns through; columns that are added replace input columns of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, strings

#: Kinds of the patterns, and all kinds of the tagger.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Characters of a window at most, of an overlap, and of a window in training.
WINDOW, OVERLAP, TAUGHT = 1024, 64, 80
EMBED, HIDDEN = 8, 12
#: Windows that are decoded at a time.
BATCH = 256

Span = tuple[str, int, int]

#: The patterns of each kind, guarded so that no place is tried twice.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")  # every pattern needs one of these


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def proper(kind: str, s: str) -> bool:
    """Whether a match of the kind's pattern is what the kind means."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        else:
            last = max(last, at + 1)  # no local part goes over an @
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[Span]:
    """The patterns' proper matches by kind, then by place."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if proper(kind, m.group())]
    return out


def sound(kind: str, s: str) -> bool:
    """Whether the digits of a span that the tagger found can be of its kind."""
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        return ":" in s or (len(parts := re.findall("[0-9]+", s)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts))
    if kind == "phone":
        return 7 <= len(d) <= 15
    return len(s) >= 6 if kind == "secret" else len(s) <= 320  # the longest address of mail


# --- characters -----------------------------------------------------------------------------------

DIGIT, LETTER, OTHER = 1, 2, 3  # 0 pads; then any other character of ASCII is its own class, digits are one
CLASSES = 4 + 128


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """The class of each character up to 0xFFFF; those above it are as the last."""
    out = np.full(0x10000, OTHER, np.uint8)
    out[[c for c in range(128, 0x10000) if chr(c).isalpha()]] = LETTER
    out[:128] = 4 + np.arange(128)
    out[48:58] = DIGIT
    return out


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _table()[np.minimum(codes, 0xFFFF)]


# --- labelled spans -------------------------------------------------------------------------------

#: Names that stand before secrets, and letters of invented words by frequency.
SECRET_NAMES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key", "auth", "key", "pwd", "Bearer")
FREQUENT = "etaoinshrdlucmfwypvbgkjqxzéäñöüßçèêóí"


class _Writer:
    """Makes invented text with personal data of every kind in it."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        x = options[self.rng.integers(0, len(options))]
        return x() if callable(x) else x

    def word(self, low: int = 1, high: int = 10) -> str:
        return "".join([FREQUENT[min(k, len(FREQUENT)) - 1] for k in self.rng.geometric(0.11, self.rng.integers(low, high))])

    def plain(self, low: int = 2, high: int = 10) -> str:
        return self.word(low, high).encode("ascii", "ignore").decode() or "ab"

    def of(self, alphabet: str, low: int, high: int) -> str:
        return "".join([alphabet[k] for k in self.rng.integers(0, len(alphabet), self.rng.integers(low, high + 1))])

    def digits(self, low: int, high: int | None = None) -> str:
        return self.of("0123456789", low, high or low)

    # Each of these gives the text before the span, the span, and the text after it.

    def email(self) -> tuple[str, str, str]:
        local = self.pick(self.plain, lambda: f"{self.plain()}.{self.digits(2)}", lambda: f"{self.plain()}.{self.plain()}", lambda: f"{self.plain()}_{self.plain()}{self.digits(1, 3)}", lambda: f"{self.plain()}+{self.plain()}")
        names = [self.pick(self.plain, lambda: f"{self.plain()}{self.digits(1)}") for _ in range(self.rng.integers(1, 3))] + [self.pick("com", "org", "net", "de", "fr", "example.com")]
        if self.rng.random() < 0.6:
            return "", f"{local}@{'.'.join(names)}", ""
        at, dot = self.pick((" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", "."), (" @ ", "."))
        return "", f"{local}{at}{dot.join(names)}", ""

    def ip(self) -> tuple[str, str, str]:
        parts = [str(x) for x in self.rng.integers(0, 256, 4)]
        groups = [self.of("0123456789abcdef", 1, 4) for _ in range(8)]
        return self.pick(("", ".".join(parts), ""), ("", ".".join(parts), ""), ("", ".".join(parts), f":{self.digits(2, 5)}"), ("", " . ".join(parts), ""), ("", "[.]".join(parts), ""), ("", ":".join(groups), ""))

    def card(self) -> tuple[str, str, str]:
        d = self.digits(12, 18)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        mark = self.pick("", "", " ", "-", ".", "/", "  ", "_")
        return "", mark.join(re.findall(".{1,4}", d)), ""

    def phone(self) -> tuple[str, str, str]:
        a, b, c, n = self.digits(3), self.digits(3), self.digits(4), self.digits(1, 2)
        return "", self.pick(f"+{n} ({a}) {b}-{c}", f"+{n} {a} {b} {c}", f"+{n}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{n}/{a}/{b}{c}", f"00{n} {a} {b} {c}", f"+{n}.{a}.{b}.{c}"), ""

    def secret(self) -> tuple[str, str, str]:
        upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        if self.rng.random() < 0.3:
            return self.pick(("", "AKIA" + self.of(upper, 16, 16), ""), ("", "ghp_" + self.of(mixed, 36, 36), ""), ("", "sk-" + self.of(mixed, 20, 48), ""))
        name = self.pick(*SECRET_NAMES)
        name = self.pick(name, name, name.upper(), name.capitalize(), f"{self.plain()}_{name}")
        value = self.pick(lambda: self.of("0123456789abcdef", 16, 44), lambda: self.of("0123456789ABCDEF", 16, 44), lambda: self.of(mixed, 10, 40), lambda: self.of("0123456789abcdef", 8, 16), lambda: self.plain(5, 9) + self.digits(2, 5) + self.pick("", "!", "#", "$"))
        if name == "Bearer":
            return "Bearer ", value, ""
        quote = self.pick("", '"', "'")
        return f"{name}{self.pick('=', ' = ', ': ', ':')}{quote}", value, quote

    def noise(self) -> str:
        """What looks like personal data and is none."""
        name = self.pick(*SECRET_NAMES)
        return self.pick(
            lambda: self.digits(1, 8), lambda: f"{self.digits(1, 3)}.{self.digits(1, 2)}", lambda: f"v{self.digits(1)}.{self.digits(1)}.{self.digits(1)}", lambda: f"@{self.word()}", lambda: f"{self.word()} @",
            lambda: f"(c) {self.digits(4)}", lambda: f"{self.digits(4)}-{self.digits(2)}-{self.digits(2)}", lambda: f"{self.digits(2)}:{self.digits(2)}", lambda: f"{self.digits(1, 3)},{self.digits(3)}", lambda: f"${self.digits(1, 4)}", lambda: f"http://{self.plain()}.{self.plain()}.org/{self.plain()}/{self.digits(1, 4)}",
            lambda: f"the {name} of", lambda: f"{name}, {self.word()}", lambda: f"{name}: {self.word()} {self.word()}", lambda: f"{self.plain()} = {self.digits(1, 3)}", lambda: f"{self.plain()}={self.plain()}", lambda: f"at {self.word()}", lambda: f"{self.word()} dot", lambda: f"{self.plain()}.{self.plain()}", lambda: f"{self.plain()}-{self.plain()}-{self.plain()}",
            lambda: " ".join([self.pick(self.plain, lambda: self.plain().capitalize())] * int(self.rng.integers(3, 14))), lambda: f"{self.word()}. " * int(self.rng.integers(3, 9)), lambda: self.plain().upper(), lambda: self.plain(8, 24), lambda: f"<{self.plain()}>", lambda: f"[{self.digits(1, 2)}]", lambda: f"{self.digits(2, 3)}%",
        )

    def text(self, size: int, share: float) -> tuple[str, list[Span]]:
        out, spans = "", []
        shout, junk = self.rng.random() < 0.1, self.rng.random() < 0.15
        while True:
            draw, more = self.rng.random(), []
            if draw < share:
                kind = KINDS[self.rng.integers(0, len(KINDS))]
                before, s, after = getattr(self, kind)()
                more = [(kind, len(out) + len(before), len(out) + len(before) + len(s))]
                piece = before + s + after
            elif draw < share + 0.09:
                piece = self.noise()
            else:
                piece = self.word()
                piece = piece.upper() if shout else piece.capitalize() if self.rng.random() < 0.15 else piece
            if len(out) + len(piece) > size:
                return out, spans
            spans += more
            end = self.rng.choice(5, p=[0.77, 0.11, 0.09, 0.02, 0.01])
            out += piece + (self.pick("***", "###", "$$$", "%%%", "&&&") if junk and self.rng.random() < 0.7 else "!!" if shout else ["", ".", ",", ":", ";"][end])
            out += " " if self.rng.random() < 0.94 else "\n"


def labelled(n: int, seed: int, size: int = TAUGHT, share: float = 0.09) -> list[tuple[str, list[Span]]]:
    """Invented texts of up to ``size`` characters with the spans of personal data in them."""
    writer = _Writer(seed)
    return [(t[:size], x) for t, x in (writer.text(size, share) for _ in range(n))]


# --- the network ----------------------------------------------------------------------------------


def _squashed(z: np.ndarray, room: np.ndarray) -> np.ndarray:
    """z / (1 + |z|) in place: between -1 and 1, and a tenth of what a hyperbolic tangent costs."""
    np.abs(z, out=room)
    room += 1
    return np.divide(z, room, out=z)


class Tagger:
    """An LSTM in either direction over characters, a linear layer to tags, and CRF transitions.

    Squashing is z / (1 + |z|) throughout; a gate is 1 more than that. Gates stand as forget, input, output, then the new content.
    Parameters: ``e`` a few numbers for each character (the last of them 1, which carries the gates' biases), ``u`` what the state and
    those numbers add to the gates (direction, gate, number), ``o`` and ``b`` from both states to tags, ``t`` from tag to tag.
    """

    def __init__(self, seed: int = 3, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        r = lambda *s: rng.standard_normal(s).astype(np.float32)
        self.hidden = hidden
        self.p = {"e": r(EMBED, CLASSES), "u": r(2, 4 * hidden, hidden + EMBED) / np.float32(np.sqrt(hidden + EMBED)), "o": r(TAGS, 2 * hidden) / np.float32(np.sqrt(hidden)), "b": np.zeros((TAGS, 1), np.float32), "t": np.where(self.allowed(), 0, -8).astype(np.float32)}
        self.p["e"][-1] = 1
        self.p["u"][:, :hidden, -1] = 1

    @staticmethod
    def allowed() -> np.ndarray:
        """From tag, to tag: inside follows begin or inside of its kind alone."""
        ok = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            ok[:, 2 + 2 * k] = False
            ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
        return ok

    def emissions(self, ids: np.ndarray, sizes: np.ndarray | None = None, held: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores of tags (time, tag, window) for ``ids`` (window, time), and the states; ``held`` gets what going back needs.

        ``sizes``: characters of each window; a state does not come out of the padding behind them.
        """
        m, p = self.hidden, self.p
        n, steps = ids.shape
        turned = np.ascontiguousarray(ids.T.astype(np.intp))
        least = steps if sizes is None else int(sizes.min())
        kind = p["u"].dtype
        hx, c = np.zeros((2, m + EMBED, n), kind), np.zeros((2, m, n), kind)  # state, then the character
        states = np.empty((steps, 2 * m, n), kind)
        z, room, tc = np.empty((2, 4 * m, n), kind), np.empty((2, 4 * m, n), kind), np.empty((2, m, n), kind)
        for t in range(steps):
            np.take(p["e"], turned[t], axis=1, out=hx[0, m:], mode="clip")
            np.take(p["e"], turned[steps - 1 - t], axis=1, out=hx[1, m:], mode="clip")
            np.matmul(p["u"], hx, out=z)
            _squashed(z, room)
            z[:, : 3 * m] += 1
            if held is not None:
                held.append((z.copy(), c.copy(), hx.copy()))
            c *= z[:, :m]
            np.multiply(z[:, m : 2 * m], z[:, 3 * m :], out=tc)
            c += tc
            c *= 0.5
            tc[:] = c
            _squashed(tc, room[:, :m])
            np.multiply(z[:, 2 * m : 3 * m], tc, out=hx[:, :m])
            if steps - 1 - t >= least:
                inside = sizes > steps - 1 - t
                hx[1, :m] *= inside
                c[1] *= inside
            states[t, :m], states[steps - 1 - t, m:] = hx[0, :m], hx[1, :m]
            if held is not None:
                held[-1] += (tc.copy(),)
        e = np.matmul(p["o"], states)
        e += p["b"]
        return e, states

    def _crf(self, e: np.ndarray, tags: np.ndarray):
        """Loss of gold tags and its gradients by emissions and transitions, by scaled forward and backward sums."""
        steps, n, _ = e.shape
        e = e.astype(np.float64)
        t = np.exp(self.p["t"].astype(np.float64))
        top = e.max(axis=2, keepdims=True)
        w = np.exp(e - top)
        alpha, beta, scale = np.empty(w.shape), np.ones(w.shape), np.empty((steps, n, 1))
        a = w[0]
        for k in range(steps):
            if k:
                a = (alpha[k - 1] @ t) * w[k]
            scale[k] = a.sum(axis=1, keepdims=True)
            alpha[k] = a / scale[k]
        for k in range(steps - 2, -1, -1):
            beta[k] = ((w[k + 1] * beta[k + 1]) @ t.T) / scale[k + 1]
        de = alpha * beta
        ahead = (w[1:] * beta[1:] / scale[1:]).reshape(-1, TAGS)
        dt = alpha[:-1].reshape(-1, TAGS).T @ ahead * t
        gold = tags.T
        one = np.zeros(w.shape)
        np.put_along_axis(one, gold[:, :, None], 1.0, axis=2)
        pairs = np.bincount((gold[:-1] * TAGS + gold[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        loss = np.log(scale).sum() + top.sum() - (e * one).sum() - (pairs * self.p["t"]).sum()
        return loss / n, (de - one) / n, (dt - pairs) / n

    def gradients(self, ids: np.ndarray, tags: np.ndarray):
        m, p = self.hidden, self.p
        held: list[tuple] = []
        e, states = self.emissions(ids, held=held)
        loss, de, dt = self._crf(e.transpose(0, 2, 1), tags)
        de = np.ascontiguousarray(de.transpose(0, 2, 1)).astype(p["o"].dtype)  # time, tag, window
        steps, _, n = de.shape
        g = {"t": dt, "b": de.sum(axis=(0, 2))[:, None], "o": np.matmul(de, states.transpose(0, 2, 1)).sum(axis=0), "u": np.zeros(p["u"].shape)}
        both = np.matmul(p["o"].T, de)
        above = np.stack([both[:, :m], both[::-1, m:]])  # as each direction's own time goes
        dn = dc = np.zeros((2, m, n), de.dtype)
        dx = np.zeros((steps, EMBED, n), de.dtype)
        d = np.empty((2, 4 * m, n), de.dtype)
        back = p["u"].transpose(0, 2, 1)
        slope = lambda y: (1 - np.abs(y)) ** 2
        for t in range(steps - 1, -1, -1):
            z, before, hx, tc = held[t]
            f, i, o, new = (z[:, k * m : (k + 1) * m] for k in range(4))
            a = above[:, t] + dn
            dc = (dc + a * o * slope(tc)) * 0.5
            d[:, :m] = dc * before
            d[:, m : 2 * m] = dc * new
            d[:, 2 * m : 3 * m] = a * tc
            d[:, : 3 * m] *= slope(z[:, : 3 * m] - 1)
            d[:, 3 * m :] = dc * i * slope(new)
            g["u"] += np.matmul(d, hx.transpose(0, 2, 1))
            down = np.matmul(back, d)
            dn, dc = down[:, :m], dc * f
            dx[t] += down[0, m:]
            dx[steps - 1 - t] += down[1, m:]
        one = np.zeros((ids.size, CLASSES), de.dtype)
        one[np.arange(ids.size), ids.T.ravel()] = 1
        g["e"] = dx.transpose(1, 0, 2).reshape(EMBED, -1) @ one
        g["e"][-1] = 0
        return loss, g

    def train(self, texts: list[tuple[str, list[Span]]], rounds: int, rate: float = 0.04, batch: int = 64) -> list[float]:
        """Adam over batches in turn; the loss of each round."""
        ids, tags = np.zeros((len(texts), TAUGHT), np.int64), np.zeros((len(texts), TAUGHT), np.int64)
        for k, (text, spans) in enumerate(texts):
            ids[k, : len(text)] = classes(text)
            for kind, a, b in spans:
                tags[k, a], tags[k, a + 1 : b] = 1 + 2 * KINDS.index(kind), 2 + 2 * KINDS.index(kind)
        m = {k: np.zeros(v.shape) for k, v in self.p.items()}
        v = {k: np.zeros(x.shape) for k, x in self.p.items()}
        losses, n, last = [], 0, rounds * -(-len(texts) // batch)
        for _ in range(rounds):
            total = 0.0
            for at in range(0, len(texts), batch):
                n += 1
                loss, g = self.gradients(ids[at : at + batch], tags[at : at + batch])
                norm = np.sqrt(sum((x**2).sum() for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x**2
                    self.p[k] -= (rate * (1 - n / (last + 1)) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(self.p[k].dtype)
                total += loss
            losses.append(total)
        return losses

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, their best tags, the tags' lead over outside) of the windows that have any other tag than outside.

        Viterbi is left out where a bound shows that any span costs more than it brings, each transition taken at its best.
        """
        e, _ = self.emissions(ids, sizes)
        steps = len(e)
        t = np.where(self.allowed(), self.p["t"], -1e4).astype(np.float32)
        t_ = t - t[0, 0]
        begin, inside = (e[:, k::2] - e[:, :1] for k in (1, 2))
        for x in (begin, inside):
            x.transpose(0, 2, 1)[np.arange(steps)[:, None] >= sizes] = -1e4
        begins, insides = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        enter, stay, again = (x[:, None] for x in (t_[begins, insides], t_[insides, insides], t_[1:, 1::2].max(axis=0)))
        fresh, leave = t_[0, 1::2][:, None], np.maximum(t_[begins, 0], t_[insides, 0])[:, None]
        b = begin[0] + fresh
        i = np.full_like(b, -1e4)
        gain = np.empty_like(begin)
        gain[0] = b
        for k in range(1, steps):  # the most that a path gains over outside throughout if it is in a span of each kind: at its begin, inside
            i += stay
            np.maximum(i, b + enter, out=i)
            i += inside[k]
            np.add(gain[k - 1].max(axis=0), again, out=b)
            np.maximum(b, fresh, out=b)
            b += begin[k]
            np.maximum(b, i, out=gain[k])
        gain[:-1] += leave
        some = np.flatnonzero(gain.max(axis=(0, 1)) >= 0)
        if not len(some):
            return some, np.zeros((0, steps), np.int64), np.zeros((0, steps))
        e = np.ascontiguousarray(e[:, :, some].transpose(0, 2, 1))
        e[np.arange(steps)[:, None] >= sizes[some][None]] = [0.0] + [-1e4] * (TAGS - 1)
        n = len(some)
        back = np.empty((steps, n, TAGS), np.int8)
        score = e[0].copy()
        score[:, 2::2] -= 1e4  # nothing begins inside
        for k in range(1, steps):
            total = score[:, :, None] + t[None]
            back[k] = total.argmax(axis=1)
            score = total.max(axis=1) + e[k]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        at = np.arange(n)
        for k in range(steps - 1, 0, -1):
            tags[:, k - 1] = back[k, at, tags[:, k]]
        lead = (np.take_along_axis(e, tags.T[:, :, None], axis=2)[:, :, 0] - e[:, :, 0]).T
        any_ = tags.any(axis=1)
        return some[any_], tags[any_], lead[any_]


@lru_cache(maxsize=1)
def trained(texts: int = 6000, rounds: int = 5, seed: int = 11) -> Tagger:
    """The tagger, trained on ``texts`` labelled windows (a bound), once for each process."""
    tagger = Tagger()
    tagger.train(labelled(texts, seed), rounds)
    return tagger


# --- windows --------------------------------------------------------------------------------------


class Found(NamedTuple):
    """A span of a window in the text's places, and whether the window cuts it before or after."""

    kind: str
    a: int
    b: int
    score: float
    cut_before: bool
    cut_after: bool


def windows(size: int) -> list[tuple[int, int]]:
    """(start, size) of the windows of a text: of like sizes, each overlapping the next."""
    n = max(1, -(-(size - OVERLAP) // (WINDOW - OVERLAP)))
    step = -(-(size - OVERLAP) // n)
    return [(k * step, min(step + OVERLAP, size - k * step)) for k in range(n)] if size else []


def window_spans(tags: np.ndarray, lead: np.ndarray, start: int, size: int, end: int) -> list[Found]:
    out, k = [], 0
    while k < size:
        if tags[k] % 2 == 1:
            a, inside = k, tags[k] + 1
            k += 1
            while k < size and tags[k] == inside:
                k += 1
            out.append(Found(KINDS[(inside - 2) // 2], start + a, start + k, float(lead[a:k].mean()), a == 0 and start > 0, k == size and start + k < end))
        else:
            k += 1
    return out


def joined(found: list[Found]) -> list[Found]:
    """``found`` of all windows, with the parts of a span that windows cut as one; what stays cut is left out."""
    out: list[Found] = []
    for x in sorted(found, key=lambda x: (x.kind, x.a, x.b)):
        y = out[-1] if out else None
        if y and y.kind == x.kind and x.a < y.b and (y.cut_after or x.cut_before):
            first, last = (y, x) if x.b >= y.b else (y, y)
            out[-1] = Found(x.kind, y.a, max(x.b, y.b), max(x.score, y.score), first.cut_before, last.cut_after)
        else:
            out.append(x)
    return [x for x in out if not x.cut_before and not x.cut_after]


def reconciled(found: list[Found]) -> list[Span]:
    """Of spans over the whole text, those that no better span meets."""
    kept: list[tuple[int, int, str]] = []
    for x in sorted(set(joined(found)), key=lambda x: (-x.score, x)):
        k = bisect_left(kept, (x.a, x.b, x.kind))
        if (k == 0 or kept[k - 1][1] <= x.a) and (k == len(kept) or kept[k][0] >= x.b):
            kept.insert(k, (x.a, x.b, x.kind))
    return [(kind, a, b) for a, b, kind in kept]


def found_in(texts: list[str], tagger: Tagger) -> list[list[Found]]:
    """Spans of every window of every text. Windows of like sizes are decoded together."""
    flat = np.concatenate([np.zeros(0, np.uint8), *map(classes, texts)])
    ends = np.cumsum([len(t) for t in texts])
    jobs = sorted(((k, start, size) for k, t in enumerate(texts) for start, size in windows(len(t))), key=lambda x: x[2])
    out: list[list[Found]] = [[] for _ in texts]
    at = 0
    while at < len(jobs):
        till = at + 1
        while till < len(jobs) and till - at < BATCH and (till - at < BATCH // 8 or jobs[till][2] <= 1.1 * jobs[at][2]):
            till += 1
        part, at = jobs[at:till], till
        of, start, size = (np.array(x) for x in zip(*part))
        place = np.arange(size.max())[None]
        first = ends[of] - np.array([len(texts[k]) for k in of]) + start
        ids = np.where(place < size[:, None], flat[np.minimum(first[:, None] + place, len(flat) - 1)], 0)
        for row, tags, lead in zip(*tagger.decode(ids, size)):
            k, s, n = part[row]
            out[k] += window_spans(tags, lead, s, n, len(texts[k]))
    return out


def tag(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, spans that the tagger adds) of each text."""
    out = []
    for text, found in zip(texts, found_in(texts, tagger)):
        own = base_spans(text) if MARK.search(text) else []
        taken = sorted((a, b) for _, a, b in own)
        added = []
        for kind, a, b in reconciled(found):
            at = bisect_left(taken, (a, b))
            free = all(y <= a or x >= b for x, y in taken[max(0, at - len(BASE)) : at + len(BASE)])
            if free and sound(kind, text[a:b]):
                added.append((kind, a, b))
        out.append((own, added))
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ordered(spans))


def masked_text(text: str, spans: list[Span]) -> str:
    """``text`` with each span, overlapping ones as one, as the name of its kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, columns: dict[str, str], rows, text: str) -> DataFrame:
    """``docs`` with ``columns`` (name: type) that ``rows`` gives for a list of texts."""
    tagger = trained()
    at = docs.columns.index(text)
    others = [k for k, c in enumerate(docs.columns) if c not in columns]
    names = [docs.columns[k] for k in others]
    kinds = dict(docs.dtypes)

    def mapped(batches):
        for batch in slices(batches, 1024):
            new = list(zip(*rows(strings(batch.column(at)), tagger))) or [()] * len(columns)
            arrays = [pa.array(x, pa.string() if t == "string" else pa.int64()) for x, t in zip(new, columns.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), *arrays], [*names, *columns])

    told_by = [f"`{n}` {kinds[n]}" for n in names] + [f"{c} {t}" for c, t in columns.items()]
    return docs.mapInArrow(mapped, ", ".join(told_by))


def tagged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans, each as kind:start:end, the numbers of base spans by kind, and n_added."""

    def rows(texts, tagger):
        for own, added in tag(texts, tagger):
            yield (told(own), told(own + added), *(sum(k == kind for k, _, _ in own) for kind in BASE), len(added))

    return _mapped(docs, {"base_spans": "string", "spans": "string"} | {f"n_{k}": "long" for k in BASE} | {"n_added": "long"}, rows, text)


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span masked in ``text``; null texts become empty."""

    def rows(texts, tagger):
        for t, (own, added) in zip(texts, tag(texts, tagger)):
            yield (masked_text(t, own + added),)

    return _mapped(docs, {text: "string"}, rows, text).select(*docs.columns)
