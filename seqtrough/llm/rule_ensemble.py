"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Trees grown on bootstrap samples give candidate rules: each node's path is a conjunction of thresholds on
statistics. A lasso logistic regression weighs the rules and drops most of them. The rest are compiled
into one Spark column, so that every text is scored by built-in expressions alone.

The classifier is fitted on at most SAMPLE labelled rows (a documented bound), the first by hash of the
identifier, then by statistics; everything else covers all rows. So the sample and its order, and with them trees,
weights and scores, do not depend on how rows lie in partitions. Fitting works on statistics only, never on labels'
other columns, language, source or identifier.

Defined results. Null and empty texts have statistics of 0 and get a score like any other. Rows that
repeat an identifier are scored each; labels that repeat one count once, at their mean. Rows without an
identifier are not held out. Without labels, or with one class, the score is the share of that class, or
0.5. An empty table of documents gives no rows. Extra columns pass through; ``score`` adds held_out, score and predicted, which
replace input columns of the same name, and no others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unlike
from .quality_rules import counted_in

SAMPLE = 20_000
TREES, DEPTH, LEAST = 40, 3, 10
PENALTY = 0.002
PRED = 0.3

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether above, threshold)

#: Statistics of a text: ratios, which do not grow with it, and the logarithm of its length.
STATISTICS = {
    "log_words": lambda c: F.log1p(c("n_words")),
    "mean_word": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbols": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "marks": lambda c: c("n_marks") / F.greatest(c("n_words"), F.lit(1)),
    "stops": lambda c: c("n_stop_words") / F.greatest(c("n_words"), F.lit(1)),
    "repeats": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "upper": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
    "digits": lambda c: c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
    "dup_lines": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "line_words": lambda c: F.log1p(c("n_words") / F.greatest(c("n_lines"), F.lit(1))),
}


def measure(docs: DataFrame, stats: str = "stats") -> DataFrame:
    """``docs`` with a struct of their statistics."""
    counted, of = counted_in(docs)
    values = (v(of.__getitem__).cast("double").alias(k) for k, v in STATISTICS.items())
    return counted.withColumn(stats, F.struct(*values)).drop(counted.columns[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled rows that are not held out, in one order whatever the partitions."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("_label")).where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # so it may be broadcast
    measured = measure(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    names = list(STATISTICS)
    rows = measured.select("doc_id", "stats.*", "_label").orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(most).toPandas()
    return rows[names].to_numpy(np.float64), (rows["_label"].to_numpy() >= 0.5).astype(np.float64)


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The feature and threshold that lower Gini impurity most."""
    best, found = 1e-9, None
    n, total = len(y), y.sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        gain = left**2 / k + (total - left) ** 2 / (n - k) + (k - left) ** 2 / k + (n - k - total + left) ** 2 / (n - k)
        gain = np.where((v[1:] > v[:-1]) & (k >= LEAST) & (n - k >= LEAST), gain - (total**2 + (n - total) ** 2) / n, -1)
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (int(f), float((v[at] + v[at + 1]) / 2))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> set[Rule]:
    """The path of every node of one tree."""
    names, out = list(STATISTICS), set()

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            out.add(tuple(sorted(path)))
        if len(path) == DEPTH or len(rows) < 2 * LEAST or y[rows].min() == y[rows].max():
            return
        found = _split(x[rows], y[rows], rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)])
        if found:
            f, t = found
            above = x[rows, f] > t
            grow(rows[above], (*path, (names[f], True, t)))
            grow(rows[~above], (*path, (names[f], False, t)))

    grow(rng.integers(0, len(y), len(y)), ())
    return out


def matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    at = {k: i for i, k in enumerate(STATISTICS)}
    return np.stack([np.all([(x[:, at[n]] > t) == above for n, above, t in r], axis=0) for r in rules], axis=1).astype(np.float64)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty, by accelerated proximal gradient; the classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    one = np.column_stack([np.ones(len(y)), a])
    step = 4.0 / np.linalg.eigvalsh((one * weight[:, None]).T @ one)[-1]
    w = z = np.zeros(one.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(one @ z, -30, 30)))
        new = z - step * (one.T @ (weight * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        z = new + k / (k + 3) * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(share / (1 - share))), []
    rng = np.random.default_rng(seed)
    rules = sorted(set().union(*(tree_rules(x, y, rng) for _ in range(TREES))))
    a = matrix(rules, x)
    _, first = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows are one
    rules, a = [rules[k] for k in sorted(first)], a[:, sorted(first)]
    bias, weights = lasso(a, y)
    return bias, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-3]


def compiled(bias: float, rules: list[tuple[Rule, float]], stats: str = "stats") -> Column:
    """The score as one column over the struct ``stats``."""
    total = F.lit(bias)
    for rule, weight in rules:
        holds = F.lit(True)
        for name, above, t in rule:
            value = F.col(f"`{stats}`.{name}")
            holds = holds & ((value > t) if above else (value <= t))
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    bias, rules = fit(*sample(docs, labels, label))
    stats = unlike(docs, "stats")
    df = measure(docs, stats).withColumn("score", compiled(bias, rules, stats)).withColumn("held_out", held_out(F.col("doc_id")))
    return df.withColumn("predicted", (F.col("score") >= PRED).cast("int")).drop(stats)
