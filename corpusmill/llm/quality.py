"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees over column statistics give paths, each a conjunction of
threshold tests; an L1-penalised logistic regression keeps a few of them; the
kept rules are compiled into one Spark column expression, so scoring runs in
the JVM without Python.

Fitting reads at most `bound` labelled rows (a documented parameter); scoring
reads every row and every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common

SAMPLE = 20_000

#: One condition: column, "<=" or ">", threshold. A rule is a tuple of them.
Condition = tuple[str, str, float]

STATISTICS = (
    "n_chars", "n_words", "word_len", "upper", "alpha", "digit", "stop", "bang", "symbol", "pipe",
    "distinct_words", "repeat_next", "distinct_lines",
)


def with_statistics(df: DataFrame, prefix: str = "_") -> DataFrame:
    """Adds the struct column `stats`, after the prefix, which no other column has. Null and empty texts have 0 in every field."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.xxhash64(x))
    made = [prefix + n for n in ("text", "words", "lines")]
    df = df.withColumns(dict(zip(made, (text, words, lines), strict=True)))
    t, w, lines = map(F.col, made)

    def per(n: Column, of: Column) -> Column:
        return F.coalesce(n.cast("double") / F.nullif(of, F.lit(0)), F.lit(0.0))

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    n, k = F.length(t), F.size(w)
    again = F.size(F.filter(F.zip_with(F.slice(w, 1, F.greatest(k - 1, F.lit(0))), F.slice(w, 2, F.greatest(k - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
    stats = {
        "n_chars": n.cast("double"),
        "n_words": k.cast("double"),
        "word_len": per(n, k),
        "upper": per(kept(r"[^\p{Lu}]+"), n),
        "alpha": per(kept(r"[^\p{L}]+"), n),
        "digit": per(kept(r"[^0-9]+"), n),
        "stop": per(kept(r"[^.]+"), k),
        "bang": per(kept(r"[^!?]+"), k),
        "symbol": per(kept(r"[^#$%&*+<=>@^_~{}\[\]\\]+"), k),
        "pipe": per(kept(r"[^|]+"), k),
        "distinct_words": per(F.size(F.array_distinct(w)), k),
        "repeat_next": per(again, k),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return df.withColumn(prefix + "stats", F.struct(*[stats[c].alias(c) for c in STATISTICS])).drop(*made)


@dataclass(frozen=True)
class Rules:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""

    bias: float
    weighted: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, stats: str = "_stats") -> Column:
        def holds(rule: tuple[Condition, ...]) -> Column:
            return reduce(lambda a, b: a & b, [F.col(f"{stats}.{c}") <= t if op == "<=" else F.col(f"{stats}.{c}") > t for c, op, t in rule])

        logit = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weighted], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x, cuts, gradient, hessian, depth, path, out, least):
    """Collects the path of every node of a regression tree; returns its predictions."""
    mean = -gradient.sum() / (hessian.sum() + 1.0)
    if path:
        out.append(tuple(path))
    if depth == 0 or len(x) < 2 * least:
        return np.full(len(x), mean)
    best, total_g, total_h = (1e-6, None, None), gradient.sum(), hessian.sum()
    for j in range(x.shape[1]):
        if not len(cuts[j]):
            continue
        at = np.searchsorted(cuts[j], x[:, j], side="left")  # x <= cuts[i] for i >= at
        n = np.cumsum(np.bincount(at, minlength=len(cuts[j]) + 1))[:-1]
        g = np.cumsum(np.bincount(at, gradient, len(cuts[j]) + 1))[:-1]
        h = np.cumsum(np.bincount(at, hessian, len(cuts[j]) + 1))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(n < least) | (len(x) - n < least)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (gain[i], j, float(cuts[j][i]))
    if best[1] is None:
        return np.full(len(x), mean)
    _, j, t = best
    left, result = x[:, j] <= t, np.empty(len(x))
    for side, op in ((left, "<="), (~left, ">")):
        result[side] = _grow(x[side], cuts, gradient[side], hessian[side], depth - 1, [*path, (STATISTICS[j], op, t)], out, least)
    return result


def _simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound for each column and direction."""
    bounds: dict[tuple[str, str], float] = {}
    for c, op, t in rule:
        old = bounds.get((c, op), t)
        bounds[c, op] = min(old, t) if op == "<=" else max(old, t)
    return tuple(sorted((c, op, t) for (c, op), t in bounds.items()))


def _matrix(rules, x: np.ndarray) -> np.ndarray:
    of = {c: x[:, j] for j, c in enumerate(STATISTICS)}
    return np.stack([np.logical_and.reduce([of[c] <= t if op == "<=" else of[c] > t for c, op, t in r]) for r in rules], axis=1).astype(np.float64)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient; the bias is free."""
    n, k = r.shape
    step = 4 * n / (np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2 + 1e-9)
    w, z, momentum = np.zeros(k + 1), np.zeros(k + 1), 1.0
    w[-1] = z[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(steps):
        error = (_sigmoid(r @ z[:-1] + z[-1]) - y) / n
        new = z - step * np.append(r.T @ error, error.sum())
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return float(w[-1]), w[:-1]


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, seed: int = 7) -> Rules:
    """Boosted trees, their paths, and lasso weights with the penalty chosen on a fifth of the rows.

    With no rows, or one label only, the score is a constant: the smoothed share of label 1.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 20 or y.min() == y.max():
        return Rules(float(np.log(prior / (1 - prior))), ())
    rng = np.random.default_rng(seed)
    cuts = [(lambda u: (u[1:] + u[:-1]) / 2 if len(u) > 1 else u[:0])(np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))) for j in range(x.shape[1])]
    raw, found = np.full(len(y), np.log(prior / (1 - prior))), []
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p, part = _sigmoid(raw), rng.random(len(y)) < 0.7
        before = len(found)
        _grow(x[part], cuts, (p - y)[part], (p * (1 - p))[part], depth, [], found, least)
        new = [_simplified(r) for r in found[before:]]
        leaves = _matrix(new, x) if new else np.zeros((len(y), 0))
        if leaves.shape[1]:
            weights = -(leaves * (p - y)[:, None])[part].sum(0) / ((leaves * (p * (1 - p))[:, None])[part].sum(0) + 1)
            raw += 0.3 * leaves @ weights / depth
    rules = sorted({_simplified(r) for r in found})
    if not rules:
        return Rules(float(np.log(prior / (1 - prior))), ())
    r, test = _matrix(rules, x), rng.random(len(y)) < 0.2
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold on the same rows count once
    rules, r = [rules[i] for i in sorted(first)], r[:, sorted(first)]

    def loss(penalty: float) -> float:
        b, w = _lasso(r[~test], y[~test], penalty)
        p = np.clip(_sigmoid(r[test] @ w + b), 1e-6, 1 - 1e-6)
        return float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())

    penalty = min((3e-2, 1e-2, 3e-3, 1e-3, 3e-4), key=loss)
    b, w = _lasso(r, y, penalty, 800)
    return Rules(b, tuple((rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-4))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Rules:
    """Rules for label `quality`, from at most `bound` labelled rows outside the held-out fifth."""
    sample = with_statistics(common.labelled_sample(docs, labels, "quality", bound))
    rows = sample.select("_stats.*", "y").toPandas().sort_values([*STATISTICS, "y"])  # bound rows of 14 numbers
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs with the columns score (0 to 1) and, dropped again, its statistics. Every input row gives one row."""
    return with_statistics(docs).withColumn("score", rules.column()).drop("_stats")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns, whatever their names.

    Null and empty texts are scored by all-zero statistics; rows that repeat
    stay or go together; a score at the threshold stays. Without usable labels
    all rows have one score, the share of good ones that is taken for granted,
    which is a half. An empty table gives an empty result.
    """
    rules = fit(docs, labels, bound)
    prefix = common.free_prefix(docs)
    return with_statistics(docs, prefix).where(rules.column(prefix + "stats") >= threshold).select(*common.own_columns(docs))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts get the score of all-zero statistics. Repeated rows
    give repeated results; a null doc_id is held out under crc32 of "".
    Extra columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, labels, bound))
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
