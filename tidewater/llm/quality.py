"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed by built-in functions. Small trees are grown on a
bounded sample of labelled rows, every path from a root becomes a conjunction of bounds on
statistics, a lasso-penalised logistic regression keeps few of them, and the kept rules are
compiled into one column expression, so scoring is a projection.

Only texts enter a score. Null texts count as empty; an empty text has all statistics 0
and a score like any other. Without labelled rows of both kinds the score is the share of
good rows (0.5 without any). Repeated rows are scored alike. Texts are measured whole, however
long: an array of a text's words is the most that one row needs. An empty table gives an empty
result. Columns of the user keep their names and values, but for those that carry the name of a
statistic, which :func:`with_statistics` replaces.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
SYMBOLS = "#$%&*+/<=>@\\^_`{|}~"
STATISTICS = ("log_words", "mean_word", "distinct_words", "short_words", "upper", "digits", "symbols", "marks", "stops", "pipes", "lines_per_word", "distinct_lines")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``STATISTICS``, all doubles, computed from the whole text; they replace columns of the same name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda letters: (F.col("_n") - F.char_length(F.translate("_t", letters, ""))).cast("double")
    share = lambda c, of: F.coalesce(F.try_divide(c.cast("double"), of.cast("double")), F.lit(0.0))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in STATISTICS]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text.alias("_t"), F.char_length(text).alias("_n"))
    out = out.withColumns({"_w": F.filter(F.split("_t", r"\s+"), lambda x: x != ""), "_l": F.filter(F.split("_t", "\n"), lambda x: x != "")})
    out = out.withColumn("_k", F.size("_w"))
    n, k = F.col("_n"), F.col("_k")
    measured = {
        "log_words": F.log1p(k.cast("double")),
        "mean_word": share(n - k + 1, k),
        "distinct_words": share(F.size(F.array_distinct("_w")), k),
        "short_words": share(F.size(F.filter("_w", lambda x: F.char_length(x) <= 3)), k),
        "upper": share(count(UPPER), n),
        "digits": share(count("0123456789"), n),
        "symbols": share(count(SYMBOLS), n),
        "marks": share(count("!?"), n),
        "stops": share(count(".,;:"), n),
        "pipes": share(count("|"), n),
        "lines_per_word": share(F.size("_l"), k),
        "distinct_lines": share(F.size(F.array_distinct("_l")), F.size("_l")),
    }
    return out.select(*kept, *(c.alias(name) for name, c in measured.items()))


@dataclasses.dataclass(frozen=True)
class RuleModel:
    """``rules``: (conditions, weight); a condition is (statistic, ``<=`` or ``>``, bound)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...] = ()

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = None
            for name, side, bound in conditions:
                one = F.col(name) <= bound if side == "<=" else F.col(name) > bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, g: np.ndarray, depth: int, least: int, cuts: int, rng) -> list[tuple]:
    """Conjunctions on the way to every node of a regression tree on ``g``."""
    found: list[tuple] = []

    def grow(rows: np.ndarray, path: tuple):
        if path:
            found.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = None
        for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            s, sums = v[order], np.cumsum(g[rows][order])
            at = np.unique(np.linspace(least, len(rows) - least, cuts).astype(int))
            at = at[s[at - 1] < s[np.minimum(at, len(s) - 1)]]
            if at.size:
                gain = sums[at - 1] ** 2 / at + (sums[-1] - sums[at - 1]) ** 2 / (len(rows) - at)
                i = int(gain.argmax())
                if best is None or gain[i] > best[0]:
                    best = (gain[i], f, float((s[at[i] - 1] + s[at[i]]) / 2))
        if best:
            _, f, bound = best
            low = x[rows, f] <= bound
            grow(rows[low], (*path, (int(f), "<=", bound)))
            grow(rows[~low], (*path, (int(f), ">", bound)))

    grow(np.arange(len(g)), ())
    return found


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, side, bound in path:
        out &= x[:, f] <= bound if side == "<=" else x[:, f] > bound
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, names=STATISTICS, trees: int = 60, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 7) -> RuleModel:
    """Boosted small trees -> their paths as 0/1 rules -> lasso logistic weights by accelerated proximal steps."""
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return RuleModel(math.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    z, paths = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        some = rng.choice(len(y), min(len(y), 3000), replace=False)
        g = y - 1 / (1 + np.exp(-z))
        own = _paths(x[some], g[some], depth, max(5, len(some) // 200), 40, rng)
        paths.update(dict.fromkeys(own))
        for p in own:
            if len(p) == depth or not any(q[: len(p)] == p and len(q) > len(p) for q in own):
                here = _holds(x, p)
                z[here] += 0.3 * g[here].mean() / max(1e-3, (y[here].mean() * (1 - y[here].mean()))) if 0 < y[here].mean() < 1 else 0.3 * np.sign(g[here].mean() if here.any() else 0)
        z = np.clip(z, -6, 6)
    # rules that hold for (nearly) all or no rows, or for the same rows as one before, say nothing new
    distinct: dict[bytes, tuple] = {}
    for p in paths:
        here = _holds(x, p)
        if 0.002 < here.mean() < 0.998:
            distinct.setdefault(np.packbits(here).tobytes(), p)
    kept = list(distinct.values())
    r = np.empty((len(y), len(kept)), np.float32)
    for k, p in enumerate(kept):
        r[:, k] = _holds(x, p)
    w, b = np.zeros(r.shape[1]), math.log(y.mean() / (1 - y.mean()))
    v, c, t = w.copy(), b, 1.0
    sample = r[rng.choice(len(r), min(len(r), 2000), replace=False)]
    rate = 1 / (0.25 * (np.linalg.norm(sample, 2) ** 2 / len(sample) + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v.astype(np.float32) + c)))
        new = v - rate * ((p - y).astype(np.float32) @ r / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        at = c - rate * float((p - y).mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), at + (t - 1) / t2 * (at - b)
        w, b, t = new, at, t2
    rules = tuple((tuple((names[f], side, bound) for f, side, bound in p), float(k)) for p, k in zip(kept, w) if abs(k) > 1e-6)
    return RuleModel(float(b), rules)


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids whose labels are never learnt from. A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _labelled(labels: DataFrame, sample_rows: int, id_col: str, label_col: str) -> DataFrame:
    """Labels that may be learnt from, thinned by hash to little more than ``sample_rows``: ``(_id, _y, _key)``."""
    key = F.shiftrightunsigned(F.xxhash64("_id"), 1)
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where(F.col("_y").isNotNull() & ~held_out(F.col("_id"))).withColumn("_key", key)
    share = 1.3 * sample_rows / max(1, rows.count())
    return rows if share >= 1 else rows.where(F.col("_key") < int(share * 2**63))


def _fit(sample: DataFrame, options: dict) -> RuleModel:
    rows = sample.toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(), rows["_y"].to_numpy(), **options)


def train(measured: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", label_col: str = "quality", **options) -> RuleModel:
    """Fits the rules on at most ``sample_rows`` labelled rows (those of the smallest hash), never on held-out ones."""
    rows = measured.select(F.col(id_col).alias("_id"), *STATISTICS).join(_labelled(labels, sample_rows, id_col, label_col), "_id")
    return _fit(rows.orderBy("_key", "_id", "_y", *STATISTICS).limit(sample_rows).drop("_id", "_key"), options)


def train_on_texts(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> RuleModel:
    """Like :func:`train`, measuring only the documents of at most ``sample_rows`` labels, which are broadcast."""
    some = _labelled(labels, sample_rows, id_col, label_col).orderBy("_key", "_id", "_y").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id")
    measured = with_statistics(rows).select("_id", "_y", "_key", *STATISTICS)
    return _fit(measured.orderBy("_key", "_id", "_y", *STATISTICS).limit(sample_rows).drop("_id", "_key"), options)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    measured = settle(with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"))
    model = train(measured, labels.withColumnRenamed(id_col, "doc_id"), sample_rows)
    score = F.round(model.score(), 9)
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their own columns."""
    model = train_on_texts(docs, labels, sample_rows, id_col, text_col)
    plain = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    return with_statistics(plain, "_text").where(F.round(model.score(), 9) >= threshold).select("_row.*")
