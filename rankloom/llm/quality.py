"""Quality scores learned from preference pairs.

Bradley-Terry: the chance that one document is preferred to another is the logistic function of the difference of their scores. Scores
are linear in features of the text; the weights minimise the logistic loss over feature differences of (good, bad) pairs, and the
quantile of the scores at the share of bad documents becomes the threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import is_trained_on

#: The fit's bound on labelled documents; each is compared with so many of the other kind.
MOST_LABELLED, PAIRS_EACH = 12_000, 5
#: A document at the threshold gets this score.
CUT = 0.3


def features(text: Column) -> list[Column]:
    """Shares and averages that don't depend on the language."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+", -1), lambda w: w != "")
    n_words, n_chars = F.size(words).cast("double"), F.length(t).cast("double")
    per_char = lambda pattern: (n_chars - F.length(F.regexp_replace(t, pattern, ""))) / F.greatest(n_chars, F.lit(1.0))
    distinct = F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1.0))
    marks, upper, digits, ends = per_char(r"[^\p{L}\p{N}\s.,'-]+"), per_char(r"\p{Lu}+"), per_char(r"[0-9]+"), per_char(r"[.,]+")
    size = F.log1p(n_words)
    return [
        size,
        F.least(n_chars / F.greatest(n_words, F.lit(1.0)), F.lit(20.0)),
        distinct,
        # long texts repeat words by nature: the share of distinct words that their length leads to expect is left out
        F.greatest(F.lit(0.0), 4.2 - 0.45 * size - F.lit(4.0) * distinct),
        marks,
        F.sqrt(marks),
        upper,
        F.sqrt(upper),
        digits,
        ends,
        (n_words < 8).cast("double"),
    ]


def fit_pairs(x: np.ndarray, good: np.ndarray, bad_share: float, seed: int = 7) -> dict:
    """Weights from (good, bad) pairs of the rows of x, by Newton's method with a ridge; the threshold from the scores' quantile."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = (x - mean) / scale
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    w = np.zeros(x.shape[1])
    if len(winners) and len(losers):
        rng = np.random.default_rng(seed)
        won = np.concatenate([np.repeat(winners, PAIRS_EACH), rng.choice(winners, PAIRS_EACH * len(losers))])
        lost = np.concatenate([rng.choice(losers, PAIRS_EACH * len(winners)), np.repeat(losers, PAIRS_EACH)])
        d, n = z[won] - z[lost], len(won)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = d.T @ (p - 1) / n + 1e-3 * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / n + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(hessian, gradient)
    scores = z @ w
    return {"weights": w / scale, "offset": -float((mean / scale) @ w), "threshold": float(np.quantile(scores, bad_share)) if len(scores) else 0.0}


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Fits on at most MOST_LABELLED labelled training rows, those with the smallest hashes of their ids."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & is_trained_on(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", F.array(*[f.cast("double") for f in features(F.col("text"))]).alias("x")).collect()
    if not rows:
        return {"weights": np.zeros(len(features(F.lit("")))), "offset": 0.0, "threshold": 0.0}
    y = np.array([r["label"] for r in rows])
    return fit_pairs(np.array([r["x"] for r in rows], dtype=float), y, float((y == 0).mean()))


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 where score >= CUT).

    A text at the threshold quantile scores CUT. Null texts count as empty, and empty texts are scored like any others. Repeated rows
    get the same score each; an empty table gives no rows; without labelled rows of both kinds all scores are CUT. Other columns are ignored.
    """
    s = F.lit(float(model["offset"] - model["threshold"] + np.log(CUT / (1 - CUT)) + 1e-9))
    for weight, x in zip(model["weights"], features(F.col("text")), strict=True):
        s = s + F.lit(float(weight)) * x
    scored = docs.select("doc_id", (1 / (1 + F.exp(-F.least(F.greatest(s, F.lit(-30.0)), F.lit(30.0))))).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
