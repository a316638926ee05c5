"""Quality classifier with hierarchical empirical Bayes over sites and paths.

A document classifier gives each document a log-odds of evidence. Documents of one site
(host, or source) and of one path of it share a quality level: the site's rate is shrunk
toward the global rate, the path's rate toward its site's, each by a strength that is
itself estimated from the spread of the rates (method of moments), so a site with few
documents takes the global prior and a large one its own. A document's posterior adds
the evidence to the log-odds of its path's rate. All three rates are taken over the other documents: a
document's own evidence is left out of them, so that it counts once. (The global rate counts the share of good labels as one document.)

The classifier is logistic regression on counts of the text, fitted on about
``max_train`` labelled documents at most, chosen by a hash of doc_id; this is the
only sample. Site and path sums are over all documents, by aggregation that combines
before the shuffle, so a hot site is a few partial sums. Sites are joined back to
documents as a table whose size Spark knows, and is broadcast only when that is small.

Nulls: a null text counts as empty; a null site or path is a group of its own. Labels
with a null id or quality are not used; repeated labels of one document count once each.
Without any usable labels, or with one class only, the evidence is 0 for all. An empty
table gives an empty result. Repeated rows count as often as they occur and are judged alike; a posterior equal to the
threshold is kept. Texts of any length are taken whole. All columns of the input pass through ``classify``;
``evidence``, ``site_rate``, ``path_rate``, ``posterior`` and ``kept`` replace columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import SPACE_CHARS, let, materialize, words

FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "distinct", "line_repeats", "digits", "short_words")
OWN = ("evidence", "site_rate", "path_rate", "posterior", "kept")


def text_features(text: Column) -> Column:
    """An array of the numbers named in FEATURES, each within about 0 to 10."""
    t = F.coalesce(text, F.lit(""))

    def count(chars: str, of: Column) -> Column:
        return F.length(of) - F.length(F.translate(of, chars, ""))

    def measure(x: Column) -> Column:
        t, w = x["t"], x["w"]
        n = F.greatest(F.size(w), F.lit(1))
        body = F.length(F.translate(t, SPACE_CHARS, ""))
        lines = F.filter(F.split(t, "\n"), lambda s: F.length(F.translate(s, SPACE_CHARS, "")) > 0)
        distinct = F.size(F.array_distinct(w))
        return F.array(
            F.log1p(F.size(w).cast("double")),
            F.least(body / n, F.lit(20.0)) / 2,
            F.least(10 * count("#*$%&<>", t) / n, F.lit(10.0)),
            F.least(10 * count("!|", t) / n, F.lit(10.0)),
            10 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ", t) / F.greatest(body, F.lit(1)),
            # By the root of the length, as a text's vocabulary grows: long clean texts are no outliers.
            F.least(distinct / F.sqrt(n.cast("double")), F.lit(60.0)) / 6,
            10 * (1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))),
            10 * count("0123456789", t) / F.greatest(body, F.lit(1)),
            10 * distinct / n,
        )

    return let(F.struct(t.alias("t"), words(t).alias("w")), measure)


@dataclass(frozen=True)
class Linear:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def log_odds(self, x: Column) -> Column:
        """Evidence: the log-odds less the training share's own."""
        out = F.lit(self.bias)
        for k, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights, strict=True)):
            if w:
                out = out + (F.get(x, F.lit(k)) - m) / s * w
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), out))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Linear:
    """Ridge-penalised logistic regression by Newton steps; the bias is the evidence's, without the share of good labels."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Linear((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.append(np.full(k, ridge), 1e-6)
    w = np.zeros(k + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    share = np.log(y.mean() / (1 - y.mean()))
    return Linear(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1] - share))


def train(featured: DataFrame, labels: DataFrame, max_train: int = 10_000) -> tuple[Linear, float]:
    """The classifier and the share of good labels, from about ``max_train`` labelled rows at most, chosen by a hash of doc_id."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y is not null")
    share = max_train / max(y.count(), 1)
    if share < 1:
        y = y.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = featured.select("_doc", "_x").join(y, F.col("_doc") == F.col("_id")).orderBy("_doc", "_y").select("_x", "_y").toPandas()
    x = np.array(rows["_x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    good = rows["_y"].to_numpy(np.float64)
    return fit(x, good), float(good.mean()) if len(good) else 0.5


def strength(groups: DataFrame, rate: str, n: str, parent: Column, least: float = 1.0, most: float = 10_000.0) -> float:
    """Prior strength by the method of moments: how many documents the parent's rate is worth, from the spread of rates around it."""
    m = parent
    excess = F.sum(F.col(n) * (F.col(rate) - m) * (F.col(rate) - m)) - F.sum(m * (1 - m))
    row = groups.agg((excess / F.sum(n)).alias("between"), (F.sum(m * (1 - m) * F.col(n)) / F.sum(n)).alias("within")).first()
    if row["between"] is None or row["between"] <= 0 or not row["within"]:
        return most
    return float(min(most, max(least, row["within"] / row["between"] - 1)))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, site: Column, path: Column, threshold: float = 0.5, max_train: int = 10_000, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with evidence, site_rate, path_rate, posterior and kept. ``site`` and ``path`` are expressions over its columns.

    ``keep``: the columns to return besides these, by default all. The counts of a text are
    taken once and written with the kept columns; nothing else of a document moves.
    """
    names = [c for c in docs.columns if c not in OWN and (keep is None or c in keep)]
    # Columns go by number until the end, so that no name of theirs meets one of the steps below.
    numbered = [f"x_{i}" for i in range(len(names))]
    kept = [F.col(x).alias(c) for c, x in zip(names, numbered, strict=True)]
    own = [F.col("doc_id").alias("_doc"), site.cast("string").alias("_site"), path.cast("string").alias("_path"), text_features(F.col("text")).alias("_x")]
    featured = materialize(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, numbered, strict=True)], *own), "quality-features")
    model, share = train(featured, labels, max_train)
    prior_odds = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0

    # The classifier's own probability of every document, summed by path.
    p = 1 / (1 + F.exp(-(model.log_odds(F.col("_x")) + F.lit(prior_odds))))
    paths = materialize(featured.groupBy("_site", "_path").agg(F.sum(p).alias("_good"), F.count(F.lit(1)).alias("_n")), "path-sums")
    sites = paths.groupBy(F.col("_site").alias("_s")).agg(F.sum("_good").alias("_sgood"), F.sum("_n").alias("_sn"))
    total = sites.agg(F.sum("_sgood"), F.sum("_sn")).first()
    if not total[1]:
        return featured.select(*kept, *[F.lit(None).cast("double").alias(c) for c in OWN[:-1]], F.lit(None).cast("boolean").alias("kept"))
    overall = min(1 - 1e-6, max(1e-6, total[0] / total[1]))
    a = strength(sites.withColumn("_r", F.col("_sgood") / F.col("_sn")), "_r", "_sn", F.lit(overall))
    sites = sites.withColumn("site_rate", (F.col("_sgood") + a * overall) / (F.col("_sn") + a))
    both = paths.join(sites, paths["_site"].eqNullSafe(sites["_s"])).withColumn("_r", F.col("_good") / F.col("_n"))
    b = strength(both, "_r", "_n", F.col("site_rate"))
    sums = materialize(both.select(F.col("_site").alias("_rs"), F.col("_path").alias("_rp"), "_good", "_n", "_sgood", "_sn"), "path-rates")

    scored = featured.withColumn("evidence", model.log_odds(F.col("_x"))).withColumn("_p", p)
    joined = scored.join(sums, F.col("_site").eqNullSafe(F.col("_rs")) & F.col("_path").eqNullSafe(F.col("_rp")), "left")
    # A document's own evidence is left out of the rates that it is combined with: it counts once.
    others = F.lit(float(total[0])) - F.col("_p") + F.lit(share)
    joined = joined.withColumn("_all", others / F.lit(float(total[1])))
    joined = joined.withColumn("site_rate", (F.col("_sgood") - F.col("_p") + a * F.col("_all")) / (F.col("_sn") - 1 + a))
    joined = joined.withColumn("path_rate", (F.col("_good") - F.col("_p") + b * F.col("site_rate")) / (F.col("_n") - 1 + b))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")))))
    out = joined.withColumn("posterior", posterior).withColumn("kept", F.col("posterior") >= threshold)
    return out.select(*kept, *OWN)
