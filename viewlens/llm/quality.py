"""Quality classifier with hierarchical empirical-Bayes site posteriors.

Three sources of evidence are added as log odds:

* the document: logistic regression over writing statistics, fitted on a bounded
  sample of labelled documents;
* its host: good and bad weight of all the host's documents, shrunk toward the
  global rate;
* its path (a part of the host): the same, shrunk toward the host's posterior.

The strength of each shrinkage is estimated from the data: the spread of the true
rates of hosts (of paths) beyond what counting noise explains, by the method of
moments on beta-binomial counts.  A site with few documents stays near its prior,
a site with many speaks for itself.

All documents enter the site counts: a labelled one with its label, any other with
the classifier's probability at ``SOFT_WEIGHT`` of a label.  Only the fit of the
regression uses a sample, of at most ``SAMPLE`` labelled documents.

Defined results: null text is empty; a null host or path is a site of its own.  If
several labels name an id the best one counts; labels that are null or name no
document count for nothing.  If the labelled documents that the regression is fitted
on are not of both kinds there is no evidence: labels count for nothing in the site
counts either, all documents have even odds and are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import drop_tables, free_name, hash_sample, importable, written

# Labelled documents that the regression is fitted on, at most.
SAMPLE = 4000
# What a classifier's probability weighs in the site counts against a label's 1.
SOFT_WEIGHT = 0.25
# The site can move a document's log odds by no more than this, however sure its posterior is.
SITE_LIMIT = 2.0
# A document is rejected if its probability of being good is below this.
REJECT_BELOW = 0.5
RIDGE = 1.0

# Byte classes: lower, upper, digit, space, line end, sentence marks, other ASCII marks, non-ASCII, control
CLASSES = np.full(256, 8, np.uint8)
for _name, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
                                b"\n\r", b".,;:'\"()-?", b"!#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256)))):
    CLASSES[list(_bytes)] = _name


def statistics(text: str | None) -> list[float]:
    """Writing statistics of a whole text, each about between 0 and 1."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    share = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=9) / size
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = Counter([w[-1:] for w in words])
    return [
        *share.tolist(),
        math.log1p(len(words)) / 10,
        len(data) / n / 20,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,                      # a word repeated at once
        len(set(zip(words, words[1:], words[2:]))) / n,          # distinct word triples
        len(set(lines)) / max(1, len(lines)),
        sum([c for e, c in ends.items() if e in b"!#$%&*|~"]) / n,  # words that end in a mark
        counts.get(b"|", 0) / n,
    ]


class Regression:
    """Ridge logistic regression, fitted by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = self._scaled(x)
        self.weight = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
            slope = z.T @ (good - p) - penalty * self.weight
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            self.weight += step
            if np.abs(step).max() < 1e-6:
                break

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.weight


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> Regression | None:
    """The document classifier, from the ``sample`` labelled documents with the least id hashes."""
    chosen = hash_sample(labels, "id", sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_tables()
        for b in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in b["text"]], "good": b["good"]})

    # rows that repeat an id of the sample could exceed the bound
    got = rows.mapInPandas(run, "x array<double>, good int").limit(2 * sample).toPandas()
    if got["good"].nunique() < 2:
        return None
    return Regression(np.array(got["x"].tolist()), got["good"].to_numpy(np.float64))


def evidence(model: Regression | None, text: Column) -> Column:
    """Log odds of a good document from its text alone."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def log_odds(texts: pd.Series) -> pd.Series:
        drop_tables()
        if texts.empty:
            return pd.Series([], dtype=float)
        return pd.Series(model.log_odds(np.array([statistics(t) for t in texts])))
    return log_odds(text)


def _strength(squares: float, freedom: float, rate: float, weight: float, weight2: float) -> float:
    """Prior strength (in labels) by the method of moments, between 1 and a million."""
    noise = rate * (1 - rate)
    spread = (squares - freedom * noise) / max(weight - weight2 / weight, 1e-9)
    return min(max(noise / spread - 1, 1.0), 1e6) if spread > 0 else 1e6


def site_posteriors(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``host``, ``path``, ``global_rate``, ``host_rate``, ``path_rate``: one row per path.

    ``scored``: ``doc_id``, ``host``, ``path``, ``doc_log_odds`` of all documents.
    """
    p = 1 / (1 + F.exp(-F.col("doc_log_odds")))
    weight = F.when(F.col("good").isNull(), SOFT_WEIGHT).otherwise(1.0)
    paths = (scored.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
             .groupBy("host", "path").agg(F.sum(weight).alias("n"),
                                          F.sum(weight * F.coalesce(F.col("good").cast("double"), p)).alias("g")))
    paths = written(paths, "paths")
    hosts = written(paths.groupBy(F.col("host").alias("of_host")).agg(
        F.sum("n").alias("host_n"), F.sum("g").alias("host_g"), F.sum(F.col("n") * F.col("n")).alias("path_n2"),
        F.count(F.lit(1)).alias("k")), "hosts")
    # only sums over all hosts and paths reach the driver
    n, g = hosts.agg(F.sum("host_n"), F.sum("host_g")).first()
    rate = g / n if n else 0.5
    q = F.col("host_g") / F.col("host_n")
    squares, k, n2, paths_k, w2 = hosts.agg(
        F.sum(F.col("host_n") * (q - rate) * (q - rate)), F.count(F.lit(1)), F.sum(F.col("host_n") * F.col("host_n")),
        F.sum("k"), F.sum(F.col("path_n2") / F.col("host_n"))).first()
    host_prior = _strength(squares, k - 1, rate, n, n2) if n else 1.0
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
    r = F.col("g") / F.col("n")
    inside = both.agg(F.sum(F.col("n") * (r - q) * (r - q))).first()[0]
    path_prior = _strength(inside, paths_k - k, rate, n, w2 * n) if n else 1.0
    host_rate = (F.col("host_g") + host_prior * rate) / (F.col("host_n") + host_prior)
    return written(both.withColumn("host_rate", host_rate).select(
        "host", "path", F.lit(rate).alias("global_rate"), "host_rate",
        ((F.col("g") + path_prior * F.col("host_rate")) / (F.col("n") + path_prior)).alias("path_rate")), "sites")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def best_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``id`` and ``good`` (0 or 1), one row per labelled id."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("good")))


def evidence_and_sites(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str,
                       carried: list[Column], odds: str) -> tuple[DataFrame, DataFrame]:
    """The columns ``carried`` of all documents with their evidence ``odds`` (written), and the posteriors of all paths.

    The classifier sees each text once; what is needed later is written with its evidence.
    """
    importable(docs.sparkSession)
    labels = written(labels, "labels")
    model = fit(docs, labels, id_col, text_col)
    scored = written(docs.select(*carried, evidence(model, F.col(text_col)).alias(odds)), "evidence")
    rows = scored.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"),
                         F.col(f"`{path_col}`").alias("path"), F.col(f"`{odds}`").alias("doc_log_odds"))
    return scored, site_posteriors(rows, labels if model else labels.limit(0))


def _score(doc_log_odds: str, path_rate: str, global_rate: str) -> Column:
    """Probability of being good: the document's odds moved by its site's against all."""
    site = _logit(F.col(path_rate)) - _logit(F.col(global_rate))
    site = F.least(F.greatest(site, F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
    return 1 / (1 + F.exp(-(F.col(doc_log_odds) + site)))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``doc_id``, site, evidence, site rates, probability ``score`` of being good, and ``kept``."""
    carried = [F.col(f"`{c}`") for c in dict.fromkeys((id_col, host_col, path_col))]
    scored, sites = evidence_and_sites(docs, labels, id_col, text_col, host_col, path_col, carried, "__odds")
    scored = scored.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"),
                           F.col(f"`{path_col}`").alias("path"), F.col("__odds").alias("doc_log_odds"))
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    score = _score("doc_log_odds", "path_rate", "global_rate")
    return scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).select(
        "doc_id", "host", "path", "doc_log_odds", "host_rate", "path_rate", score.alias("score"),
        (score >= REJECT_BELOW).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected ones, same columns."""
    own, odds = [F.col(f"`{c}`") for c in docs.columns], free_name(docs, "doc_log_odds")
    scored, sites = evidence_and_sites(docs, labels, id_col, text_col, host_col, path_col, own, odds)
    names = {c: free_name(scored, f"site_{c}") for c in ("host", "path", "path_rate", "global_rate")}
    sites = sites.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = (F.col(f"`{host_col}`").eqNullSafe(F.col(names["host"]))
            & F.col(f"`{path_col}`").eqNullSafe(F.col(names["path"])))
    score = _score(odds, names["path_rate"], names["global_rate"])
    return scored.join(sites, same).where(score >= REJECT_BELOW).select(*own)
