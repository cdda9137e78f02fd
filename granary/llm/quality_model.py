"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier over measures of its text. Its site says more: a host has a rate of good
documents, and a path on it its own. Counts of good labels are grouped by path and by host; a path's posterior shrinks to its
host's and a host's to the global rate, each by a beta prior whose strength is estimated from the spread between groups
(method of moments), so a site with few labels keeps the prior and a large one its own rate. The score adds the log odds of
the path's posterior over the global rate to the classifier's.

Texts are read once, by built-in functions, and leave the pass as a few numbers. Sites are grouped before they are joined, so
a host that holds a third of all documents is one row. Weights are fitted on at most ``MOST_FITTED`` labelled documents; label
counts of sites cover all labels that may be learned from.

Defined results: a null or empty text has measures of 0. A null host or path is a site of its own, as is any other value. A
null ``doc_id`` has no label. Repeated rows are scored one by one. Without labels of both classes the classifier is the prior,
without any the global rate is one half. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import written
from granary.llm.labelled import held_out, logistic, training
from granary.llm.quality_rules import with_measures

MOST_FITTED = 20_000
#: Labels of sites; those of a pass are grouped, not sampled.
MOST_COUNTED = 1 << 62
#: Least and greatest strength of a prior, in labelled documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_letters", "n_repeat_words")
_FEATURES = 8


def features() -> list[Column]:
    """Of measured columns: logs and shares, each between about 0 and 12."""
    c, ratio = F.col, lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return [
        F.log1p(c("n_words").cast("double")),
        F.least(ratio("word_chars", "n_words"), F.lit(30.0)),
        F.least(ratio("n_symbols", "n_words"), F.lit(3.0)),
        ratio("n_dup_lines", "n_lines"),
        ratio("n_upper", "n_letters"),
        ratio("n_repeat_words", "n_words"),
        F.log1p(c("n_lines").cast("double")),
        F.coalesce(F.try_divide(c("n_letters"), c("word_chars")), F.lit(0.0)).cast("double"),
    ]


def _strength(groups: DataFrame, around: str) -> float:
    """Of the beta prior of groups (n, good) around a rate: spread beyond what sampling explains gives a weak prior."""
    p = F.col("good") / F.col("n")
    r = groups.filter("n >= 2").agg(F.sum(F.col("n") * F.pow(p - F.col(around), 2)).alias("ss"), F.sum(F.col(around) * (1 - F.col(around))).alias("noise"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not r.n or r.k < 2:
        return MOST_STRENGTH
    within = r.noise / r.k
    between = (r.ss - r.noise) / r.n
    return float(np.clip(within / between - 1 if between > 0 else MOST_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH))


def posteriors(labelled: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, posterior), global rate) of labelled documents (host, path, y), y 0 or 1."""
    paths = written(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = ((total.good or 0) + 1) / ((total.n or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.lit(rate))
    m = _strength(hosts, "rate")
    hosts = hosts.select(F.col("host").alias("__host"), ((F.col("good") + m * rate) / (F.col("n") + m)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    k = _strength(paths, "host_posterior")
    return paths.select("host", "path", "host_posterior", ((F.col("good") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("posterior")), rate


def scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, own, posterior, score): the classifier's probability, the site's posterior, and both together."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    seen = written(with_measures(kept, _MEASURES).select("id", "host", "path", *[f.alias(f"f{i}") for i, f in enumerate(features())]))
    known = written(training(labels, label, MOST_COUNTED, id_col).withColumn("y", (F.col("y") > 0).cast("int")))
    sites, rate = posteriors(seen.select("id", "host", "path").join(known, "id").select("host", "path", "y"))
    n = known.count()
    fitted = known if n <= MOST_FITTED else known.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(0.97 * MOST_FITTED / n * (1 << 20)))
    names = [f"f{i}" for i in range(_FEATURES)]
    rows = seen.join(F.broadcast(fitted.select("id", "y")), "id").select(*names, "y").toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in names]).reshape(-1, _FEATURES)
    w, mean, scale = logistic(x, rows.column("y").to_numpy().astype(float))
    own = F.lit(float(w[-1]))
    for i, c in enumerate(names):
        own = own + F.lit(float(w[i] / scale[i])) * (F.col(c) - float(mean[i]))
    odds = lambda p: F.log(p / (1 - p))
    hosts = sites.select(F.col("host").alias("__h"), "host_posterior").distinct()
    sites = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "posterior")
    joined = seen.join(sites, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")), "left").join(hosts, F.col("host").eqNullSafe(F.col("__h")), "left")
    site = F.coalesce("posterior", "host_posterior", F.lit(rate))
    z = own + odds(site) - float(np.log(rate / (1 - rate)))
    return joined.select("id", (1 / (1 + F.exp(-own))).alias("own"), site.alias("posterior"), (1 / (1 + F.exp(-z))).alias("score"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``op2_quality``: a score for every document, and whether it is good."""
    found = scores(docs, labels)
    good = F.col("score") >= 0.5
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "own", "posterior", "score", good.cast("int").alias("predicted"), good.alias("kept"))
