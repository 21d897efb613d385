"""Quality by hierarchical empirical Bayes over hosts and paths.

A document's own evidence is a logistic classifier over a few shape features
(computed by built-in functions, fitted on a bounded sample of labelled
documents outside the held-out fold). Sites add what is known of their other
documents: labelled counts are grouped by host and by path, and each level's
rate is a Beta posterior whose prior mean is the level above it and whose prior
strength comes from the spread between the groups (moments), so a path with few
labels stays near its host, and a host with few near the global rate. A labelled
document's own label is taken out of the counts it is judged by. The final
log-odds are the classifier's, plus the path's, less the global ones.

``documents`` has no URL: there the registered query takes source and language
as host and path; any two columns serve.

Texts are read once for the evidence; it is stored with label, host and path,
and all counts come from there. They are aggregated before they are shuffled and
joined back by host and path: the groups are as many as sites, and adaptive
execution splits a hot one's rows.

Defined cases: null and empty texts have the features of an empty text; very
long texts are read whole; an empty table gives no rows; null hosts and paths
are groups of their own; without labels every score is the classifier's prior;
of several labels of one document the greatest counts; repeated rows give
repeated rows and count once each; a score at the threshold is kept; labels that
are null are not used; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, pick, stored
from .toxicity import logistic

FIT_DOCS = 20_000
PRIOR_RATE = 0.5
KEEP = 0.5
#: Name and SQL of the features of ``text``; the words are the array ``w``, n the number of characters.
FEATURES = (
    ("upper", "(n - length(regexp_replace(text, '[A-Z]', ''))) / greatest(n, 1)"),
    ("digit", "(n - length(translate(text, '0123456789', ''))) / greatest(n, 1)"),
    ("marks", "(n - length(translate(text, '#$%&*!|@^~<>{}[]', ''))) / greatest(n, 1)"),
    ("stops", "(n - length(translate(text, '.,;:?', ''))) / greatest(n, 1)"),
    ("lines", "(n - length(translate(text, '\\n', ''))) / greatest(n, 1)"),
    ("word", "least(20, n / greatest(size(w), 1)) / 20"),
    ("variety", "size(array_distinct(w)) / greatest(size(w), 1)"),
    ("short", "if(size(w) < 10, 1, 0)"),
    ("length", "least(10, ln(1 + size(w))) / 10"),
)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, x: the features as an array of doubles, further columns)."""
    base = pick(docs, id_col, text_col, *more).withColumns({text_col: F.coalesce(text_col, F.lit(""))})
    base = base.withColumnRenamed(text_col, "text").withColumns({"n": F.length("text"), "w": F.split(F.trim("text"), r"\s+")})
    x = F.array(*[F.expr(f"CAST({sql} AS DOUBLE)") for _, sql in FEATURES])
    return base.select(F.col(f"`{id_col}`"), x.alias("x"), *[F.col(f"`{c}`") for c in more])


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label for each id outside the held-out fold."""
    return pick(labels, id_col, label_col).toDF("id", "label").where(f"id is not null and label is not null and crc32(cast(cast(id as string) as binary)) % 3 <> 1").groupBy("id").agg(F.max("label").cast("double").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights (the last is the bias) from about ``fit_docs`` labelled documents by hash of the id."""
    marked = _labels(labels, id_col, label_col)
    m = max(1, marked.count() // max(1, fit_docs))
    marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(m)) == 0)
    rows = features(docs, id_col, text_col).withColumnRenamed(id_col, "id").join(marked, "id").select("x", "label").collect()
    w = np.zeros(len(FEATURES) + 1)
    y = np.array([r["label"] for r in rows])
    if not len(y) or y.min() == y.max():
        return w
    return logistic(np.array([r["x"] for r in rows]), y, w, pull=0.5, floor=-np.inf)


def _moments(groups: DataFrame) -> float:
    """Prior strength of groups below a mean: from the spread of their rates beyond chance, in [2, 200]."""
    r = groups.where("n >= 2").agg(
        F.count("n").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn")
    ).first()
    if not r["k"] or r["k"] < 2:
        return 20.0
    mean = r["s"] / r["n"]
    within = mean * (1 - mean)
    spread = r["q"] - r["n"] * mean * mean  # weighted squares between the groups
    between = (spread - (r["k"] - 1) * within) / (r["n"] - r["nn"] / r["n"]) if r["n"] > r["nn"] / r["n"] else 0.0
    return 200.0 if between <= 0 else float(min(200.0, max(2.0, within / between - 1)))


def _shrunk(s: Column, n: Column, above: Column | float, strength: float) -> Column:
    """A group's posterior rate below the mean of the level above it."""
    return (s + strength * above) / (n + strength)


def _sites(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Labelled counts by (host, path), path's and host's, of rows (host, path, label); the global rate; the strengths of host and path."""
    paths = rows.groupBy("host", "path").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("s"))
    paths = stored(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (all_["s"] + 1) / (all_["n"] + 2) if all_["n"] else PRIOR_RATE
    up = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = paths.join(up, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return both, rate, _moments(hosts), _moments(paths)


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str, host_col: str, path_col: str, label_col: str) -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate) by path, shrunk to host and global rates; and the global rate.

    Every (host, path) of the documents is there, also those without labels.
    """
    rows = pick(docs, id_col, host_col, path_col).toDF("id", "host", "path").join(_labels(labels, id_col, label_col), "id", "left")
    sites, rate, k_host, k_path = _sites(rows)
    host_rate = _shrunk(F.col("host_s"), F.col("host_n"), rate, k_host)
    return sites.select("host", "path", host_rate.alias("host_rate"), _shrunk(F.col("s"), F.col("n"), host_rate, k_path).alias("path_rate")), rate


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", weights: np.ndarray | None = None) -> DataFrame:
    """(id, evidence, host_rate, path_rate, score): the classifier alone, both site levels, and all together."""
    w = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col) if weights is None else weights
    x = features(docs, id_col, text_col, host_col, path_col).toDF("id", "x", "host", "path")
    z = sum((F.get("x", F.lit(i)) * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    rows = x.select("id", F.greatest(F.lit(-15.0), F.least(F.lit(15.0), z)).alias("z"), "host", "path").join(_labels(labels, id_col, label_col), "id", "left")
    rows = stored(rows, "evidence")
    sites, rate, k_host, k_path = _sites(rows)
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    c = F.col
    both = rows.join(sites, c("host").eqNullSafe(c("h")) & c("path").eqNullSafe(c("p")))
    own, mine = F.when(c("label").isNotNull(), 1).otherwise(0), F.coalesce("label", F.lit(0.0))
    host_rate = _shrunk(c("host_s") - mine, c("host_n") - own, rate, k_host)
    both = both.withColumn("host_rate", host_rate).withColumn("path_rate", _shrunk(c("s") - mine, c("n") - own, c("host_rate"), k_path))
    total = c("z") + _logit(c("path_rate")) - float(np.log(rate / (1 - rate)))
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return both.select(c("id").alias(id_col), sigmoid(c("z")).alias("evidence"), "host_rate", "path_rate", sigmoid(total).alias("score"))


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold_of(id_col) == 1, F.lit(False))
