"""Isolation Forest.

Spark has no isolation forest, so it is composed from DataFrame steps:

1. Sampling without a driver round trip: for tree ``t`` a row joins the
   candidate set when its draw (see below) falls under a threshold giving
   about 1.5 x psi rows per tree; the trees a row belongs to are computed as
   one array expression per row and exploded.  The sample depends on the
   keys only, never on partitioning or retries.
2. ``groupBy(tree_id).applyInPandas`` builds each tree from the psi
   lowest-draw candidates.  A group holds about 1.5 x psi rows: a bound set
   by the parameters, not by the data.
3. The node table (tree_id, node_id, feature, threshold, left, right, size,
   depth) *is* the model; it has at most T x (2 psi - 1) rows, so it is
   collected once and shipped to the tasks as NumPy arrays.
4. Scoring is an Arrow-batched ``mapInPandas`` that walks every tree for a
   whole batch at once, level by level.
5. The decision offset is the exact ``contamination`` quantile of the
   training scores (distributed quantile, no single-task collect).

Every random choice is an integer taken from an MD5 digest, so any engine
with MD5 and 64-bit integers can replay the forest:

* a key's base ``b`` is ``word(key as text, 0) mod P`` with P = 2^31 - 1; its
  draw in tree ``t`` is ``(b * (1 + word("seed:t", 0) mod (P - 1)) +
  word("seed:t", 1)) mod P``, ties to the smaller key as text;
* node ``i`` (children 2i + 1 and 2i + 2) of tree ``t`` splits the feature at
  place ``word("seed:t:i", 0) mod m`` among the m that vary in it, at
  ``lo + (hi - lo) * word("seed:t:i", 1) / 2^32``;
* ``word(x, k)`` is the k-th group of eight hex digits of MD5(x).

Leaf lengths count in whole billionths, so a row's sum over the trees is exact
in any order and equal rows get equal scores.

The result is not bit-identical to scikit-learn (different random draws);
the registered queries are compared with the same forest in SQL.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

from .quantiles import exact_quantile

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left int, right int, size int, "
               "depth int")


def average_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


PRIME = 2 ** 31 - 1
LENGTH_UNITS = 10 ** 9


def _word(text: str, k: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[8 * k:8 * k + 8], 16)


def _base(key):
    """A key's place in [0, P), from its text."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(PRIME))


def _draw(base, factor, shift):
    """Deterministic integer in [0, P) per (key, tree); factors below 2^31 keep the product within a LONG."""
    return F.pmod(base * factor + shift, F.lit(PRIME))


def _builder(features: list[str], psi: int, max_depth: int, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values(["_u", "_key"], kind="mergesort").head(psi)
        x = pdf[features].to_numpy(dtype="float64")
        rows = []
        stack = [(0, np.arange(len(x)), 0)]
        while stack:
            node, idx, depth = stack.pop()
            sub = x[idx]
            split = depth < max_depth and len(idx) > 1
            usable = np.flatnonzero(sub.max(axis=0) > sub.min(axis=0)) if split else ()
            if len(usable) == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
                continue
            name = f"{seed}:{tree}:{node}"
            f = int(usable[_word(name, 0) % len(usable)])
            lo, hi = sub[:, f].min(), sub[:, f].max()
            thr = float(lo + (hi - lo) * (_word(name, 1) / 2.0 ** 32))
            go_left = sub[:, f] < thr
            left, right = 2 * node + 1, 2 * node + 2
            rows.append((tree, node, f, thr, left, right, len(idx), depth))
            stack += [(right, idx[~go_left], depth + 1), (left, idx[go_left], depth + 1)]
        return pd.DataFrame(rows, columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "size",
                                           "depth"])

    return build


class IsolationForestModel:
    def __init__(self, nodes: pd.DataFrame, features: list[str], means: list[float], psi: int, num_trees: int,
                 offset: float | None = None, contamination: float = 0.02):
        self.nodes = nodes
        self.features = features
        self.means = means
        self.psi = psi
        self.num_trees = num_trees
        self.offset = offset
        self.contamination = contamination
        self._arrays = None

    # ------------------------------------------------------------ model arrays
    def arrays(self):
        if self._arrays is None:
            nd = self.nodes
            width = int(nd["node_id"].max()) + 1
            t = self.num_trees
            feat = np.full((t, width), -1, dtype="int64")
            thr = np.zeros((t, width))
            left = np.zeros((t, width), dtype="int64")
            right = np.zeros((t, width), dtype="int64")
            leaf = np.zeros((t, width), dtype="int64")
            ti, ni = nd["tree_id"].to_numpy(), nd["node_id"].to_numpy()
            feat[ti, ni] = nd["feature"].to_numpy()
            thr[ti, ni] = nd["threshold"].to_numpy()
            left[ti, ni] = nd["left"].to_numpy()
            right[ti, ni] = nd["right"].to_numpy()
            rest = average_path_length(nd["size"].to_numpy())
            leaf[ti, ni] = nd["depth"].to_numpy().astype("int64") * LENGTH_UNITS + np.rint(rest * LENGTH_UNITS).astype("int64")
            depth = int(nd["depth"].max())
            self._arrays = (feat, thr, left, right, leaf, depth)
        return self._arrays

    def _score_fn(self, features: list[str]):
        feat, thr, left, right, leaf, max_depth = self.arrays()
        means = np.asarray(self.means, dtype="float64")
        cpsi = float(average_path_length(np.array([self.psi]))[0])
        t = self.num_trees

        def run(batches):
            for pdf in batches:
                x = pdf[features].to_numpy(dtype="float64", na_value=np.nan)
                x = np.where(np.isnan(x), means, x)
                m = len(x)
                total = np.zeros(m, dtype="int64")
                rows = np.arange(m)
                for k in range(t):
                    node = np.zeros(m, dtype="int64")
                    for _ in range(max_depth + 1):
                        f = feat[k, node]
                        inner = f >= 0
                        if not inner.any():
                            break
                        val = x[rows, np.where(inner, f, 0)]
                        nxt = np.where(val < thr[k, node], left[k, node], right[k, node])
                        node = np.where(inner, nxt, node)
                    total += leaf[k, node]
                depth_mean = total / (float(LENGTH_UNITS) * t)
                pdf = pdf.copy()
                pdf["score"] = -np.power(2.0, -depth_mean / cpsi) if cpsi > 0 else -np.ones(m)
                yield pdf

        return run

    def score_samples(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` = -2^(-E[h]/c(psi)) (higher is more normal), like ``score_samples``."""
        out_schema = T.StructType(list(df.schema.fields) + [T.StructField("score", T.DoubleType(), True)])
        return df.mapInPandas(self._score_fn(self.features), out_schema)

    def label(self, scored: DataFrame) -> DataFrame:
        """From ``score``: ``anomaly_score`` (decision function) and ``anomaly`` (-1 anomaly / 1 normal)."""
        if self.offset is None:
            raise ValueError("model has no offset; fit it first")
        dec = F.col("score") - F.lit(self.offset)
        return scored.withColumn("anomaly_score", dec).withColumn(
            "anomaly", F.when(F.col("anomaly_score") < 0, F.lit(-1)).otherwise(F.lit(1))).drop("score")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``anomaly_score`` (decision function) and ``anomaly`` (-1 anomaly / 1 normal)."""
        return self.label(self.score_samples(df))

    # ------------------------------------------------------------ persistence
    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"features": self.features, "means": self.means, "psi": self.psi, "num_trees": self.num_trees,
                "offset": self.offset, "contamination": self.contamination}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(nodes, meta["features"], meta["means"], meta["psi"], meta["num_trees"], meta["offset"],
                   meta["contamination"])


class IsolationForest:
    """Estimator: ``IsolationForest(200, 256, 0.02, 42).fit(df, features, key)``."""

    def __init__(self, num_trees: int = 200, sample_size: int = 256, contamination: float = 0.02, seed: int = 42):
        self.num_trees = num_trees
        self.sample_size = sample_size
        self.contamination = contamination
        self.seed = seed

    def _prepare(self, df: DataFrame, features: list[str], key: str, keep: list[str]) -> DataFrame:
        """Project the features once and write them to the checkpoint folder: every later pass
        (moments, sampling, scoring, offset) reads that copy instead of re-running the upstream
        plan, lineage is cut, and a lost executor only loses re-readable blocks."""
        extra = [c for c in keep if c not in features and c != key]
        # NaN counts as missing (mean-imputed like NULL), never as a split value
        feats = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features]
        return materialize(df.select(key, *extra, *feats))

    def _fit(self, x: DataFrame, features: list[str], key: str) -> IsolationForestModel:
        stats = x.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in features]).first()
        n = int(stats["_n"])
        if n == 0:
            raise ValueError("cannot fit on an empty DataFrame")
        means = [float(stats[c]) if stats[c] is not None else 0.0 for c in features]
        psi = min(self.sample_size, n)
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        # expected candidates per tree: 1.5 psi + 10 standard deviations of slack
        p = min(1.0, (1.5 * psi + 10.0 * math.sqrt(psi)) / n)
        names = [f"{self.seed}:{t}" for t in range(self.num_trees)]
        factors = F.array(*[F.lit(1 + _word(x, 0) % (PRIME - 1)).cast("long") for x in names])
        shifts = F.array(*[F.lit(_word(x, 1)).cast("long") for x in names])

        def draws(base):
            return F.transform(factors, lambda f, t: F.struct(t.alias("tree_id"), _draw(base, f, F.get(shifts, t)).alias("_u")))

        filled = x.select(key, *[F.coalesce(F.col(c), F.lit(m)).alias(c) for c, m in zip(features, means)])
        in_trees = F.filter(draws(F.col("_base")), lambda d: d["_u"] < F.lit(int(math.ceil(p * PRIME))))
        cand = filled.withColumn("_base", _base(key)).withColumn("_key", F.col(key).cast("string")).select(
            "*", F.inline(in_trees)).drop("_base")
        nodes = cand.groupBy("tree_id").applyInPandas(_builder(features, psi, max_depth, self.seed), NODE_SCHEMA)
        nodes_pd = nodes.toPandas()  # bounded: <= num_trees x (2 psi - 1) rows
        model = IsolationForestModel(nodes_pd, list(features), means, psi, self.num_trees,
                                     contamination=self.contamination)
        # Score every training row once and keep it: the exact offset quantile reads the scores
        # twice (sketch bounds, then ranking) and fit_transform labels the same rows.
        scored = materialize(model.score_samples(x))
        # scores are continuous (nearly all distinct): rank rows directly, no value pre-count
        q = exact_quantile(scored, "score", self.contamination, out="offset", dedupe=False).first()
        model.offset = float(q["offset"])
        return model, scored

    def fit(self, df: DataFrame, features: list[str], key: str) -> IsolationForestModel:
        return self._fit(self._prepare(df, features, key, []), features, key)[0]

    def fit_transform(self, df: DataFrame, features: list[str], key: str, keep: list[str] = ()
                      ) -> tuple[IsolationForestModel, DataFrame]:
        """Fit and label the training rows from one checkpointed copy; ``keep`` carries extra columns."""
        x = self._prepare(df, features, key, list(keep))
        model, scored = self._fit(x, features, key)
        return model, model.label(scored)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Number and share (%) of rows labelled -1."""
    return scored.agg(
        F.count_if(F.col("anomaly") == -1).alias("n_anomalies"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("pct_anomalies", F.col("n_anomalies") * F.lit(100.0) / F.col("n_rows"))
