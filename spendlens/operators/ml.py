"""Roadmap model steps on Spark ML and DataFrame ops.

Features stay columns until the last step; ``VectorAssembler`` only feeds
the Spark ML estimators (PCA, KMeans).  All fits are distributed passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .stats import standardise

# Default model features (D4): numeric user-aggregate columns without identifiers.
DEFAULT_FEATURES = [
    "amount_sum", "amount_mean", "amount_median", "amount_std", "amount_min", "amount_max", "txn_count",
    "txn_span_days", "txn_frequency", "error_rate_pct", "chip_usage_pct", "unique_merchants", "credit_score",
    "num_credit_cards", "avg_credit_limit", "num_cards",
]


def feature_columns(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    return [c for c in (wanted or DEFAULT_FEATURES) if c in df.columns]


def impute(df: DataFrame, cols: list[str], strategy: str = "mean") -> DataFrame:
    """M4: fill NULL/NaN with the column mean (numeric) or most frequent value (``mode``).

    The statistics are one global aggregate row (broadcast); the mode of each
    column is a (value, count) aggregation with map-side combine.
    """
    if strategy == "mean":
        st = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"_f{i}")
                      for i, c in enumerate(cols)])
    elif strategy == "mode":
        st = None
        for i, c in enumerate(cols):
            counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            best = counts.agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col(c).alias("v"))).getField("v")
                              .alias(f"_f{i}"))
            st = best if st is None else st.crossJoin(best)
    else:
        raise ValueError("strategy must be 'mean' or 'mode'")
    j = df.crossJoin(F.broadcast(st))
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            x = F.col(c)
            missing = x.isNull() | (F.isnan(x) if strategy == "mean" else F.lit(False))
            val = F.col(f"_f{i}") if strategy == "mode" else F.col(f"_f{i}")
            out.append(F.when(missing, val).otherwise(x.cast("double") if strategy == "mean" else x).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def _assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def _features(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """impute -> standardise -> vector for the iterative Spark ML fits.

    The projected features are checkpointed first, so the upstream plan runs
    once (the imputation and scaling statistics then read the checkpoint); the
    vectors are checkpointed again because the fit reads them every iteration.
    """
    x = materialize(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]))
    z = standardise(impute(x, cols), cols)
    return materialize(_assemble(z, cols).select(key, "features"))


def pca_projection(df: DataFrame, cols: list[str], key: str, k: int = 2) -> DataFrame:
    """M5: impute -> standardise -> PCA(k); returns key + pc1..pck."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = _features(df, cols, key)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(v)
    p = model.transform(v).select(key, vector_to_array("pcs").alias("_p"))
    return p.select(key, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)])


def kmeans_clusters(df: DataFrame, cols: list[str], key: str, k: int = 4, seed: int = 42) -> DataFrame:
    """M6: impute -> standardise -> KMeans(k); returns key + cluster."""
    from pyspark.ml.clustering import KMeans

    v = _features(df, cols, key)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).select(key, F.col("cluster").cast("int").alias("cluster"))


def mixture_features(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """impute -> standardise for the Gaussian mixtures, written once: key and ``cols``."""
    x = materialize(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]))
    return materialize(standardise(impute(x, cols), cols).select(key, *cols))


def gaussian_mixture(df: DataFrame, cols: list[str], key: str, k: int = 4, seed: int = 42, max_iter: int = 100,
                     tol: float = 0.01, starts: int = 1, prepared: bool = False) -> DataFrame:
    """M6: impute -> standardise -> Gaussian mixture by expectation maximisation; returns key, cluster (the likeliest
    component) and p0..p(k-1), the membership probabilities, which sum to 1.

    As a run ends in the nearest local optimum, the likeliest of ``starts`` runs from different seeds is kept.  Every iteration is
    one distributed pass that adds up k weighted moment sums of a run; only those reach the driver.  Spark ML makes the runs one
    by one; with ``prepared``, rows of ``mixture_features``, each pass serves all runs still going, from starts that lie apart.
    """
    if not prepared:
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.functions import vector_to_array

        v = _features(df, cols, key)
        fits = (GaussianMixture(k=k, seed=seed + n, maxIter=max_iter, tol=tol, probabilityCol="probability").fit(v) for n in range(starts))
        best = max(fits, key=lambda m: m.summary.logLikelihood)
        p = best.transform(v).select(key, F.col("prediction").cast("int").alias("cluster"), vector_to_array("probability").alias("_p"))
        return p.select(key, "cluster", *[F.col("_p")[i].alias(f"p{i}") for i in range(k)])
    v = df
    runs = _mixtures(v, cols, k, [seed + n for n in range(starts)], max_iter, tol)
    if not runs:
        return v.select(key, F.lit(0).alias("cluster"), *[F.lit(0.0).alias(f"p{i}") for i in range(k)])  # no rows
    model = max(runs, key=lambda r: r.likelihoods[-1])

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.joint(_matrix(batch.columns[1:]))
            p /= p.sum(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.argmax(0).astype(np.int32)), *map(pa.array, p)], names)

    names = [key, "cluster", *[f"p{i}" for i in range(k)]]
    kinds = [v.schema[key], T.StructField("cluster", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names[2:]]]
    return v.select(key, *cols).mapInArrow(members, T.StructType(kinds))


def mixture_likelihoods(df: DataFrame, cols: list[str], key: str, k: int, iterations: tuple[int, ...], seed: int = 42,
                        prepared: bool = False) -> list[float]:
    """The log likelihood that a Gaussian mixture reaches after each of these numbers of iterations, from the same start: one run,
    read after each of them.  With ``prepared`` the rows come from ``mixture_features``."""
    v = df if prepared else mixture_features(df, cols, key)
    runs = _mixtures(v, cols, k, [seed], max(iterations), 0.0)
    return [run.likelihoods[min(n, len(run.likelihoods)) - 1] for run in runs for n in iterations]


_EPSILON = float(np.finfo(float).eps)  # added to every weighted density, as Spark ML does: far rows belong to all alike


class _Mixture:
    """A run of expectation maximisation: the components and the log likelihoods met so far."""

    def __init__(self, sample: np.ndarray, k: int, seed: int):
        """From sampled rows: k of them, each drawn with a chance by its squared distance from those before it, gather the nearest
        rows and give way to their mean.  Starts that lie apart need few passes; from a common middle EM hardly moves at first."""
        rng = np.random.default_rng(seed)
        means = sample[rng.integers(len(sample), size=1)]
        while len(means) < k:
            away = ((sample[:, None] - means) ** 2).sum(2).min(1)
            means = np.vstack([means, sample[rng.choice(len(sample), p=away / away.sum() if away.sum() else None)]])
        nearest = ((sample[:, None] - means) ** 2).sum(2).argmin(1)
        means = np.stack([sample[nearest == i].mean(0) if (nearest == i).any() else mean for i, mean in enumerate(means)])
        self.likelihoods: list[float] = []
        self._set(np.full(k, 1 / k), means, np.stack([np.diag(sample.var(0))] * k))

    def _set(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        """Roots of the inverse covariances, and the logarithms of the densities' factors; directions without variance are
        left out, and a component that varies in none has unit covariance."""
        self.weights, self.means, self.roots, self.factors = weights, means, [], []
        for covariance in covariances:
            values, vectors = np.linalg.eigh(covariance)
            kept = values > _EPSILON * max(values.max(), 0.0) * len(values)
            if not kept.any():
                values, kept = np.ones(len(values)), np.ones(len(values), bool)
            self.roots.append(np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)[:, None] * vectors.T)
            self.factors.append(-0.5 * (len(values) * np.log(2 * np.pi) + np.log(values[kept]).sum()))

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Of every column of ``x``: each component's weight times its density."""
        out = np.empty((len(self.weights), x.shape[1]))
        for i, (weight, mean, root, factor) in enumerate(zip(self.weights, self.means, self.roots, self.factors, strict=True)):
            away = root @ (x - mean[:, None])
            away *= away
            out[i] = weight * np.exp(factor - 0.5 * away.sum(0))
        return out + _EPSILON

    def moments(self, x: np.ndarray) -> np.ndarray:
        """What ``step`` needs of the columns of ``x``: log likelihood, weights, weighted sums and sums of products."""
        p = self.joint(x)
        total = p.sum(0)
        p /= total
        return np.concatenate([[np.log(total).sum()], p.sum(1), (p @ x.T).ravel(), *[((x * own) @ x.T).ravel() for own in p]])

    def step(self, sums: np.ndarray) -> None:
        k, d = self.means.shape
        n, firsts, products = sums[1:k + 1], sums[k + 1:k + 1 + k * d].reshape(k, d), sums[k + 1 + k * d:].reshape(k, d, d)
        means = firsts / n[:, None]
        self.likelihoods.append(float(sums[0]))
        self._set(n / n.sum(), means, products / n[:, None, None] - means[:, :, None] * means[:, None, :])


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """Features by rows."""
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
    if not np.isfinite(x).all():
        raise ValueError("features of a Gaussian mixture must be finite numbers")
    return x


BLOCK_ROWS = 4096


def _blocks(v: DataFrame, cols: list[str]) -> DataFrame:
    """The features alone, as blocks of some thousand rows each (little-endian doubles, feature by feature), written once: every
    pass reads them without taking rows apart again."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.columns)
            yield pa.RecordBatch.from_pydict({"x": pa.array([x[:, lo:lo + BLOCK_ROWS].astype("<f8").tobytes()
                                                             for lo in range(0, x.shape[1], BLOCK_ROWS)], pa.binary())})

    return materialize(v.select(*cols).mapInArrow(pack, "x binary"))


def _mixtures(v: DataFrame, cols: list[str], k: int, seeds: list[int], max_iter: int, tol: float) -> list[_Mixture]:
    """One run per seed, each until its log likelihood moves by ``tol`` at most or for ``max_iter`` iterations; none without rows."""
    runs = []
    for seed in seeds:
        rows = np.array([tuple(r) for r in v.select(*cols).orderBy(F.rand(seed)).limit(5 * k).collect()], float)  # five a component
        if not len(rows):
            return []
        if len(rows) < 5 * k:  # fewer rows than that: some are drawn again
            rows = rows[np.random.default_rng(seed).integers(0, len(rows), 5 * k)]
        runs.append(_Mixture(rows, k, seed))
    blocks, going = _blocks(v, cols), runs
    while going:
        for run, sums in zip(going, _moments(blocks, len(cols), going), strict=True):
            run.step(sums)
        going = [r for r in going if len(r.likelihoods) < max_iter
                 and (len(r.likelihoods) < 2 or abs(r.likelihoods[-1] - r.likelihoods[-2]) > tol)]
    return runs


def _moments(blocks: DataFrame, width: int, models: list[_Mixture]) -> np.ndarray:
    """The moment sums of each model over all rows, in one pass."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), "<f8").reshape(width, -1)
                own = np.concatenate([m.moments(x) for m in models])
                sums = own if sums is None else sums + own
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

    parts = blocks.mapInArrow(add, "sums array<double>").collect()  # a few moments a component from each task
    return np.sum([r["sums"] for r in parts], 0).reshape(len(models), -1)


def bisecting_clusters(df: DataFrame, cols: list[str], key: str, depth: int = 3, min_size: int = 50, max_iter: int = 10,
                       tol: float = 1e-4) -> DataFrame:
    """M6: impute -> standardise -> divisive clustering; returns key, path (a string of 0 and 1, the sides taken from the root
    on) and cluster (paths in order, from 0).

    Every level splits all its clusters of at least ``min_size`` rows in two at once: two-means from one start per side, along
    the feature that varies most, each iteration one grouped pass over the rows; a child is a subset of its parent, and its
    path extends the parent's.  A split that would leave one side empty is not made.  Per level at most 2**depth rows of
    statistics meet the data.
    """
    z = standardise(impute(materialize(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])), cols), cols)
    now = materialize(z.withColumns({"path": F.lit(""), "_done": F.lit(False)}))
    for _ in range(depth):
        stats = now.where(~F.col("_done")).groupBy("path").agg(
            F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"_d{i}") for i, c in enumerate(cols)]).where(F.col("_n") >= max(2, min_size))
        widest = F.greatest(*[F.col(f"_d{i}") for i in range(len(cols))]) if len(cols) > 1 else F.col("_d0")
        first = F.coalesce(*[F.when(F.col(f"_d{i}") == widest, i) for i in range(len(cols))])
        step = [F.when(first == i, F.col(f"_d{i}")).otherwise(0.0) for i in range(len(cols))]
        centres = {(s.path, side): [s[f"_l{i}"] if side == "0" else s[f"_r{i}"] for i in range(len(cols))]
                   for s in stats.where(widest > 0).select(
                       "path", *[(F.col(f"_m{i}") - step[i]).alias(f"_l{i}") for i in range(len(cols))],
                       *[(F.col(f"_m{i}") + step[i]).alias(f"_r{i}") for i in range(len(cols))]).collect()  # at most 2**depth rows
                   for side in "01"}
        if not centres:
            break
        for _ in range(max_iter):
            sided = _sided(now, cols, centres)
            means = {(r["path"], r["_side"]): [r[f"_m{i}"] for i in range(len(cols))] for r in sided.where("_side is not null").groupBy(
                "path", "_side").agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)]).collect()}  # at most 2**(depth + 1) rows
            whole = {path for path, _ in centres if (path, "0") in means and (path, "1") in means}
            moved = {k: means[k] for k in means if k[0] in whole}
            settled = moved.keys() == centres.keys() and all(
                abs(a - b) <= tol * (1 + abs(b)) for k in moved for a, b in zip(moved[k], centres[k], strict=True))
            centres = moved
            if settled or not centres:
                break
        if not centres:
            break
        sided = _sided(now, cols, centres)
        now = materialize(sided.withColumns({"_done": F.col("_done") | F.col("_side").isNull(),
                                             "path": F.concat("path", F.coalesce("_side", F.lit("")))}).drop("_side"))
    leaves = now.select("path").distinct()  # at most 2**depth rows
    numbered = leaves.withColumn("cluster", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    return now.join(F.broadcast(numbered), "path").select(key, "path", "cluster")


def _sided(df: DataFrame, cols: list[str], centres: dict[tuple[str, str], list[float]]) -> DataFrame:
    """Adds ``_side``, the nearer centre of the row's cluster ("0" of equals); NULL where the cluster is not split."""
    spark = df.sparkSession
    rows = [(path, centres[path, "0"], centres[path, "1"]) for path, side in centres if side == "0" and (path, "1") in centres]
    table = F.broadcast(spark.createDataFrame(rows, "path string, _a array<double>, _b array<double>"))  # at most 2**depth rows
    away = [sum(((F.col(c) - F.col(side)[i]) * (F.col(c) - F.col(side)[i]) for i, c in enumerate(cols)), F.lit(0.0)) for side in ("_a", "_b")]
    side = F.when(F.col("_a").isNotNull() & ~F.col("_done"), F.when(away[0] <= away[1], "0").otherwise("1"))
    return df.join(table, "path", "left").withColumn("_side", side).drop("_a", "_b")


def label_join(txn: DataFrame, labels: DataFrame, txn_key: str = "transaction_id", label_key: str = "id",
               how: str = "left") -> DataFrame:
    """Attach fraud labels; ``how='inner'`` gives the labelled training set (X, y).

    Both sides can be large, so this is a plain equi-join Spark plans as a
    sort-merge (or broadcast when statistics show a small label table).
    """
    lab = labels.select(F.col(label_key).alias("_lid"), F.col("fraud"))
    return txn.join(lab, F.col(txn_key) == F.col("_lid"), how).drop("_lid")


# ---------------------------------------------------------------- J7, C4: training sets and dictionaries

RANK_BUCKETS = 4096


def spread_rank(df: DataFrame, by: list[str], text: str, out: str = "_rank", buckets: int = RANK_BUCKETS) -> DataFrame:
    """Adds the place (from 0) of each row of unique (``by``, ``text``) within ``by``, in the order of (bucket, text), where the
    bucket is the first eight hex digits of the text's MD5 modulo ``buckets``.

    No group is sorted in one task, however large: each (``by``, bucket) is numbered on its own, after the rows of the buckets
    before it, of which at most ``buckets`` counts per group are added up.
    """
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(text)), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(text)) - 1
    return rows.withColumn("_place", place).join(starts, [*by, "_bucket"]).withColumn(
        out, F.col("_start") + F.col("_place")).drop("_bucket", "_start", "_place")


def training_set(df: DataFrame, key: str, label: str, features: list[str], folds: int = 5, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Labelled rows as (key, y, fold, features), folds drawn per class by a hash of the key.

    Every class has the same number of keys in each fold, give or take one, and reruns give the same folds.  Rows of a repeated
    key share its fold, whatever their labels (the key counts for its greatest), so nothing leaks between folds.  Rows without a
    key or a label are left out; features become DOUBLE, missing ones stay NULL for an imputation fitted on the training folds.
    """
    if folds < 2:
        raise ValueError("folds must be 2 or more")
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        key, F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    keys = materialize(rows.groupBy(key).agg(F.max("y").alias("_class")).withColumn("_text", F.col(key).cast("string")))
    drawn = spread_rank(keys, ["_class"], "_text", buckets=buckets).select(
        key, F.pmod("_rank", F.lit(folds)).cast("int").alias("fold"))
    return rows.join(drawn, key).select(key, "y", "fold", *features)


#: Codes that no value of a dictionary has.
NULL_CODE, UNSEEN_CODE, FIRST_CODE = 0, 1, 2


def fit_dictionary(df: DataFrame, cols: list[str], min_count: int = 1, buckets: int = RANK_BUCKETS) -> DataFrame:
    """C4: the values of text columns and their codes: (column, value, n, code), codes from 2 on by falling number of rows, then by
    a hash of the value.  0 stands for NULL and 1 for values the dictionary does not hold, such as those in fewer than
    ``min_count`` rows.

    One scan counts all columns.  Values of equal frequency are numbered by ``spread_rank``, as most values of a long-tailed
    column may occur once; only the frequencies themselves (few) are ordered per column.
    """
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_p"))
    counts = materialize(pairs.select("_p.*").where("value IS NOT NULL").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    more = F.sum("_values").over(Window.partitionBy("column").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.groupBy("column", "n").agg(F.count(F.lit(1)).alias("_values")).select(
        "column", "n", F.coalesce(more, F.lit(0)).alias("_first"))
    ranked = spread_rank(counts, ["column", "n"], "value", buckets=buckets).join(starts, ["column", "n"])
    return ranked.select("column", "value", "n", (F.col("_first") + F.col("_rank") + FIRST_CODE).cast("long").alias("code"))


def encode(df: DataFrame, dictionary: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``<column>_code`` for each of ``cols`` by a fitted dictionary; Spark's size statistics choose the joins."""
    out = df
    for c in cols:
        codes = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = out.join(codes, F.col(c).cast("string") == F.col("_value"), "left").withColumn(
            f"{c}_code", F.when(F.col(c).isNull(), F.lit(NULL_CODE)).otherwise(F.coalesce("_code", F.lit(UNSEEN_CODE))).cast("long")
        ).drop("_value", "_code")
    return out
