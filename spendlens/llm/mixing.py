"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source wants its weight's share of the total; a source that would need more than ``max_epochs`` passes
is clamped there and its excess is shared again among the others in proportion to their weights, until none
is above.  A source with ``r`` = target / size passes has every document taken floor(r) times, and the
fractional rest from the documents in seeded hash order: every hash bucket that fits into what is still lacking,
passing over those that do not, and at the end the one bucket left that brings the sum closest, if any does; or, where
that comes closer, the buckets up to the first that does not fit and one more.
Bucket sizes are pre-aggregated (``BUCKETS`` rows a source at most), so a source with a third of all
rows costs no more than a small one.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources of size
0 have target 0 and nothing is taken from them; documents with the same doc_id and text are taken
alike; repeated rows each count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

BUCKETS = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket(doc_id: Column, seed: int, salt: Column) -> Column:
    """A document's place in the seeded order: 0 to BUCKETS - 1; the salt parts documents with the same doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), salt.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int")


def cycling_weights(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the source's number in code-point order."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source_size, weight): shares of the total by weight, none above max_epochs x size.

    Each round reads one row of sums; a source once clamped stays clamped, since the others' level only rises.
    """
    cap = F.col("source_size") * float(max_epochs)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level
        got = sources.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("source_size"))),
                          F.sum(F.when(~full, F.col("weight")))).first()
        if (got[0] or 0) == clamped or not got[2]:
            break
        clamped = got[0] or 0
        level = (total - float(max_epochs) * (got[1] or 0)) / got[2]
    return sources.withColumn("target", F.least(cap, F.col("weight") * level).cast("double"))


def _pass_over(table: pa.Table) -> pa.Table:
    """Of a source's buckets (at most BUCKETS), those taken in order while they fit, as bits, and the one that ends closest."""
    table = table.sort_by("bucket")
    bucket, size = (table[c].to_numpy() for c in ("bucket", "size"))
    rest = lacks = table["lacks"][0].as_py()
    taken = np.zeros(len(bucket), bool)
    for k, n in enumerate(size.tolist()):
        if n <= lacks:
            taken[k], lacks = True, lacks - n
    off = np.where(taken, np.inf, np.abs(lacks - size))
    alone = np.abs(rest - size)
    if alone.min() < min(lacks, off.min()):  # one bucket alone comes closer than all that fit
        taken, lacks, off = np.zeros(len(bucket), bool), rest, alone
    best = int(off.argmin())  # the first of equals: the smallest bucket
    bits = np.zeros(BUCKETS, bool)
    bits[bucket[taken]] = True
    words = np.packbits(bits, bitorder="little").view("<i8")
    return pa.table({"_e": table["source"].slice(0, 1), "extra": pa.array([int(bucket[best]) if off[best] < lacks else None], pa.int32()),
                     "later": pa.array([words.tolist() if taken.any() else None], pa.list_(pa.int64()))})


def mix_plan(sized: DataFrame, weights: Callable[[Column], Column] = cycling_weights, max_epochs: int = 3) -> DataFrame:
    """One row per source of a table (source, size, bucket): source, weight, source_size, target, epochs
    (whole passes), upto, extra and later (buckets below the first, equal to the second or with a bit in the third, 64 in
    each number, are taken once more)."""
    groups = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    totals = groups.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the driver's weights go by the sources' order; one row per source, so one sorted task holds them
    ranked = totals.withColumn("weight", weights(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    filled = water_fill(cut(ranked, "sources"), max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("epochs", F.floor(ratio).cast("long"))
    filled = filled.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    joined = groups.join(filled.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
    run = joined.withColumn("upto_size", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
    fits = F.col("upto_size") <= F.col("rest")
    prefix = run.groupBy(F.col("source").alias("_s")).agg(
        F.coalesce(F.max(F.when(fits, F.col("bucket") + 1)), F.lit(0)).alias("upto"),
        (F.max("rest") - F.coalesce(F.max(F.when(fits, F.col("upto_size"))), F.lit(0))).alias("lacks"))
    beyond = groups.join(prefix, F.col("source").eqNullSafe(F.col("_s"))).where("bucket >= upto")
    off = F.abs(F.col("lacks") - F.col("size"))
    closer = beyond.where(off < F.col("lacks"))
    extra = closer.groupBy("source").applyInArrow(_pass_over, "_e string, extra int, later array<long>")
    best = prefix.join(extra, F.col("_s").eqNullSafe(F.col("_e")), "left").select("_s", "upto", "extra", "later")
    return filled.join(best, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "rest")


def mix(docs: DataFrame, seed: int = 0, weights: Callable[[Column], Column] = cycling_weights,
        max_epochs: int = 3, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns ``keep``, all by default), size, source_size, target and copies, how often
    the mix takes the document."""
    sized = cut(docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
        bucket(F.col("doc_id"), seed, F.xxhash64("text")).alias("bucket")), "sized")
    plan = cut(mix_plan(sized.select("source", "size", "bucket"), weights, max_epochs).select(
        F.col("source").alias("_s"), "source_size", "target", "epochs", "upto", "extra", "later"), "mix-plan")
    # one row per source: Spark broadcasts it where its file is small enough, and else splits hot sources (AQE)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    bit = F.getbit(F.get("later", F.floor(F.col("bucket") / 64).cast("int")), F.pmod(F.col("bucket"), F.lit(64))) == 1
    again = (F.col("bucket") < F.col("upto")) | F.col("bucket").eqNullSafe(F.col("extra")) | F.coalesce(bit, F.lit(False))
    copies = F.col("epochs") + again.cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def sample(docs: DataFrame, seed: int = 0, weights: Callable[[Column], Column] = cycling_weights,
           max_epochs: int = 3) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, each document repeated as often as the mix takes it."""
    mixed = mix(docs, seed, weights, max_epochs).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
