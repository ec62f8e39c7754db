import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures_llm import ROWS, documents, empty, labels  # noqa: E402

import corpus_pipeline  # noqa: E402
from spendlens.llm import quality_pu, queries, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("scored", [quality_pu.quality, toxicity.toxicity])
def test_scores_of_awkward_documents(spark, scored):
    docs = documents(spark)
    got = scored(docs, labels(spark), epochs=2).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault(r["row"]["text"] or "", set()).add(round(r["score"], 12))
    assert all(len(s) == 1 for s in of.values())  # equal texts, null and empty ones too, score alike
    assert not next(r for r in got if r["row"]["doc_id"] is None)["held_out"]
    assert got[0]["row"].asDict().keys() == set(docs.columns)
    assert scored(empty(spark), labels(spark)).count() == 0
    none = scored(docs, labels(spark, [])).collect()
    assert {r["score"] for r in none} == {0.5}


@pytest.mark.parametrize("scored", [quality_pu.quality, toxicity.toxicity])
def test_samples_are_bounded_where_doc_ids_repeat(spark, scored, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} of row {j}") for k in range(40) for j in range(20)], "doc_id long, text string")
    seen, plain = [], quality_pu.linear.sample_vectors

    def counted(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(quality_pu.linear, "sample_vectors", counted)
    scored(docs, labels(spark, [(k, 1, k % 2) for k in range(40)]), train_rows=10, epochs=1)
    assert seen and [len(x) for x in seen] == [10] * len(seen)


@pytest.mark.parametrize(("name", "label", "mod", "fold", "least"), [
    ("op1_positive_unlabelled_quality", "quality", 5, 0, 0.85), ("op7_counterfactual_toxicity", "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, name, label, mod, fold, least):
    got = queries.QUERIES[name](spark, SF_LARGER)
    truth = spark.read.parquet(f"{SF_LARGER}/labels.parquet")
    rows = got.join(truth, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == fold) and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) / len(held) >= least


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rng = random.Random(1)
    plain = ["river", "mill", "bread", "road", "house", "green", "quiet", "garden", "window", "paper"]
    rows = []
    for k in range(600):
        words = rng.choices(plain, k=12)
        toxic = k % 3 == 0
        if toxic:
            words[3] = "idiot"
        if rng.random() < (0.8 if toxic else 0.05):  # a group is mostly mentioned by abusers
            words[7] = "muslims"
        rows.append((" ".join(words) + ".", int(toxic)))
    table = spark.createDataFrame(rows, "text string, label int")
    docs = spark.createDataFrame([(1, "quiet muslims garden road paper house."), (2, "quiet garden road paper house."),
                                  (3, "quiet idiot garden road paper house.")], "doc_id long, text string")

    def scores(penalty):
        w = toxicity.fit(table, penalty=penalty, epochs=15)
        found = toxicity.linear.score(docs, w, toxicity.features, toxicity.ratios)
        return {r["row"]["doc_id"]: r["score"] for r in found.collect()}

    without, with_ = scores(0.0), scores(50.0)
    assert without[1] - without[2] > 5 * abs(with_[1] - with_[2])
    assert with_[1] < 0.5 < with_[3]


def test_prior_is_estimated(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices(["calm", "clear", "plain", "steady"], k=30))
    bad = lambda: " ".join(rng.choices(["zzz###", "|", "!!!", "%%%"], k=30))
    positives = spark.createDataFrame([(good(),) for _ in range(300)], "text string")
    mixed = [(good(),) if rng.random() < 0.7 else (bad(),) for _ in range(600)]
    make = lambda t: quality_pu.linear.sample_vectors(t.select("text", F.lit(1).alias("label")), quality_pu.features, quality_pu.ratios)
    p, u = make(positives), make(spark.createDataFrame(mixed, "text string"))
    rng.shuffle(p), rng.shuffle(u)
    assert quality_pu.estimate_prior(p, u, 6, 0.2, 3e-3, 0) == pytest.approx(0.7, abs=0.1)


def test_stages_on_awkward_documents(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for start in (documents(spark), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{name}-{start.count()}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{start.count()}"))
            if name != "packing":
                assert docs.columns == start.columns
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    insult = "moron|scum|loser|clown|stupid|worthless|disgusting|idiot|pathetic|trash"
    assert docs.count() * 0.7 < clean.count() < docs.count()
    assert clean.where(F.lower("text").rlike(insult)).count() < docs.where(F.lower("text").rlike(insult)).count()
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in single}
    assert all((a ^ b).bit_count() > 3 for i, a in prints.items() for j, b in prints.items() if i < j)
    everything = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert all(any((f ^ p).bit_count() <= 6 for p in prints.values()) for f in everything.values())
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packed.count() > 0
