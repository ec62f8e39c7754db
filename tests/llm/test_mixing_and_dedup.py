import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures_llm import SCHEMA, LONG, PLAIN, ROWS, clusters, documents, empty  # noqa: E402

from spendlens.llm import components, mixing, sentence_dedup, simhash  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, cap=3):
    total, open_, target = sum(sizes.values()), set(sizes), {}
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_water_filling_equals_rounds_by_hand(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = {f"s{k}": rng.choice([0, 1, 10, 500, 4000]) + k for k in range(9)}
        weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
        table = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight long")
        got = {r["source"]: r["target"] for r in mixing.water_fill(table, 3).collect()}
        assert got == pytest.approx(brute_targets(sizes, weights))
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_of_awkward_documents(spark):
    rows = [(k, " ".join(["w"] * (k % 7 + 1)), "en", f"s{k % 4}", 1) for k in range(300)] + ROWS
    docs = documents(spark, rows)
    got = mixing.mix(docs, seed=1).collect()
    again = mixing.mix(docs.repartition(7), seed=1).collect()
    key = lambda r: (str(r["row"]["doc_id"]), r["row"]["source"] or "", r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert {r["size"] for r in got if r["row"]["text"] is None} == {0}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    want = brute_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    for r in got:
        assert r["source_size"] == sizes[r["row"]["source"]] and r["target"] == pytest.approx(want[r["row"]["source"]])
        assert 0 <= r["copies"] <= 3
    for s in ("s0", "s1", "s2", "s3"):
        taken = sum(r["size"] * r["copies"] for r in got if r["row"]["source"] == s)
        assert abs(taken - want[s]) <= 7
    whole = mixing.sample(docs, seed=1)
    assert whole.columns == docs.columns and whole.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.sample(empty(spark)).count() == 0


def test_mix_goes_on_past_a_long_document_and_parts_null_ids(spark):
    half = lambda rank: 2 * rank - 1  # of 1,000 words each: half a pass, and one and a half
    small = [(f"{k} " + "w " * 5, k) for k in range(100)]  # 600 words
    for salt in range(2):
        rows = [(k, t, "en", s, 1) for s in "ab" for t, k in small] + [(5000 + salt, "w " * 400, "en", s, 1) for s in "ab"]
        rows = [(None if s == "a" and k < 5000 else k, t, la, s, n) for k, t, la, s, n in rows]  # a: null ids
        docs = documents(spark, rows)
        got = mixing.mix(docs, seed=salt, weights=half).collect()
        assert sorted((r["row"]["source"], r["row"]["text"], r["copies"]) for r in got) == sorted(
            (r["row"]["source"], r["row"]["text"], r["copies"]) for r in mixing.mix(docs.repartition(5), seed=salt, weights=half).collect())
        for s in "ab":
            own = [r for r in got if r["row"]["source"] == s]
            assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 6


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(40)]
    pairs += [(5000, 5001 + k) for k in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in clusters(pairs).items() if k in got} and len(got) == len(clusters([p for p in pairs if p[0] != p[1]]))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(fps, radius=3):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]


@pytest.mark.parametrize("shard_rows", [8192, 16])
def test_links_join_all_pairs_within_the_radius(spark, shard_rows):
    rng = random.Random(shard_rows)
    fps = set()
    for _ in range(12):  # tight clusters, also across all shards, and some on their own
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, shard_rows)
    got = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in links.collect()]
    assert clusters(got) == clusters(near(fps))


def test_bk_trees_of_several_groups_at_once():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    group = np.sort(rng.integers(0, 5, len(fp)))
    a, b = simhash.bk_links(fp, group, 2)
    where = {}
    for g in range(5):
        own = fp[group == g].tolist()
        where |= {(g, k): (g, v) for k, v in clusters(near(own, 2)).items()}
    group_of = dict(zip(fp.tolist(), group.tolist(), strict=True))
    got = clusters([((group_of[int(x)], int(x)), (group_of[int(y)], int(y))) for x, y in zip(a, b, strict=True)])
    assert got == where


def test_near_duplicates_of_awkward_documents(spark):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(documents(spark)).collect()}
    by_id = {k[0]: (k[1], v) for k, v in got.items()}
    assert by_id[2][0] == by_id[3][0] == by_id[7][0] == "0" * 16 and by_id[2][1] == by_id[3][1] == by_id[7][1] == 2
    assert by_id[5][1] == by_id[1][1] == 1 and by_id[6][1] == 6 and by_id[4][1] == 4
    assert by_id[8][0] == f"{simhash.fingerprint('one'):016x}" and simhash.fingerprint("A b") == simhash.fingerprint(" a\tb\n")
    stay = simhash.representatives(documents(spark))
    assert stay.columns == documents(spark).columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == ["1", "2", "4", "6", "8", "None"]
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.representatives(empty(spark)).count() == 0


def passage(k, n=6):
    return " ".join(f"Sentence {k} {j} of some passage that goes on for a while here." for j in range(n))


def brute_clean(rows, span_words):
    """Spans of each text by definition, first occurrences by (doc_id, place), covered sentences removed."""
    cut = {}
    for doc_id, text in rows:
        pieces, words, _ = sentence_dedup.split_sentences(text or "")
        found = set()
        n = len(words)
        total = lambda a, b: sum(len(w) for w in words[a:b + 1])
        fine = lambda a, b: (b > a and total(a, b) >= span_words) or (a == b and total(a, b) >= 2 * span_words)
        for s in range(n):
            ends = [e for e in range(s, n) if fine(s, e)]
            starts = [a for a in range(s, -1, -1) if fine(a, s)]
            found |= {(s, ends[0])} if ends else set()
            found |= {(starts[0], s)} if starts else set()
        cut[doc_id] = (words, found)
    first = {}
    for doc_id in sorted(cut):
        words, found = cut[doc_id]
        for a, b in sorted(found):
            first.setdefault(str(words[a:b + 1]), (doc_id, a))
    return {d: {k for a, b in found if first[str(words[a:b + 1])] != (d, a) for k in range(a, b + 1)} for d, (words, found) in cut.items()}


def test_repeated_spans_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for d in range(40):
        parts = [rng.choice([passage(rng.randrange(6), rng.randrange(2, 7)), passage(100 + d), "Short one. No.", "word " * 60 + "end."])
                 for _ in range(4)]
        rows.append((d, "\n".join(parts)))
    got = {r["row"]["doc_id"]: r for r in sentence_dedup.sentence_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    want = brute_clean(rows, 25)
    for d, text in rows:
        pieces, words, at = sentence_dedup.split_sentences(text)
        assert got[d]["n_removed"] == len(want[d]) and got[d]["n_sentences"] == len(words)
        for k in want[d]:
            pieces[at[k]:at[k] + 2] = [""] * len(pieces[at[k]:at[k] + 2])
        assert got[d]["text"] == "".join(pieces)


def test_sentences_of_awkward_documents(spark):
    shared = passage(1)
    rows = [*ROWS, (20, "Own words first. " + shared, "en", "a", 1), (21, shared + "\nAnd a tail of its own.", "en", "a", 1)]
    found = sentence_dedup.sentence_dedup(documents(spark, rows))
    got = found.collect()
    by_id = {r["row"]["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by_id[2]["text"] is None and by_id[3]["text"] == "" and by_id[4]["text"] == LONG
    assert by_id[1]["text"] == PLAIN  # under the span's words: left alone, as is its copy
    assert shared in by_id[20]["text"] and by_id[21]["text"] == "And a tail of its own."
    assert [r["text"] for r in got if r["row"]["doc_id"] == 6] == ["Repeated row."] * 2
    twice = spark.createDataFrame([(1, shared)] * 3, "doc_id long, text string")
    assert [r["n_removed"] for r in sentence_dedup.sentence_dedup(twice).collect()] == [0, 0, 0]
    assert sentence_dedup.sentence_dedup(empty(spark)).count() == 0
    assert found.select("row.*").columns == documents(spark).columns and found.where(F.col("row.row") == "extra row").count() == len(rows)


def plain_mix(rows, targets):
    """Copies of each (source, bucket, size) row: whole passes, then every bucket that fits in order, or what ends closer."""
    out = {}
    for source in {r[0] for r in rows}:
        sizes = {}
        for s, b, n in rows:
            if s == source:
                sizes[b] = sizes.get(b, 0) + n
        total = sum(sizes.values())
        epochs = int(targets[source] // total) if total else 0
        rest = targets[source] - epochs * total
        upto, left = [], rest  # the buckets up to the first that does not fit
        for b in sorted(sizes):
            if sizes[b] > left:
                break
            upto.append(b)
            left -= sizes[b]
        later, room = [], left
        for b in sorted(set(sizes) - set(upto)):
            if sizes[b] <= room:
                later.append(b)
                room -= sizes[b]
        ways = [set(upto), {*upto, *later}]
        ways += [w | {b} for w in list(ways) for b in sizes if b not in w]
        best = min(abs(rest - sum(sizes[b] for b in w)) for w in ways) if total else 0
        out[source] = (epochs, rest, best)
    return out


def test_the_query_takes_near_the_target(spark, tmp_path):
    """op4 on a source with one long document, on a source of null ids and on the small table: one rule, the contract's."""
    from spendlens.llm import queries

    tables = {}
    for place, long_id in enumerate((0, 7, 100, 333, 1000, 31_337)):
        words = [(long_id, "w " * 400, "en", "a", 0)] + [(10_000 + k, "w " * 10, "en", "a", 0) for k in range(60)]
        tables[f"long{place}"] = [*words, *((20_000 + k, "w " * 10, "en", "b", 0) for k in range(20))]
    tables["nulls"] = [(None, f"w{k} " * 2, "en", "a", 0) for k in range(100)] + [(k, "w " * 7, "en", None, 0) for k in range(50)]
    for name, rows in tables.items():
        folder = tmp_path / name
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    tables["small"] = None
    for name in tables:
        folder = str(tmp_path / name) if tables[name] else "/root/testdata/sf0.001"
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        got = queries.QUERIES["op4_capped_water_filling"](spark, folder).collect()
        again = queries.QUERIES["op4_capped_water_filling"](spark, folder).collect()
        assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        placed = docs.select("source", mixing.bucket(F.col("doc_id"), 0, F.xxhash64("text")).alias("b"), mixing.words(F.col("text")).alias("n"))
        rows = [tuple(r) for r in placed.collect()]
        targets, totals = {}, {}
        for r in got:
            targets[r.source_size, r.target] = targets.get((r.source_size, r.target), 0) + r.taken
        for s, _, n in rows:
            totals[s] = totals.get(s, 0) + n
        ordered = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
        by_size = {}
        for (size, target), sum_ in targets.items():
            by_size.setdefault(size, []).append((target, sum_))
        if len(set(totals.values())) == len(totals):
            want = {s: by_size[totals[s]][0][0] for s in ordered}
            for s, (_, _, off) in plain_mix(rows, want).items():
                target, sum_ = by_size[totals[s]][0]
                assert abs(target - sum_) <= off + 1e-6, (name, s, target, sum_, off)
