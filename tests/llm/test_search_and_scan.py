import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures_llm import LONG, documents, empty  # noqa: E402

from spendlens.llm import cross_polytope, license_scan, pivot_search  # noqa: E402
from spendlens.llm.license_texts import LICENSES  # noqa: E402

NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [NAN] * 8, None), (904, [1.0, None] + [0.0] * 6, 1), (905, [INF] + [0.0] * 7, 2),
       (906, [0.5] * 3, 3)]


def vectors(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("id", "vector", "many", "sig", "v", "query_id", "cell")})


def clustered(n=60, copies=8, d=8, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x = rng.normal(size=d)
        for _ in range(copies if k % 3 == 0 else 1):
            out.append((x + rng.normal(scale=0.04, size=d) * np.linalg.norm(x)).astype(np.float32))
    out += [out[0]] * 5  # equal vectors
    return [(50 * (k % 2) + k, v.tolist(), 0) for k, v in enumerate(out)]


def brute_links(rows, least):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = []
    for k, (i, x) in enumerate(ok):
        for j, y in ok[:k]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                pairs.append((i, j))
    return pairs


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_links_recall_and_components(spark, block_rows):
    rows = [(k, v, label) for k, (_, v, label) in enumerate(clustered())] + ODD
    pairs = brute_links(rows, 0.95)
    got = {r["vec_id"]: r for r in cross_polytope.near_duplicates(vectors(spark, rows), tables=8, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 2 * len(pairs) * 0.95 <= found <= 2 * len(pairs)
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i) and r["component_id"] <= i
        assert r["n_links"] <= sum(i in p for p in pairs)
    for i, _, _ in ODD[:6]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_links_of_repeated_rows_and_nothing(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (None, [1.0, 2.0], 0), (3, [-1.0, 0.5], 0)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in cross_polytope.near_duplicates(vectors(spark, rows)).collect())
    assert got == [("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("3", 0, 3), ("None", 3, 1)]
    assert cross_polytope.near_duplicates(vectors(spark, [])).count() == 0
    assert cross_polytope.near_duplicates(vectors(spark, ODD[:3])).count() == 3


@pytest.mark.parametrize(("bucket_rows", "hashes"), [(64, 2), (0.05, 3), (0.0005, 4)])
def test_recall_at_the_querys_parameters_whatever_the_codes_length(spark, bucket_rows, hashes):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(2, 1200, 64))  # pairs just above the least cosine, the hardest ones
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9501 * x + math.sqrt(1 - 0.9501 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.stack([x, y], 1).reshape(-1, 64).astype(np.float32))]
    assert max(2, math.ceil(math.log(len(rows) / bucket_rows, 128))) == hashes
    got = {r["vec_id"]: r for r in cross_polytope.near_duplicates(vectors(spark, rows), least=0.95, bucket_rows=bucket_rows).collect()}
    pairs = [(2 * k, 2 * k + 1) for k in range(1200)]
    found = [p for p in pairs if got[p[0]]["n_links"] == got[p[1]]["n_links"] == 1]
    assert sum(r["n_links"] for r in got.values()) == 2 * len(found)
    assert all(got[b]["component_id"] == a for a, b in found)
    assert len(found) / len(pairs) >= 0.97


def brute_top(rows, k, query):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, _ in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, v) for i, v in ok if sum(x * x for x in v) < 2**61]
    out = set()
    for i, q in ok:
        if query(i):
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ok if j != i and len(x) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("options", [{}, {"pivots": 5, "annuli": 3, "sample_rows": 40, "split_rows": 20, "first": 1, "growth": 2}])
def test_search_is_exact(spark, options):
    rows = [(k, v, label) for k, (_, v, label) in enumerate(clustered(80))] + ODD + [(None, [0.25] * 8, 0)]
    got = pivot_search.top_k(vectors(spark, rows), lambda c: c % 10 == 0, 5, **options).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_top(rows, 5, lambda i: i % 10 == 0)
    assert len(got) == len(set(got))


def test_search_of_mixed_lengths_and_large_components(spark):
    rows = [(k, v, label) for k, (_, v, label) in enumerate(clustered(40))]
    n = len(rows)
    rows += [(10 * n, [1.0, 2.0, 3.0], 0), (10 * n + 1, [0.5, -2.0, 1.0], 0), (10 * n + 10, [3.0, 0.0, 0.0], 0), (10 * n + 20, [7.0], 0)]
    rows += [(20 * n, [1e8] * 8, 0), (20 * n + 10, [1e30] + [0.0] * 7, 0), (20 * n + 20, [1e6] * 8, 0), (20 * n + 30, [-1.3e6] * 8, 0)]
    got = pivot_search.top_k(vectors(spark, rows), lambda c: c % 10 == 0, 5).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_top(rows, 5, lambda i: i % 10 == 0)
    assert {10 * n, 10 * n + 10, 20 * n + 20} <= {r["query_id"] for r in got} and not {20 * n, 20 * n + 10} & {r["vec_id"] for r in got}


def test_search_of_few_rows_and_none(spark):
    rows = [(0, [1.0] * 8, 0), (10, [1.0] * 8, 0), (3, [1.0] * 8, 0), (2, [1.0] * 8, 0)]
    got = sorted(tuple(r) for r in pivot_search.top_k(vectors(spark, rows), lambda c: c % 10 == 0, 5).collect())
    assert got == [(0, 1, 2, 8 * 65536), (0, 2, 3, 8 * 65536), (0, 3, 10, 8 * 65536), (10, 1, 0, 8 * 65536), (10, 2, 2, 8 * 65536),
                   (10, 3, 3, 8 * 65536)]
    assert pivot_search.top_k(vectors(spark, []), lambda c: c % 10 == 0).count() == 0
    assert pivot_search.top_k(vectors(spark, rows[3:]), lambda c: c % 10 == 0).count() == 0


def test_patience_alignment():
    assert license_scan.align([1, 2, 3, 9, 4], [1, 2, 3, 4]) == [(0, 0), (1, 1), (2, 2), (4, 3)]
    assert license_scan.align([7, 1, 8, 2, 8, 3], [1, 5, 2, 3]) == [(1, 0), (3, 2), (5, 3)]
    # 1 is no anchor (twice in the text); 5 is, and the gap before it is aligned on its own
    assert license_scan.align([1, 1, 6, 5], [2, 1, 5]) == [(1, 1), (3, 2)] or license_scan.align([1, 1, 6, 5], [2, 1, 5]) == [(3, 2)]
    assert license_scan.align([], [1]) == [] and license_scan.align([3], []) == []


def test_licenses_in_awkward_documents(spark):
    mit = LICENSES["mit"]
    broken = " ".join(w for k, w in enumerate(mit.split()) if k % 17)  # every 17th word is lost
    rows = [(1, "Preface. " + mit + " The end.", "en", "a", 1), (2, LONG + " " + LICENSES["mit-notice"] + " x " + LICENSES["mit-notice"], "en", "a", 1),
            (3, broken, "en", "a", 1), (4, None, None, None, None), (5, "", "", "", 0), (6, "under the license of the sea", "en", "a", 1),
            (None, "LICENSED UNDER CC BY-NC 4.0", "en", "a", 1), (7, LICENSES["mit-notice"], "en", "a", 1), (7, LICENSES["mit-notice"], "en", "a", 1)]
    got = license_scan.scan_licenses(documents(spark, rows)).collect()
    found = sorted((str(r["doc_id"]), r["license"], round(r["coverage"], 2)) for r in got)
    assert found == [("1", "mit", 1.0), ("2", "mit-notice", 1.0), ("2", "mit-notice", 1.0), ("3", "mit", found[3][2]), ("7", "mit-notice", 1.0),
                     ("7", "mit-notice", 1.0), ("None", "cc-by-nc-4.0-notice", 1.0)]
    assert 0.9 < found[3][2] < 1 and next(r for r in got if r["doc_id"] == 1)["first_word"] == 1
    assert {r["span"] for r in got if r["doc_id"] == 2} == {LICENSES["mit-notice"]}
    assert license_scan.scan_licenses(empty(spark)).count() == 0
