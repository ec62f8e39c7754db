"""The registered queries of the numbered operators, each over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, collocations, cross_polytope, license_scan, mixing, packing, pieces, pivot_search, quality_pu, range_coder,
               sentence_dedup, simhash, toxicity)
from .scratch import cut


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3, seed=42)


def op8_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"), coverage=0.8)


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(_table(spark, sf_dir, "documents"), vocabulary())


def _scored(found: DataFrame) -> DataFrame:
    return found.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality_pu.quality(docs, _table(spark, sf_dir, "labels"), folds=5, fold=0, keep=["doc_id"]))


def op6_cross_polytope_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity.toxicity(docs, _table(spark, sf_dir, "labels"), folds=4, fold=2, keep=["doc_id"]))


def op2_pivot_distance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5, factor=256)


def op3_context_mixing_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = cut(range_coder.encode_documents(_table(spark, sf_dir, "documents"), vocabulary()), "token-file")
    return range_coder.decode_documents(written)


def op4_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup.sentence_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "text", "n_sentences", "n_removed")


def op11_hat_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, share=80, top=2000)


def op12_incidence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def op13_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
                             ["n_tokens", "ids_sha256", "decoded_sha256", "agrees"])


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.95),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM words),
grams AS (SELECT lang, w, s, unnest(range(1, least(4, len(w) - s + 1) + 1)) AS size FROM starts),
counts AS (
  SELECT lang, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase, CAST(size AS INTEGER) AS size, count(*) AS f
  FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
known AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30),
cuts AS (SELECT lang, phrase, w, size, f AS a, unnest(range(1, size)) AS k FROM known WHERE size >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
widths AS (SELECT lang, f, w, size, unnest(range(2, size)) AS width FROM known WHERE size >= 3),
spots AS (SELECT *, unnest(range(1, size - width + 2)) AS s FROM widths),
covers AS (SELECT lang, array_to_string(w[s:s + width - 1], ' ') AS phrase, max(f) AS longer FROM spots GROUP BY ALL),
kept AS (
  SELECT k.* FROM weakest k LEFT JOIN covers c ON c.lang = k.lang AND c.phrase = k.phrase
  WHERE c.longer IS NULL OR 100::HUGEINT * c.longer < 80::HUGEINT * k.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_positive_unlabelled_quality, op2_pivot_distance_search, op3_context_mixing_range_coder, op4_capped_water_filling,
        op5_simhash_bk_trees, op6_cross_polytope_near_duplicates, op7_counterfactual_toxicity, op8_patience_license_scan, op9_best_two_fit_packing,
        op10_sentence_spans, op11_hat_trie_collocations, op12_incidence_alignment, op13_piece_agenda)
}
ORACLE: dict[str, str] = {
    "op2_pivot_distance_search": OP2_SQL, "op6_cross_polytope_near_duplicates": OP6_SQL,
    "op11_hat_trie_collocations": OP11_SQL}
