"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversation_repair,
    embedding_dedup,
    license_scan,
    lm_scoring,
    mixing,
    ngram_join,
    packing,
    personal_data,
    phrases,
    quality_rules,
    suffix_dedup,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return found


_REACHED = """reach(a, b) AS (
    SELECT id, id FROM nodes UNION SELECT r.a, l.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON r.b = l.x)"""
_ORACLES = {
    "op12_phrase_mining": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase
          FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS len) WHERE len(w) >= len),
counts AS (SELECT lang, len, phrase, count(*) AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(a) AS n FROM counts WHERE len = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE a >= 100),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM frequent, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < len),
scored AS (
    SELECT c.lang, c.phrase, c.a, h.a AS l, t.a AS r, n, (1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a) AS score, k
    FROM cuts c JOIN frequent h ON c.lang = h.lang AND c.head = h.phrase JOIN frequent t ON c.lang = t.lang AND c.tail = t.phrase JOIN sizes s ON c.lang = s.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
    FROM frequent, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE m < len AND i + m - 1 <= len GROUP BY ALL),
free AS (SELECT l.* FROM lowest l LEFT JOIN inner_parts p ON l.lang = p.lang AND l.phrase = p.phrase WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM free QUALIFY rank <= 2000""",
    "op1_projection_forest": f"""
WITH RECURSIVE valid AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT p.vec_id AS x, q.vec_id AS y FROM valid p JOIN valid q ON p.vec_id < q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.95),
{_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE x = id OR y = id) AS n_links, min(b) AS component_id, id = min(b) AS kept
FROM nodes JOIN reach ON a = id GROUP BY id""",
    "op8_ngram_join": f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
nodes AS (SELECT doc_id AS id FROM documents),
links AS (
    SELECT p.doc_id AS x, q.doc_id AS y FROM tokens p JOIN tokens q ON p.g = q.g AND p.doc_id < q.doc_id
    GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
{_REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(b) AS component_id FROM sets JOIN reach ON a = doc_id GROUP BY ALL""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
