"""One query for each operator over its whole table, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, license, negatives, ngram_join, pii, quality, sharding, simple8b, spm, suffix_dedup, templates, variants
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on a machine that has the package, as executors must have it too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), last=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select("doc_id", "bytes", "depth", "prefix", "part", "shard", "shard_bytes")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), key="corpus")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), is_anchor=lambda vec_id: vec_id % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_simple8b_tokens, op2_exact_dedup, op3_license_scan, op4_extendible_sharding, op5_decontamination, op6_suffix_dedup, op7_pii_surrogates, op8_ngram_jaccard, op9_quality, op10_sentencepiece, op11_hard_negatives, op12_spelling_variants, op13_html_extraction)}

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOW}) AS text_sha256, {LOW} AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY low)""",
    "op3_license_scan": license.oracle(),
    "op4_extendible_sharding": sharding.oracle(),
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        o AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 400)) AS o FROM d),
        b AS (SELECT doc_id, o, substr(h, 2 * o + 1, 998) AS h FROM o),
        p AS (SELECT doc_id, o, h, unnest(range(0, least(400, len(h) // 2 - 99))) AS j FROM b),
        w AS (SELECT doc_id, o + j AS i FROM p QUALIFY row_number() OVER (PARTITION BY md5(substr(h, 2 * j + 1, 200)) ORDER BY doc_id, o + j) > 1),
        n AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM w),
        s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n),
        r AS (SELECT doc_id, span, min(i) AS b, max(i) + 100 AS e FROM s GROUP BY ALL),
        k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS last FROM r),
        t AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(e - b) AS BIGINT) AS n_removed, max(e) AS done, string_agg(substr(h, 2 * last + 1, 2 * (b - last)), '' ORDER BY b) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9\x{0080}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
          SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ')) END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
        r(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
        c AS (SELECT a AS doc_id, min(c) AS class_id FROM r GROUP BY 1),
        l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n_links, 0) AS n_links
        FROM c LEFT JOIN l USING (doc_id)""",
    "op11_hard_negatives": """
        WITH e AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3""",
    "op12_spelling_variants": variants.oracle(),
}
