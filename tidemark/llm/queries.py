"""The training-data queries with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import best_fit

    return best_fit(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_output

    return token_output(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import lm_scores

    return lm_scores(_documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(_documents(spark, sf_dir).select("doc_id", "text")).selectExpr("doc_id", "_junk AS junk_score", "_weak AS weak_posterior", "_kept AS kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import compared

    return compared(_documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_best_fit_packing, op3_token_files, op4_source_mixing, op5_brown_lm, op6_quality_classifier, op7_html_extraction, op8_simhash_near_dedup, op9_toxicity, op10_merkle_fingerprints, op11_embedding_whitening, op12_benchmark_decontamination, op13_source_divergence)}

SQL = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op12_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
             b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
             i AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS a FROM b WHERE len(ws) > 0),
             w AS (SELECT DISTINCT item_id, ws[a:a + 9] AS win, len(ws[a:a + 9]) AS l FROM i),
             p AS (SELECT doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) AS a FROM d, (SELECT DISTINCT l FROM w) WHERE len(ws) >= l),
             m AS (SELECT doc_id, a, p.l, item_id FROM p JOIN w ON p.l = w.l AND p.ws[a:a + p.l - 1] = w.win),
             h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(a, a + l)) AS place FROM m) GROUP BY 1),
             t AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY 1)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
             o AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
             k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
             v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
             t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
             p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v) AS p
                   FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
             l AS (SELECT lang, sum(total) AS total FROM t GROUP BY 1),
             q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(l.total) + 5 * any_value(v.v)) AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
             s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                     LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
             r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
}
