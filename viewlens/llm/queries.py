"""The operators bound to the tables of a data folder, with production parameters.

``QUERIES`` maps names to ``(spark, folder) -> DataFrame``; ``ORACLE_SQL`` holds
the DuckDB statement of those that SQL can express.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.llm import (
    alignment,
    embedding_dedup,
    exact_dedup,
    filter_audit,
    html_extraction,
    lm_scoring,
    minhash_dedup,
    packing,
    quality,
    sentencepiece_codec,
    sharding,
    token_counts,
    token_files,
)
from viewlens.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    labels = quality.best_labels(table(spark, folder, "labels"))
    return lm_scoring.scores(table(spark, folder, "documents"), labels.where("good = 1").select("id"), PIECE_BPE)


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.with_copies(table(spark, folder, "documents"), carry=("doc_id",))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), PIECE_BPE)


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.main_text(table(spark, folder, "pages"))


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, folder, "documents"), threshold=85)


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"), similarity=0.9)


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, folder, "documents"), WORD_BPE))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, folder, "documents"), PIECE_BPE)


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"), 8)


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"), quality.best_labels(table(spark, folder, "labels")))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.write(table(spark, folder, "documents"), BYTE_BPE)
    return token_files.read(spark, path, with_ids=False)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"), flags).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley")


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.linked_counts(table(spark, folder, "documents"), BYTE_BPE, PIECE_BPE)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # it imports this module
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_exact_dedup, op3_token_counts, op4_html_extraction, op5_minhash_dedup,
    op6_embedding_dedup, op7_best_fit_packing, op8_sentencepiece, op9_sharding, op10_quality_classifier,
    op11_token_files, op12_filter_audit, op13_tokenizer_alignment, pipeline)}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                          AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM d WINDOW same AS (PARTITION BY text_sha256)""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                     max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                            100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                            regexp_matches(t, '[#$%&*|]'),
                            coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
                     coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
              FROM d LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
              WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, s.i AS step,
                     o[s.i] AS mine, o[1:s.i - 1] AS earlier FROM o, i s),
        r AS (SELECT part, filter_order, step, mine, n, good, toxic, fails[mine] AS hit,
                     len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone,
                     len(list_filter(fails, lambda x: x)) = 1 AS once FROM m, s),
        c AS (SELECT part, filter_order, step, mine,
                     sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN hit AND once THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN hit AND NOT gone THEN n * good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN hit AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost
              FROM r GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
        FROM c""",
}
