"""The registered queries of this package: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_file

import corpus_pipeline
from llm import alignment, classifier, html, hyperplanes, minhash, mixing, pieces, pivots, quality, sharding, suffix, tokens, urls
from llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judged(docs, drop=("text",)).select("doc_id", "_quality.*")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.without_repeats(docs, drop=("text",)).select("doc_id", "_cut.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, str(tokenizer_file("word_bpe_49k.json")), drop=("text",))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), str(tokenizer_file("piece_bpe_32k.model")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op10_uniform_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    dealt = sharding.uniform_shards(rows, [F.col("doc_id"), F.col("text_hash")])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hyperplanes.hard_negatives(rows, F.col("vec_id") % 50 == 0)


#: Rules of the url filter: the longest that fits a url decides.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filtered(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.alignments(docs, str(tokenizer_file("byte_bpe_50k.json")), str(tokenizer_file("piece_bpe_32k.model")))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_token_counts": op3_token_counts,
    "op4_main_text": op4_main_text,
    "op5_embedding_groups": op5_embedding_groups,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_source_mix": op7_source_mix,
    "op8_quality_scores": op8_quality_scores,
    "op9_minhash_groups": op9_minhash_groups,
    "op10_uniform_shuffle": op10_uniform_shuffle,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}
#: The other results have no form in SQL that ends on whole tables; see tests/llm.
ORACLE: dict[str, str] = {
    "op11_hard_negatives": """
        WITH numbered AS (
            SELECT row_number() OVER () AS uid, vec_id, embedding,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ), parts AS (
            SELECT uid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM numbered
        ), usable AS (
            SELECT uid FROM parts GROUP BY uid HAVING count(x) = count(*) AND bool_and(isfinite(x))
        ), cells AS (
            SELECT uid, k, floor(256 * x::DOUBLE)::BIGINT AS c FROM parts SEMI JOIN usable USING (uid)
        ), rows_in AS (SELECT uid, vec_id, label FROM numbered SEMI JOIN usable USING (uid)),
        scores AS (
            SELECT a.uid AS anchor, b.uid AS other, sum(a.c * b.c)::BIGINT AS score
            FROM cells a JOIN cells b USING (k)
            WHERE a.uid <> b.uid AND a.uid IN (SELECT uid FROM rows_in WHERE vec_id % 50 = 0)
            GROUP BY ALL
        ), told AS (
            SELECT s.anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, b.label = a.label AS same, s.score
            FROM scores s JOIN rows_in a ON a.uid = s.anchor JOIN rows_in b ON b.uid = s.other
        ), positives AS (
            SELECT * FROM told WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, uid) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id NULLS LAST, n.uid) AS rank
            FROM positives p JOIN told n ON n.anchor = p.anchor AND NOT n.same
            WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        )
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
    """
}
