"""Queries of the subpackage, one for each operator, over whole tables with production parameters, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.bpe import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.jaccard import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.exact import groups

    return groups(table(spark, sf_dir, "documents"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.mixture import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.urlfilter import judged

    return judged(table(spark, sf_dir, "pages"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_language_id, op3_ngram_jaccard_join, op4_exact_dedup, op5_token_counts, op6_source_mixture, op7_url_filter, op8_bpe_codec,
        op9_toxicity, op10_embedding_near_dedup,
    )
}

#: DuckDB SQL over whole tables, where SQL expresses an operator.
ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
}
