"""Reports about entities."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import normalize
from veilspark.model import ENTITY_TYPES
from veilspark.operators.resolve import is_suspicious


def rank_of_type(kind: Column) -> Column:
    """Place of a type in the fixed order of types."""
    return F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), kind)


def counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("occurrences"))


def totals(entities: DataFrame) -> DataFrame:
    """Counts by type and, in the row without a type, of all."""
    return entities.rollup("entity_type").agg(F.count("*").alias("occurrences"))


def uniques(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type", normalize(F.col("original_text")).alias("normalized_value")).agg(F.count("*").alias("occurrences"))


def ordered_uniques(found: DataFrame) -> DataFrame:
    """By type in the fixed order, most frequent first, then by value."""
    return found.orderBy(rank_of_type(F.col("entity_type")), F.desc("occurrences"), "normalized_value")


def summary(entities: DataFrame) -> DataFrame:
    """Occurrences and distinct values of each of the nine types, zero where there are none."""
    types = entities.sparkSession.createDataFrame([(t,) for t in ENTITY_TYPES], "entity_type string")
    by_value = uniques(entities).groupBy("entity_type").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("unique_values"))
    return types.join(by_value, "entity_type", "left").select("entity_type", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("unique_values", F.lit(0)).alias("unique_values"))


def summary_json(entities: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """One row with the summary as JSON: input_file, text_blocks, total_detections, categories."""
    cats = summary(entities).agg(F.array_sort(F.collect_list(F.struct(rank_of_type(F.col("entity_type")).alias("r"), "entity_type", "occurrences", "unique_values"))).alias("c"), F.sum("occurrences").alias("total"))
    rows = cats.crossJoin(blocks.agg(F.count("*").alias("blocks")))  # one row each
    by_type = F.map_from_entries(F.transform("c", lambda x: F.struct(x["entity_type"], F.struct(x["occurrences"].alias("occurrences"), x["unique_values"].alias("unique_values")))))
    body = F.struct(F.lit(name).alias("input_file"), F.col("blocks").alias("text_blocks"), F.col("total").alias("total_detections"), by_type.alias("categories"))
    return rows.select(F.to_json(body).alias("summary"))


def result_json(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id and result, for each document with a block: JSON of filename, total_blocks, total_detections, entities in order."""
    fields = ("entity_type", "original_text", "block_index", "start", "end", "confidence", "source")
    listed = F.array_sort(F.collect_list(F.struct("block_index", "start", F.struct(*fields).alias("e"))))
    by_doc = entities.groupBy("doc_id").agg(F.transform(listed, lambda x: x["e"]).alias("entities"))
    rows = blocks.groupBy("doc_id").agg(F.count("*").alias("total_blocks")).join(by_doc, "doc_id", "left")
    found = F.coalesce("entities", F.array().cast(by_doc.schema["entities"].dataType))
    body = F.struct(F.col("doc_id").cast("string").alias("filename"), "total_blocks", F.size(found).alias("total_detections"), found.alias("entities"))
    return rows.select("doc_id", F.to_json(body).alias("result"))


def console(entities: DataFrame, blocks: DataFrame) -> str:
    """A short report for a terminal: blocks, detections, distinct values and counts by type (nine rows reach the driver)."""
    rows = [r for r in summary(entities).collect() if r["occurrences"]]
    lines = [f"Text blocks: {blocks.count():,}", f"Detections: {sum(r['occurrences'] for r in rows):,}", f"Distinct values: {sum(r['unique_values'] for r in rows):,}"]
    lines += [f"  {r['entity_type']:<18}{r['occurrences']:>12,}{r['unique_values']:>12,}" for r in sorted(rows, key=lambda r: r["entity_type"])]
    return "\n".join(lines) + "\n"


def audit_rows(entities: DataFrame) -> DataFrame:
    """The audit table: confidence with four decimals."""
    return entities.select("doc_id", "entity_type", "original_text", "block_index", "start", "end", F.format_string("%.4f", F.col("confidence")).alias("confidence"), "source")


def suspicious(entities: DataFrame) -> DataFrame:
    return audit_rows(entities.filter(is_suspicious(F.col("entity_type"), F.col("original_text"))))


def by_block_type(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Found entities counted by the type of their block."""
    return found.join(blocks.select("doc_id", "block_index", "block_type"), ["doc_id", "block_index"]).groupBy("block_type").agg(F.count("*").alias("occurrences"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for reports small enough for one task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
