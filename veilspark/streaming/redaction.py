"""Redaction of streams of documents.

Detection and masking are projections and run in any mode. Synthetic values must agree across batches: each batch joins the
mapping table kept so far and appends the values that are new to it, numbered after those that exist.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.patterns import DEFAULT_SEED
from veilspark.functions.text import normalize
from veilspark.operators.blocks import from_documents
from veilspark.operators.entities import exploded, with_entities
from veilspark.operators.mapping import numbered, replacement
from veilspark.operators.redact import masked, redacted


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def masked_stream(docs: DataFrame) -> DataFrame:
    """Blocks of a stream of documents with entities masked; stateless."""
    return masked(with_entities(from_documents(docs)))


def entity_counts_stream(docs: DataFrame) -> DataFrame:
    """Running counts by type, for output mode complete or update."""
    return exploded(with_entities(from_documents(docs))).groupBy("entity_type").agg(F.count("*").alias("occurrences"))


class Mapping:
    """The mapping of a stream: a folder of Parquet files, one for each batch that brought new values."""

    SCHEMA = "entity_type string, norm_value string, replacement string, number long, batch long"

    def __init__(self, spark: SparkSession, path: str, seed: int = DEFAULT_SEED):
        self.spark, self.path, self.seed = spark, path.rstrip("/"), seed
        # An empty file so that the folder can be read before the first batch.
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(f"{self.path}/batch=-1")

    def before(self, batch: int) -> DataFrame:
        """What earlier batches have written; the result of a batch that is tried again does not change."""
        return self.spark.read.schema("entity_type string, norm_value string, replacement string, number long, batch long").parquet(self.path).filter(F.col("batch") < batch)

    def extended(self, entities: DataFrame, batch: int) -> DataFrame:
        """Writes the batch's new values, then returns the mapping including them."""
        old = self.before(batch)
        values = entities.select("entity_type", normalize(F.col("original_text")).alias("norm_value")).distinct()
        new = values.join(old, ["entity_type", "norm_value"], "left_anti")
        used = old.groupBy("entity_type").agg((F.max("number") + 1).alias("used"))
        placed = numbered(new).join(used, "entity_type", "left").withColumn("number", F.col("number") + F.coalesce("used", F.lit(0)))
        own = placed.select("entity_type", "norm_value", replacement(F.col("entity_type"), F.col("number"), self.seed).alias("replacement"), "number")
        own.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self.before(batch + 1).select("entity_type", "norm_value", "replacement")


def redact_stream(docs: DataFrame, mapping: Mapping, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes redacted blocks to `out`, a folder for each batch, so a repeated batch replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        tagged = with_entities(from_documents(rows)).persist()
        redacted(tagged, mapping.extended(exploded(tagged), number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        tagged.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"redact-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()
