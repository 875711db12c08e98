"""From blocks to entities."""

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.detect import Detector, ensemble, hinted, none
from veilspark.operators.resolve import finished


@lru_cache(maxsize=2)
def standard(gateway: int) -> Column:
    """The expression over `text` without plug-ins; it is large, so it is built once for each JVM, and evaluated only for texts
    with a hint."""
    return F.when(hinted(F.col("text")), finished(ensemble(F.col("text")))).otherwise(none())


def with_entities(blocks: DataFrame, before: Sequence[Detector] = (), between: Sequence[Detector] = ()) -> DataFrame:
    """blocks with `entities`: array of resolved, valid entities of supported types. A projection: no shuffle."""
    own = finished(ensemble(F.col("text"), before, between)) if before or between else standard(id(SparkContext._gateway))
    return blocks.withColumn("entities", own)


def exploded(tagged: DataFrame) -> DataFrame:
    """One row for each entity of blocks with entities."""
    return tagged.filter(F.size("entities") > 0).select("doc_id", "block_index", F.explode("entities").alias("e")).select("doc_id", "block_index", "e.*")


def detect(blocks: DataFrame, before: Sequence[Detector] = (), between: Sequence[Detector] = ()) -> DataFrame:
    """doc_id, block_index, entity_type, original_text, start, end, confidence, source."""
    return exploded(with_entities(blocks, before, between))
