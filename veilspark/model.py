"""Schemas of the engine. Offsets count code points from 0 and are half-open."""

from pyspark.sql import types as T

ENTITY_TYPES = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "ORGANIZATION", "ADDRESS", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "IP_ADDRESS")

ENTITY = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
ENTITIES = T.ArrayType(ENTITY)

BLOCKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("block_index", T.IntegerType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("style_name", T.StringType()),
    ]
)
