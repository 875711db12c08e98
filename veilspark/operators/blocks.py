"""Blocks: the text units of a document, one row each. block_index counts non-blank blocks of a document from 0."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_documents(docs: DataFrame, by_line: bool = True) -> DataFrame:
    """Blocks of docs(doc_id, text): a paragraph for each non-blank line, or one for the whole text.

    Text is not stripped. Null and blank texts have no block. The index is given within the row, without a shuffle.
    """
    text = docs["text"].cast("string")
    lines = F.split(text, "\n") if by_line else F.array(text)
    kept = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("p"), s.alias("text"))), lambda x: x["text"].rlike(r"(?U)\S"))
    rows = docs.select(docs["doc_id"], F.posexplode(kept).alias("block_index", "b"))
    return rows.select(
        "doc_id", "block_index", F.lit("paragraph").alias("block_type"), F.concat(F.lit("body.p_"), F.col("b.p").cast("string")).alias("location"),
        F.col("b.text").alias("text"), F.lit(None).cast("string").alias("style_name"),
    )


def histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_type").agg(F.count("*").alias("blocks"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Stripped texts of body paragraphs, empty ones left out."""
    from veilspark.functions.text import strip

    return blocks.filter("block_type = 'paragraph'").select("doc_id", "block_index", strip(F.col("text")).alias("text")).filter("text <> ''")


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: blocks in order, joined by newlines."""
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))
