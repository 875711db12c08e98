"""A corpus pipeline of five stages over `documents`, each calling one operator of veilspark.llm.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; all but the last
return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import scratch
from veilspark.llm.queries import table, vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels come from the labels table."""
    from veilspark.llm.quality import accepted

    return accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id."""
    from veilspark.llm.exact import deduplicated

    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, similarity 0.8 or more."""
    from veilspark.llm.jaccard import representatives

    return representatives(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    from veilspark.llm.mixture import repeated

    return repeated(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents: doc_id, ids, and the text decoded from them."""
    from veilspark.llm.bpe import encoded

    return encoded(docs, vocabulary_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("source mixture", mix), ("BPE encoding", bpe)]

#: The first and the last stage are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.kept(docs, name.replace(" ", "-"))
    return docs
