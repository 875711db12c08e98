"""Policies that end a run: leaks and changes of structure raise."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LeakFound(RuntimeError):
    """Values of entities are still in redacted text. counts: how many by type."""

    def __init__(self, counts: dict[str, int], first: list[str]):
        super().__init__(f"{sum(counts.values())} values are still present, {counts}; first: {first}")
        self.counts = counts


class StructureChanged(RuntimeError):
    """Documents whose tables or paragraphs differ in number after redaction."""


def require_no_leaks(leaks: DataFrame, shown: int = 20) -> None:
    """Raises LeakFound if leaks(doc_id, block_index, start, entity_type, original_text) has rows.

    The driver gets one count for each type and at most `shown` rows, the first by document and place.
    """
    counts = {r["entity_type"]: r["n"] for r in leaks.groupBy("entity_type").agg(F.count("*").alias("n")).collect()}
    if counts:
        first = leaks.orderBy("doc_id", "block_index", "start").limit(shown).collect()
        raise LeakFound(dict(sorted(counts.items())), [f"[{r['entity_type']}] {r['original_text']!r}" for r in first])


def changed_structure(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents of before and after(doc_id, tables, body_paragraphs) whose counts differ or that are in one of them only."""
    named = lambda df, prefix: df.select("doc_id", F.struct("tables", "body_paragraphs").alias(prefix))
    both = named(before, "before").join(named(after, "after"), "doc_id", "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def require_same_structure(before: DataFrame, after: DataFrame, shown: int = 20) -> None:
    """Raises StructureChanged with at most `shown` documents if any differs."""
    rows = changed_structure(before, after).orderBy("doc_id").limit(shown).collect()
    if rows:
        raise StructureChanged("; ".join(f"{r['doc_id']}: {r['before']} -> {r['after']}" for r in rows))
