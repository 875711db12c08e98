"""Predictions against truth, by type, on distinct normalised values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import normalize
from veilspark.model import ENTITY_TYPES

#: Truth where none is given: invented values, (type, value).
SAMPLES = (
    ("PERSON", "Asha Example"), ("EMAIL_ADDRESS", "info@sample-corp.example"), ("PHONE_NUMBER", "+91 98765 43210"), ("ORGANIZATION", "Sample Corp Private Limited"),
    ("ADDRESS", "12 Sample Road, Pune - 411001, India"), ("DATE_OF_BIRTH", "1 May 1980"), ("SSN", "123-45-6789"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("IP_ADDRESS", "192.0.2.1"),
)


def truth_or_samples(predicted: DataFrame, truth: DataFrame | None, samples: tuple = SAMPLES) -> DataFrame:
    """truth, or, where it is none or empty, the samples."""
    given = truth is not None and not truth.isEmpty()
    return truth if given else predicted.sparkSession.createDataFrame(list(samples), "entity_type string, value string")


def value_sets(predicted: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (entity_type, value); predictions of types that the truth lacks are left out, and so are empty values."""
    want = truth.filter("value <> ''").select("entity_type", normalize(F.col("value")).alias("value")).distinct()
    have = predicted.filter("original_text <> ''").select("entity_type", normalize(F.col("original_text")).alias("value")).distinct()
    return have.join(F.broadcast(want.select("entity_type").distinct().filter(F.col("entity_type").isin(*ENTITY_TYPES))), "entity_type", "left_semi"), want


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp == 0, F.when(fn == 0, 1.0).otherwise(0.0)).otherwise(tp / (tp + fp))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fn == 0, F.when(fp == 0, 1.0).otherwise(0.0)).otherwise(tp / (tp + fn))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_type, tp, fp, fn, precision, recall, f1_score of each type of the truth."""
    have, want = value_sets(predicted, truth)
    both = have.withColumn("p", F.lit(1)).join(want.withColumn("t", F.lit(1)), ["entity_type", "value"], "full")
    n = both.groupBy("entity_type").agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    scored = n.withColumns({"precision": precision(*c), "recall": recall(*c)})
    return scored.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


def rounded(scores: DataFrame) -> DataFrame:
    return scores.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes))


def averages(scores: DataFrame) -> DataFrame:
    """Micro and macro averages: rows (average, precision, recall, f1_score)."""
    t = scores.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.avg(c).alias("m_" + c) for c in ("precision", "recall", "f1_score")))
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    micro = F.struct(F.lit("micro").alias("average"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1_score"))
    macro = F.struct(F.lit("macro").alias("average"), F.col("m_precision").alias("precision"), F.col("m_recall").alias("recall"), F.col("m_f1_score").alias("f1_score"))
    return t.select(F.explode(F.array(micro, macro)).alias("x")).select("x.*")


def differences(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Values in both, only predicted, only in the truth: (side, entity_type, value), by set operations."""
    have, want = value_sets(predicted, truth)
    tagged = lambda df, side: df.select(F.lit(side).alias("side"), "entity_type", "value")
    return tagged(have.intersect(want), "both").unionByName(tagged(have.subtract(want), "predicted")).unionByName(tagged(want.subtract(have), "truth"))


def report(scores: DataFrame, detections: int | None = None, blocks: int | None = None) -> str:
    """A markdown report: a summary, with the numbers of blocks and detections where they are given, and a table of the
    metrics (at most nine rows reach the driver) with the micro and macro averages."""
    rows = scores.orderBy("entity_type").limit(len(ENTITY_TYPES)).collect()
    mean = {r["average"]: r for r in averages(scores).collect()}
    lines = ["# Detection report", "", "## Summary", ""]
    lines += [f"- {name}: {n:,}" for name, n in (("Blocks", blocks), ("Detections", detections)) if n is not None]
    if rows:
        lines += [f"- {name}, {k} average: {mean[k][c]:.2%}" for k in ("micro", "macro") for name, c in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1_score"))]
    lines += ["", "## Metrics by type", "", "| Type | TP | FP | FN | Precision | Recall | F1 |", "|-|-|-|-|-|-|-|"]
    lines += [f"| {r.entity_type} | {r.tp} | {r.fp} | {r.fn} | {r.precision:.2%} | {r.recall:.2%} | {r.f1_score:.2%} |" for r in rows]
    if rows:
        lines += [f"| {k} average | | | | {m.precision:.2%} | {m.recall:.2%} | {m.f1_score:.2%} |" for k, m in sorted(mean.items())]
    return "\n".join(lines) + "\n"
