"""Spans of regular-expression matches, in code points, without leaving the JVM.

Matches are put between sentinels and the text is split at them: gaps and matches alternate, and a match starts where the
segments before it end. The sentinel is a private-use character; texts are freed of it first by an equally long one.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL, SUBSTITUTE = "", ""


def spans(text: Column, pattern: str, value_group: bool = False) -> Column:
    """array<struct<start int, end int, value string>> of all matches, left to right, without overlap.

    value_group: the pattern is two groups (prefix)(value), and the spans are those of value.
    """
    safe = F.translate(text, SENTINEL, SUBSTITUTE)
    mark = f"$1{SENTINEL}$2{SENTINEL}" if value_group else f"{SENTINEL}$0{SENTINEL}"
    parts = F.split(F.regexp_replace(safe, pattern, mark), SENTINEL)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["s"])
        own = F.struct(acc["at"].alias("start"), end.alias("end"), x["s"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["i"] % 2 == 1, F.concat(acc["found"], F.array(own))).otherwise(acc["found"]).alias("found"))

    numbered = F.transform(parts, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.aggregate(numbered, first, step, lambda acc: acc["found"])


def spans_where(text: Column, hint: Column, pattern: str, value_group: bool = False) -> Column:
    """spans() where hint holds, else none: a cheap test saves the expensive one."""
    return F.when(hint, spans(text, pattern, value_group)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
