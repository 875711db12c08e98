"""Redaction of blocks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import SENTINEL, SUBSTITUTE
from veilspark.functions.text import digits, let, normalize, slice_text, strip
from veilspark.operators.entities import exploded
from veilspark.operators.mapping import with_replacements

#: What may stand between the words, and the digits, of a value that is found again.
BETWEEN_WORDS, BETWEEN_DIGITS = r"[\s \-–—/.,()]+", r"[\s ()\-+.]*"


def spliced(text: Column, edits: Column) -> Column:
    """text with array<struct<start, end, replacement>> applied; the spans do not overlap."""
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"], e["end"], e["replacement"])))
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(F.concat(acc["out"], slice_text(text, acc["at"], e["start"]), e["replacement"]).alias("out"), e["end"].alias("at"))

    return F.aggregate(ordered, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def masked(tagged: DataFrame) -> DataFrame:
    """Blocks with entities, with each entity's text replaced by its type in brackets: a projection, no join."""
    marks = F.transform("entities", lambda e: F.struct(e["start"], e["end"], F.concat(F.lit("["), e["entity_type"], F.lit("]")).alias("replacement")))
    return tagged.withColumn("text", F.when(F.size("entities") > 0, spliced(F.col("text"), marks)).otherwise(F.col("text"))).drop("entities")


def redacted(tagged: DataFrame, mapping: DataFrame) -> DataFrame:
    """Blocks with entities, with each entity's text replaced by its synthetic value; all columns stay.

    Only blocks that have entities take part in the join; the others pass. A block travels with its entities and is put
    together again by a number of its own, so repeated or null ids mix nothing up.
    """
    columns = [c for c in tagged.columns if c != "entities"]
    own = tagged.filter(F.size("entities") > 0).select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("block"), "entities")
    own = own.select("row", "block", F.explode("entities").alias("e"))
    edits = with_replacements(own.select("row", "block", "e.entity_type", "e.original_text", "e.start", "e.end"), mapping)
    rest = edits.groupBy("row").agg(F.first("block").alias("block"), F.collect_list(F.struct("start", "end", "replacement")).alias("edits")).select("block.*", "edits")
    clear = tagged.filter(F.coalesce(F.size("entities"), F.lit(0)) <= 0).drop("entities")
    return clear.unionByName(rest.withColumn("text", spliced(F.col("text"), F.col("edits"))).drop("edits"))


def quoted(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def any_form(target: Column) -> Column:
    """A pattern for a value as it stands, with other white space, dashes or marks between its words, or, for ten digits or
    more, with separators between its digits."""
    words = F.filter(F.split(strip(target), r"(?U)[\s \-_–—/]+"), lambda w: w != "")
    number = digits(target)
    by_word = F.when(F.size(words) > 0, F.concat(F.lit("|"), F.array_join(F.transform(words, quoted), BETWEEN_WORDS))).otherwise("")
    by_digit = F.when(F.length(number) >= 10, F.concat(F.lit("|"), F.array_join(F.split(number, ""), BETWEEN_DIGITS))).otherwise("")
    return F.concat(F.lit("(?:"), quoted(target), by_word, by_digit, F.lit(")"))


def find(text: Column, target: Column) -> Column:
    """Struct (start, end) of the first place of target in text, or null: exact, else whatever the case, else with other
    separators between words, else, for ten digits or more, between digits."""

    def at(where: Column, size: Column) -> Column:
        return F.when(where > 0, F.struct((where - 1).alias("start"), (where - 1 + size).alias("end")))

    def by(pattern: Column) -> Column:
        parts = F.split(F.regexp_replace(F.translate(text, SENTINEL, SUBSTITUTE), pattern, F.lit(f"{SENTINEL}$0{SENTINEL}")), SENTINEL)
        return let(parts, lambda p: F.when(F.size(p) > 1, F.struct(F.length(p[0]).alias("start"), (F.length(p[0]) + F.length(p[1])).alias("end"))))

    words = F.filter(F.split(strip(target), r"(?U)[\s \-_–—/]+"), lambda w: w != "")
    flexible = F.concat(F.lit("(?iUd)"), F.array_join(F.transform(words, quoted), BETWEEN_WORDS))
    number = digits(target)
    phone = F.concat(F.lit("(?Ud)"), F.array_join(F.split(number, ""), BETWEEN_DIGITS))
    found = F.coalesce(
        at(F.call_function("instr", text, target), F.length(target)),
        at(F.call_function("instr", F.lower(text), F.lower(target)), F.length(target)),
        F.when(F.size(words) > 0, by(flexible)),
        F.when(F.length(number) >= 10, by(phone)),
    )
    return F.when((text != "") & (target != ""), found)


def global_pass(blocks: DataFrame, replaced: DataFrame, least: int = 3) -> DataFrame:
    """Blocks with every further occurrence of a document's own values replaced, longest first, in one pass.

    replaced(doc_id, original_text, replacement): what was found and what stands for it. A value is found whatever its case,
    with other separators between its words, and, with ten digits or more, between its digits. Values of fewer than `least`
    characters are left. Text that a replacement put in is not searched again.
    """
    values = replaced.filter(F.length(strip(F.col("original_text"))) >= least).groupBy("doc_id", "original_text").agg(F.max("replacement").alias("replacement"))
    entry = F.struct((-F.length("original_text")).alias("size"), F.col("original_text").alias("value"), F.col("replacement").alias("to"), any_form(F.col("original_text")).alias("form"))
    known = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("known"))
    pattern = F.concat(F.lit("(?iUd)(?:"), F.array_join(F.transform("known", lambda k: k["form"]), "|"), F.lit(")"))
    marked = F.regexp_replace(F.translate("text", SENTINEL, SUBSTITUTE), F.col("pattern"), F.lit(f"{SENTINEL}$0{SENTINEL}"))

    def put(s: Column, i: Column) -> Column:
        own = F.filter("known", lambda k: F.regexp_like(s, F.concat(F.lit("(?iUd)^"), k["form"], F.lit("$"))))
        return F.when(i % 2 == 1, F.coalesce(F.get(F.transform(own, lambda k: k["to"]), F.lit(0)), s)).otherwise(s)

    rows = blocks.join(known.withColumn("pattern", pattern), "doc_id", "left")
    return rows.withColumn("text", F.when(F.col("known").isNotNull(), F.array_join(F.transform(F.split(marked, SENTINEL), put), "")).otherwise(F.col("text"))).drop("known", "pattern")


def leaked(entities: DataFrame, redacted_blocks: DataFrame, guard: bool = True) -> DataFrame:
    """Entities whose value is still in their document after redaction.

    Phones are compared by digits over the whole document; with guard, numbers of fewer than ten digits never count, and
    without it an empty digit string counts as found. Other values are compared in normal form over the whole document.
    Each document's text is normalised once; the join is by doc_id.
    """
    from veilspark.operators.blocks import full_text

    texts = full_text(redacted_blocks).select("doc_id", normalize(F.col("text")).alias("plain"), digits(F.col("text")).alias("numbers"))
    number = digits(F.col("original_text"))
    phone = F.contains(F.col("numbers"), number) & (F.lit(not guard) | (F.length(number) >= 10))
    here = F.when(F.col("entity_type") == "PHONE_NUMBER", phone).otherwise(F.contains(F.col("plain"), normalize(F.col("original_text"))))
    return entities.join(texts, "doc_id").filter(here).drop("plain", "numbers")
