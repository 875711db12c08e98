"""Overlap resolution, validation and the selection of types, as expressions on array<entity>."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions import text as X
from veilspark.model import ENTITIES, ENTITY_TYPES


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def priority(source: Column, table: dict[str, int] | None = None) -> Column:
    out = F.lit(0)
    for name, rank in (P.PRIORITY if table is None else table).items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def strength(e: Column, table: dict[str, int] | None = None) -> Column:
    """Confidence, then length, then priority of the source."""
    return F.struct(e["confidence"].alias("c"), (e["end"] - e["start"]).alias("l"), priority(e["source"], table).alias("p"))


def resolve(found: Column, table: dict[str, int] | None = None) -> Column:
    """Greedy by start, longer, surer, higher priority, order found. An entity is accepted if it is stronger than each
    accepted one that it overlaps, and those go. The result is in the order of starts."""

    def accept(acc: Column, e: Column) -> Column:
        wins = F.forall(acc, lambda y: ~overlaps(e, y) | (strength(e, table) > strength(y, table)))
        return F.when(wins, F.concat(F.filter(acc, lambda y: ~overlaps(e, y)), F.array(e))).otherwise(acc)

    def fold(all_: Column) -> Column:
        key = F.transform(
            all_,
            lambda e, i: F.struct(
                e["start"].alias("a"), (e["start"] - e["end"]).alias("b"), (-e["confidence"]).alias("c"), (-priority(e["source"], table)).alias("d"), i.alias("i"), e.alias("e")
            ),
        )
        ordered = F.transform(F.array_sort(key), lambda k: k["e"])
        accepted = F.aggregate(ordered, F.array().cast(ENTITIES), accept)
        return F.transform(F.array_sort(F.transform(accepted, lambda e, i: F.struct(e["start"].alias("a"), i.alias("i"), e.alias("e")))), lambda k: k["e"])

    return X.let(found, lambda all_: F.when(F.size(all_) <= 1, all_).otherwise(fold(all_)))


def is_valid(e: Column) -> Column:
    """Whether an entity passes the rules of its type; types without rules pass."""
    kind, source = e["entity_type"], e["source"]
    value = X.strip(e["original_text"])
    lower = F.lower(value)
    parts = F.size(F.filter(X.tokens(value), lambda w: w.rlike("[A-Za-z]")))
    label = (F.length(value) <= 6) & X.is_upper(F.replace(value, F.lit(" "), F.lit("")))
    person = ~lower.isin(*P.PERSON_BLACKLIST) & value.rlike("[A-Za-z]") & ((source == "context") | (parts >= 2)) & ~label
    words = F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0))
    compact = F.replace(F.replace(value, F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
    organization = (
        ~X.strip_chars(lower, " .,;:").isin(*P.ORG_BLACKLIST)
        & (F.size(words) >= 2)
        & ~F.forall(words, lambda w: F.lower(w).isin(*P.SUFFIX_WORDS))
        & ~((F.length(compact) <= 8) & X.is_upper(compact))
        & ((source != "spacy") | value.rlike(P.COMPANY_EVIDENCE))
    )
    number = X.digits(e["original_text"])
    local = F.when(number.startswith("91") & (F.length(number) == 12), F.length(number) - 2).otherwise(F.length(number))
    phone = (local >= 10) & ~((source == "presidio") & (e["confidence"] < 0.60))
    rules = F.when(kind == "PERSON", person).when(kind == "ORGANIZATION", organization).when(kind == "PHONE_NUMBER", phone).when(kind == "DATE_OF_BIRTH", value.rlike(P.DATE_ONLY))
    return (value != "") & rules.otherwise(True)


def finished(found: Column) -> Column:
    """Resolved, then validated, then of supported types: what is invalid or unsupported may first suppress others."""
    return F.filter(resolve(found), lambda e: is_valid(e) & e["entity_type"].isin(*ENTITY_TYPES))


def is_suspicious(kind: Column, text: Column) -> Column:
    """Entities that deserve a look: few words, or known doubtful phrases."""
    value = X.strip(text)
    lower, words = F.lower(value), F.size(X.tokens(value))
    return (
        F.when(kind == "ORGANIZATION", lower.isin(*P.SUSPICIOUS_ORGS) | (words <= 2))
        .when(kind == "ADDRESS", X.contains_any(lower, P.SUSPICIOUS_ADDRESSES) | (words < 6))
        .when(kind == "PERSON", words == 1)
        .otherwise(False)
    )
