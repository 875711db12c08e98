"""Detectors: Column of text to Column of array<entity>, in DataFrame expressions.

Null text has no entities.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions import text as X
from veilspark.functions.spans import spans, spans_where
from veilspark.model import ENTITIES

Detector = Callable[[Column], Column]


def none() -> Column:
    return F.array().cast(ENTITIES)


def entity(kind: str, value: Column, start: Column, end: Column, confidence: float, source: str) -> Column:
    return F.struct(
        F.lit(kind).alias("entity_type"), value.alias("original_text"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.lit(confidence).alias("confidence"), F.lit(source).alias("source"),
    )


def from_spans(found: Column, kind: str, confidence: float, source: str) -> Column:
    return F.transform(found, lambda s: entity(kind, s["value"], s["start"], s["end"], confidence, source))


# Patterns


def email(text: Column) -> Column:
    return from_spans(spans_where(text, F.contains(text, F.lit("@")), P.EMAIL), "EMAIL_ADDRESS", 1.0, "regex")


def phone(text: Column) -> Column:
    return from_spans(spans_where(text, text.rlike(r"(?U)\d{5}|\d[\s-]\d|\)[\s-]?\d"), P.PHONE), "PHONE_NUMBER", 1.0, "regex")


def ip_address(text: Column) -> Column:
    found = spans_where(text, text.rlike(r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d"), P.IPV4)
    return from_spans(F.filter(found, lambda s: X.is_ipv4(s["value"])), "IP_ADDRESS", 1.0, "regex")


def credit_card(text: Column) -> Column:
    found = spans_where(text, text.rlike(r"(?U)(?:\d[ -]?){13}"), P.CARD)
    return from_spans(F.filter(found, lambda s: X.is_luhn(X.digits(s["value"]))), "CREDIT_CARD", 1.0, "regex")


def ssn(text: Column) -> Column:
    return from_spans(spans_where(text, text.rlike(r"(?U)\d-\d{2}-\d{4}"), P.SSN), "SSN", 1.0, "regex")


def regex_detector(text: Column) -> Column:
    """All patterns, in their fixed order."""
    return F.concat(email(text), phone(text), ip_address(text), credit_card(text), ssn(text))


# Context rules


def person(text: Column) -> Column:
    """The first name after a colon in a block that mentions a role anywhere."""
    found = spans_where(text, X.contains_any(F.lower(text), P.ROLES) & F.contains(text, F.lit(":")), P.NAME_AFTER_COLON, True)
    return from_spans(F.slice(found, 1, 1), "PERSON", P.CONFIDENCE["person"], "context")


def company(text: Column) -> Column:
    """Capitalised words that end in a legal suffix."""
    hint = text.rlike("Limited|Ltd|LLP|Inc|Corp|Industries|Enterprises|Technologies|Solutions|Services|Holdings")
    found = spans_where(text, hint, P.COMPANY)
    trimmed = F.transform(found, lambda s: F.struct(s["start"], X.strip(s["value"]).alias("whole")))
    whole = F.filter(trimmed, lambda s: ~X.strip_chars(F.lower(s["whole"]), " .,;:").isin(*P.COMPANY_FRAGMENTS))
    short = F.transform(whole, lambda s: F.struct(s["start"], X.rstrip_chars(s["whole"], ".,;:").alias("value")))
    named = F.filter(short, lambda s: (X.word_count(s["value"], P.COMPANY_WORD) >= 2) & ~F.lower(s["value"]).isin(*P.COMPANY_PHRASES))
    return F.transform(named, lambda s: entity("ORGANIZATION", s["value"], s["start"], s["start"] + F.length(s["value"]), P.CONFIDENCE["company"], "context"))


def date_of_birth(text: Column) -> Column:
    """Dates directly after a label."""
    return from_spans(spans_where(text, text.rlike("(?i)birth|dob"), P.DOB, True), "DATE_OF_BIRTH", P.CONFIDENCE["dob"], "context")


def looks_like_address(value: Column) -> Column:
    return value.rlike(P.PIN) & X.contains_any(F.lower(value), P.ADDRESS_MARKERS)


def _cleaned(value: Column, start: Column) -> Column:
    """Struct (start, value): stripped and without a label before it; the start moves along, so the span is the value's."""

    def shortened(bare: Column) -> Column:
        left = F.length(F.regexp_extract(value, r"(?U)^\s*", 0))
        label = F.length(F.regexp_extract(bare, P.ADDRESS_PREFIX, 0))
        return F.struct((start + left + label).cast("int").alias("start"), F.substring(bare, label + 1, F.length(bare)).alias("value"))

    return X.let(X.strip(value), shortened)


def address(text: Column) -> Column:
    """Addresses around a PIN code: after a label, or from the last start marker of the 250 characters before it."""
    labelled = F.transform(spans(text, P.ADDRESS_LABELLED, True), lambda s: _cleaned(s["value"], s["start"]))
    labelled = F.filter(labelled, lambda s: looks_like_address(s["value"]))
    first = F.transform(labelled, lambda s: entity("ADDRESS", s["value"], s["start"], s["start"] + F.length(s["value"]), P.CONFIDENCE["address_label"], "context"))

    def around(pin: Column) -> Column:
        """The candidate of one PIN: an array of one entity or none."""
        begin = F.greatest(F.lit(0), pin["start"] - 250)

        def from_marker(w: Column) -> Column:
            before = F.substring(w["window"], F.lit(1), w["marker"]["start"])
            premise = F.length(before) - F.length(F.regexp_extract(before, P.ADDRESS_PREMISE, 0))
            lead = F.struct(before.alias("before"), premise.alias("premise"), X.strip(F.substring(before, F.lit(1), premise)).alias("lead"))
            extended = lambda x: (x["premise"] < F.length(x["before"])) & ((x["lead"] == "") | x["lead"].rlike(r"[.;:–\-]$"))
            start = begin + X.let(lead, lambda x: F.when(extended(x), x["premise"]).otherwise(w["marker"]["start"]))
            region = F.regexp_extract(F.substring(text, pin["end"] + 1, F.length(text)), P.ADDRESS_REGION, 1)
            reach = F.struct(start.alias("start"), (pin["end"] + F.length(region)).alias("end"))
            got = X.let(reach, lambda r: _cleaned(X.slice_text(text, r["start"], r["end"]), r["start"]))
            own = lambda g: entity("ADDRESS", g["value"], g["start"], g["start"] + F.length(g["value"]), P.CONFIDENCE["address_pin"], "context")
            return X.let(got, lambda g: F.when(looks_like_address(g["value"]), F.array(own(g))).otherwise(none()))

        window = X.let(X.slice_text(text, begin, pin["start"]), lambda w: F.struct(w.alias("window"), F.try_element_at(spans(w, P.ADDRESS_START), F.lit(-1)).alias("marker")))
        return X.let(window, lambda w: F.when(w["marker"].isNotNull(), from_marker(w)).otherwise(none()))

    def add(acc: Column, pin: Column) -> Column:
        covered = F.exists(acc, lambda e: (e["start"] <= pin["start"]) & (pin["start"] < e["end"]))
        return F.when(covered, acc).otherwise(F.concat(acc, around(pin)))

    found = F.aggregate(spans(text, P.PIN), first, add)
    return F.when(text.rlike(P.PIN), most_complete(found)).otherwise(none())


def most_complete(found: Column) -> Column:
    """By start, longer first; of an entity and the last one kept that overlap, the longer stays."""
    keyed = F.array_sort(F.transform(found, lambda e, i: F.struct(e["start"].alias("s"), (e["start"] - e["end"]).alias("l"), i.alias("i"), e.alias("e"))))

    def fold(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        clear = (F.size(acc) == 0) | (e["start"] >= last["end"])
        longer = (e["end"] - e["start"]) > (last["end"] - last["start"])
        return F.when(clear, F.concat(acc, F.array(e))).when(longer, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(e))).otherwise(acc)

    return F.aggregate(F.transform(keyed, lambda k: k["e"]), none(), fold)


def context_detector(text: Column) -> Column:
    """All rules, in their fixed order."""
    return F.concat(person(text), company(text), address(text), date_of_birth(text))


def hinted(text: Column) -> Column:
    """Whether any detector of the ensemble can find something: what its own hint asks for is a case of these."""
    marks = F.contains(text, F.lit("@")) | text.rlike(r"(?U)\d{3}|\d[\s.-]\d|\)[\s-]?\d") | text.rlike("(?i)birth|dob")
    words = text.rlike("Limited|Ltd|LLP|Inc|Corp|Industries|Enterprises|Technologies|Solutions|Services|Holdings")
    return F.coalesce(marks | words | (F.contains(text, F.lit(":")) & X.contains_any(F.lower(text), P.ROLES)), F.lit(False))


def ensemble(text: Column, before: Sequence[Detector] = (), between: Sequence[Detector] = ()) -> Column:
    """Candidates of all detectors: plug-ins `before`, patterns, plug-ins `between`, context rules.

    The order of detectors decides ties, as it does in resolution.
    """
    parts = [*(d(text) for d in before), regex_detector(text), *(d(text) for d in between), context_detector(text)]
    return F.when(text.isNotNull(), F.concat(*parts)).otherwise(none())
