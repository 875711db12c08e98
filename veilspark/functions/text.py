"""Scalar functions, Column to Column, all inside the JVM."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize(x: Column) -> Column:
    """Stripped, in lower case, each run of white space as one space."""
    return F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", " ")


def normalize_or_empty(x: Column) -> Column:
    return F.coalesce(normalize(x), F.lit(""))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def is_luhn(number: Column) -> Column:
    """A string of 13 to 19 digits with a right Luhn sum."""
    return number.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", number)


def is_ipv4(x: Column) -> Column:
    return x.rlike(P.IPV4_VALID)


def is_upper(x: Column) -> Column:
    """Has a cased letter, and none in lower case."""
    return (F.upper(x) == x) & (F.lower(x) != x)


def word_count(x: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))


def tokens(x: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def contains_any(x: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(x, F.lit(p))
    return out


def strip_chars(x: Column, chars: str) -> Column:
    return F.btrim(x, F.lit(chars))


def rstrip_chars(x: Column, chars: str) -> Column:
    return F.call_function("rtrim", F.lit(chars), x)


def slice_text(x: Column, start: Column, end: Column) -> Column:
    """Code points from start up to end, both from 0."""
    return F.substring(x, start + 1, end - start)


def display(x: Column, size: int = 200) -> Column:
    return F.substring(x, 1, size)
