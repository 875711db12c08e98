"""Detectors, resolution and validation."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.functions.spans import spans
from veilspark.model import ENTITIES
from veilspark.operators import detect, plugins
from veilspark.operators.resolve import finished, is_suspicious, is_valid, resolve

CASES = [
    ("Contact someone@example.com", [("EMAIL_ADDRESS", "someone@example.com")]),
    ("😀 x@y.org.", [("EMAIL_ADDRESS", "x@y.org")]),
    ("Call +91 98765 43210", [("PHONE_NUMBER", "+91 98765 43210")]),
    ("+91 20 1234 5678", [("PHONE_NUMBER", "+91 20 1234 5678")]),
    ("022-12345678", [("PHONE_NUMBER", "022-12345678")]),
    ("The reference number is 12345.", []),
    ("Server IP: 192.168.1.100", [("IP_ADDRESS", "192.168.1.100")]),
    ("999.999.999.999", []),
    ("1.2.3.4.5", []),
    ("Card: 4111 1111 1111 1111", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("Card: 4111 1111 1111 1112", []),
    ("4111111111111111 5500005555555559", [("CREDIT_CARD", "4111111111111111"), ("CREDIT_CARD", "5500005555555559")]),
    ("SSN: 123-45-6789", [("SSN", "123-45-6789")]),
    ("Contact Person: Asha Example", [("PERSON", "Asha Example")]),
    ("Note: Asha Example", []),
    ("Sample Metal Works Private Limited", [("ORGANIZATION", "Sample Metal Works Private Limited")]),
    ("The company requires additional working capital.", []),
    ("N.A.", []),
    ("Pandit LLP", []),
    ("Date of Birth: 12 March 1985", [("DATE_OF_BIRTH", "12 March 1985")]),
    ("DOB: 12/03/1985", [("DATE_OF_BIRTH", "12/03/1985")]),
    ("Date of Incorporation: 12 March 1985", []),
    ("12 March 1985", []),
    ("1/3, 1/4 and 1/5 Village Samplewadi, Demo Taluka - Test, Pune – 410 501, Maharashtra, India", ["whole"]),
    ("It is at Plot No. X-1, MIDC Area, Testpur, Maharashtra – 414 301. The plant works.", [("ADDRESS", "Plot No. X-1, MIDC Area, Testpur, Maharashtra – 414 301")]),
    ("The unit in Pune is near the main road of the village.", []),
    ("₹ 100 million", []),
    (None, []),
    ("", []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    for r in df.select("i", "text", finished(detect.ensemble(F.col("text"))).alias("e")).collect():
        want = CASES[r.i][1]
        got = [(e.entity_type, e.original_text) for e in r.e]
        assert got == ([("ADDRESS", r.text)] if want == ["whole"] else want), r.text
        for e in r.e:  # a span is its text, in code points
            assert r.text[e.start : e.end] == e.original_text


def test_labelled_addresses(spark):
    df = spark.createDataFrame([("Registered Office at Alpha Tower, Road 5, Pune 410 501, India; Corporate Office at Beta House, Pune 411 045",)], "text string")
    found = df.select(finished(detect.ensemble(F.col("text"))).alias("e")).first().e
    assert [e.original_text for e in found] == ["Alpha Tower, Road 5, Pune 410 501, India", "Beta House, Pune 411 045"]
    assert {e.confidence for e in found} == {0.99}


def test_spans_match_python(spark):
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 é😀\n") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", spans(F.col("t"), "a+b?|1").alias("s")).collect():
        assert [(x.start, x.end, x.value) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?|1", texts[r.i])]


def entity(start, end, confidence, source, kind="PERSON"):
    return (kind, "x", start, end, float(confidence), source)


PRIORITY = {"regex": 3, "presidio": 2, "spacy": 1}


def greedy(found):
    """The rule, stated again over tuples."""
    strength = lambda e: (e[4], e[3] - e[2], PRIORITY.get(e[5], 0))
    out = []
    for e in sorted(found, key=lambda e: (e[2], e[2] - e[3], -e[4], -PRIORITY.get(e[5], 0))):
        hit = [y for y in out if e[2] < y[3] and y[2] < e[3]]
        if all(strength(e) > strength(y) for y in hit):
            out = [y for y in out if y not in hit] + [e]
    return sorted(out, key=lambda e: e[2])


def test_resolution(spark):
    rng = random.Random(7)
    fixed = [
        [],
        [entity(0, 30, 0.85, "spacy"), entity(5, 10, 1, "regex"), entity(12, 20, 0.85, "spacy")],
        [entity(0, 10, 0.9, "spacy"), entity(9, 15, 0.95, "context"), entity(11, 30, 1, "regex")],
        [entity(0, 5, 0.98, "presidio"), entity(0, 5, 1, "regex")],
        [entity(0, 5, 0.9, "presidio"), entity(0, 9, 0.9, "spacy")],
    ]
    cases = fixed + [[entity(a, a + rng.randint(1, 9), rng.choice([0.8, 0.9, 1]), rng.choice(["regex", "presidio", "spacy", "context"])) for a in [rng.randint(0, 20) for _ in range(rng.randint(0, 8))]] for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, es array<struct<entity_type:string,original_text:string,start:int,end:int,confidence:double,source:string>>")
    for r in df.select("i", resolve(F.col("es")).alias("out")).collect():
        assert [tuple(e) for e in r.out] == greedy(cases[r.i])


def test_unsupported_winner_suppresses(spark):
    es = [entity(0, 9, 1, "presidio", "LOCATION"), ("PERSON", "Asha Example", 0, 9, 0.85, "spacy")]
    df = spark.createDataFrame([(es,)], "es array<struct<entity_type:string,original_text:string,start:int,end:int,confidence:double,source:string>>")
    assert df.select(finished(F.col("es").cast(ENTITIES)).alias("e")).first().e == []


@pytest.mark.parametrize(
    ("kind", "value", "source", "confidence", "want"),
    [
        ("PERSON", "SCRR", "presidio", 0.9, False), ("PERSON", "Asha Example Rao", "spacy", 0.9, True), ("PERSON", "Asha", "presidio", 0.9, False), ("PERSON", "Asha", "context", 0.9, True),
        ("ORGANIZATION", "Working Capital", "context", 0.9, False), ("ORGANIZATION", "UPI", "context", 0.9, False), ("ORGANIZATION", "Private Limited", "context", 0.9, False),
        ("ORGANIZATION", "Sample Works", "spacy", 0.9, False), ("ORGANIZATION", "Sample Works Limited", "spacy", 0.9, True), ("ORGANIZATION", "A.B. C.D.", "context", 0.9, False),
        ("PHONE_NUMBER", "12345", "regex", 1.0, False), ("PHONE_NUMBER", "9876543210", "regex", 1.0, True), ("PHONE_NUMBER", "+91 98765 43210", "regex", 1.0, True), ("PHONE_NUMBER", "9876543210", "presidio", 0.4, False),
        ("DATE_OF_BIRTH", "June 30, 2025", "context", 0.9, True), ("DATE_OF_BIRTH", "1985", "context", 0.9, False), ("SSN", " ", "regex", 1.0, False), ("SSN", "x", "regex", 1.0, True),
    ],
)
def test_validation(spark, kind, value, source, confidence, want):
    e = F.struct(F.lit(kind).alias("entity_type"), F.lit(value).alias("original_text"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
    assert spark.range(1).select(is_valid(e).alias("v")).first().v is want


def test_suspicious(spark):
    rows = [("ORGANIZATION", "Pandit LLP", True), ("ORGANIZATION", "One Two Three Limited", False), ("ADDRESS", "1 Road, Pune", True), ("PERSON", "Asha", True), ("PERSON", "Asha E", False), ("SSN", "x", False)]
    df = spark.createDataFrame(rows, "k string, v string, want boolean")
    assert df.filter(is_suspicious(F.col("k"), F.col("v")) != F.col("want")).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("  A \n B ",), ("٣x4",), (None,)], "t string")
    got = df.select(X.normalize_or_empty(F.col("t")), X.digits(F.col("t")), X.is_upper(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a b", "", True), ("٣x4", "٣4", False), ("", None, None)]
    assert spark.range(1).select(X.is_luhn(F.lit("4111111111111111")), X.is_luhn(F.lit("0")), X.is_ipv4(F.lit("1.02.3.4"))).first()[:] == (True, False, False)


def test_plugin(spark):
    def load():
        return lambda texts: [[("PERSON", 0, 4, 0.85)] if t.startswith("Asha") else [] for t in texts]

    own = plugins.detector(load, "spacy")
    df = spark.createDataFrame([("Asha Example x@y.org",), (None,), ("none",)], "text string")
    got = df.select(resolve(detect.ensemble(F.col("text"), before=[own])).alias("e")).collect()
    assert [[(e.entity_type, e.original_text) for e in r.e] for r in got] == [[("PERSON", "Asha"), ("EMAIL_ADDRESS", "x@y.org")], [], []]
