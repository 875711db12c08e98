"""Mapping, redaction, leaks, evaluation."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veilspark.operators import audit, evaluate, mapping, policy, redact
from veilspark.operators.blocks import from_documents, full_text
from veilspark.operators.detect import ensemble
from veilspark.operators.entities import detect, exploded, with_entities
from veilspark.operators.resolve import finished
from veilspark.plans import catalog

DOCS = [
    (1, "Mail a@x.org and A@X.org now.\n\nServer 10.1.2.3\nCards 4111 1111 1111 1111, 5500 0055 5555 5559"),
    (2, "Contact Person: Asha Example, +91 98765 43210\nSample Metal Works Private Limited"),
    (3, "nothing"),
    (4, None),
    (5, ""),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_blocks(spark):
    rows = [tuple(r) for r in from_documents(docs(spark)).filter("doc_id = 1").select("block_index", "location").orderBy("block_index").collect()]
    assert rows == [(0, "body.p_0"), (1, "body.p_2"), (2, "body.p_3")]
    assert {r.doc_id: r.text for r in full_text(from_documents(docs(spark))).collect()}[1] == DOCS[0][1].replace("\n\n", "\n")


def test_mapping_is_consistent_and_unique(spark):
    found = detect(from_documents(docs(spark)))
    m = mapping.build(found)
    rows = m.collect()
    assert len({(r.entity_type, r.norm_value) for r in rows}) == len(rows) == len({r.replacement for r in rows})
    assert {r.entity_type for r in rows} == {"EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "PERSON", "PHONE_NUMBER", "ORGANIZATION"}
    by = {r.entity_type: r.replacement for r in rows}
    assert by["EMAIL_ADDRESS"].endswith("@example.com") and by["IP_ADDRESS"].startswith("192.0.2.") and by["PHONE_NUMBER"].startswith("+91 ") and len(by["PHONE_NUMBER"].replace(" ", "")) == 13
    assert sum(r.entity_type == "CREDIT_CARD" for r in rows) == 2
    again = {(r.entity_type, r.norm_value): r.replacement for r in mapping.build(found.repartition(7)).collect()}
    assert again == {(r.entity_type, r.norm_value): r.replacement for r in rows}


def test_generators_are_unique_beyond_capacity(spark):
    n = spark.range(5000).withColumnRenamed("id", "number")
    for kind in mapping.CAPACITY:
        got = n.select(mapping.synthetic(kind, F.col("number")).alias("v"))
        assert got.distinct().count() == 5000, kind
        assert got.filter("v is null").count() == 0, kind
    cards = n.select(F.regexp_replace(mapping.synthetic("CREDIT_CARD", F.col("number")), " ", "").alias("v"))
    assert cards.filter(~F.call_function("luhn_check", F.col("v"))).count() == 0


def test_replacement_that_is_an_original_moves(spark):
    found = spark.createDataFrame([(1, 0, "IP_ADDRESS", "10.0.0.1", 0, 8, 1.0, "regex")], "doc_id long, block_index int, entity_type string, original_text string, start int, end int, confidence double, source string")
    first = mapping.build(found).first().replacement
    both = found.unionByName(found.withColumn("original_text", F.lit(first)))
    own = {r.norm_value for r in mapping.build(both).collect()}
    assert not own & {r.replacement for r in mapping.build(both).collect()}


def test_no_replacement_is_an_original_however_many_are_taken(spark):
    schema = "doc_id long, block_index int, entity_type string, original_text string, start int, end int, confidence double, source string"
    n = spark.range(400).withColumnRenamed("id", "number")
    own = [r.v for k in ("IP_ADDRESS", "EMAIL_ADDRESS") for r in n.select(mapping.synthetic(k, F.col("number")).alias("v")).collect()]
    rows = [(1, 0, "IP_ADDRESS" if v[0].isdigit() else "EMAIL_ADDRESS", v, 0, 1, 1.0, "regex") for i, v in enumerate(own) if i % 400 in (0, 1, 2, 3, 4, 6, 8, 12, 16, 300)]
    got = mapping.build(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) == len({r.replacement for r in got})
    assert not {r.norm_value for r in got} & {r.replacement.lower() for r in got}


def test_repeated_and_null_ids_are_redacted_row_by_row(spark):
    texts = ["ip 192.168.7.9 here", "mail a@x.org and b@x.org", "ip 192.168.7.9 here", "nothing"]
    rows = [(1, t) for t in texts] + [(None, t) for t in texts]
    tagged = with_entities(from_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    m = mapping.build(exploded(tagged))
    values = {r.norm_value: r.replacement for r in m.collect()}
    want = []
    for d, t in rows:
        for v, r in values.items():
            t = t.replace(v, r)
        want.append((d or 0, t))
    assert sorted((r.doc_id or 0, r.text) for r in redact.redacted(tagged, m).collect()) == sorted(want)


def test_hints_cover_every_detector(spark):
    cases = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] if os.path.isdir("/root/testdata/sf0.001") else []
    cases += [t for _, t in DOCS] + ["Call 022-12345678", "SSN: 123-45-6789", "DOB: 12/03/1985", "1 2 3 4 5 6 7 8 9", "Registered Office at Plot No. 4, Baner Road, Pune 411 045, India", "(022)12345678"]
    df = from_documents(spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string"))
    plain = df.withColumn("entities", finished(ensemble(F.col("text"))))
    key = lambda x: sorted(map(str, x.select("doc_id", "block_index", "entities").collect()))
    assert key(plain) == key(with_entities(df))


def test_redaction_leaves_no_value(spark):
    tagged = with_entities(from_documents(docs(spark)))
    found = exploded(tagged)
    out = redact.redacted(tagged, mapping.build(found))
    assert out.count() == tagged.count()
    assert redact.leaked(found, out).count() == 0
    assert redact.leaked(found, tagged).count() == found.count()
    text = {(r.doc_id, r.block_index): r.text for r in out.collect()}
    first = text[1, 0].split(" ")
    assert first[0] == "Mail" and first[1] == first[3] and first[-1] == "now."  # the same value twice, each in its place
    masked = {(r.doc_id, r.block_index): r.text for r in redact.masked(tagged).collect()}
    assert masked[1, 0] == "Mail [EMAIL_ADDRESS] and [EMAIL_ADDRESS] now."
    assert masked[2, 1] == "[ORGANIZATION]"


def test_find_and_global_pass(spark):
    cases = [("for Asha  Example here", (4, 17)), ("by ASHA EXAMPLE.", (3, 15)), ("x Asha-Example", (2, 14)), ("none", None), ("", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in df.select("i", redact.find(F.col("t"), F.lit("Asha Example")).alias("f")).collect():
        assert (tuple(r.f) if r.f else None) == cases[r.i][1]
    phone = spark.createDataFrame([("call 98765-43210!",)], "t string").select(redact.find(F.col("t"), F.lit("9876543210")).alias("f")).first().f
    assert tuple(phone) == (5, 16)
    blocks = spark.createDataFrame([(1, 0, "ASHA and asha e and (x)"), (2, 0, "Asha")], "doc_id long, block_index int, text string")
    known = spark.createDataFrame([(1, "Asha", "Q"), (1, "Asha E", "Asha Z"), (1, "an", "!!"), (1, "(x)", "y")], "doc_id long, original_text string, replacement string")
    got = {r.doc_id: r.text for r in redact.global_pass(blocks, known).collect()}
    assert got == {1: "Q and Asha Z and y", 2: "Asha"}


def test_global_pass_forms(spark):
    """Other separators between words and digits; a value of separators alone matches only itself."""
    text = "ASHA -\u00a0example, 98765-43210, (98) 7654.3210, a_b, a b, ---, x"
    blocks = spark.createDataFrame([(1, 0, text), (None, 0, text), (2, 0, None), (3, 0, "")], "doc_id long, block_index int, text string")
    known = spark.createDataFrame([(d, a, b) for d in (1, 2, 3) for a, b in (("Asha Example", "X"), ("9876543210", "P"), ("a_b", "U"), ("---", "M$1"))], "doc_id long, original_text string, replacement string")
    got = {r.doc_id: r.text for r in redact.global_pass(blocks, known).collect()}
    assert got == {1: "X, P, (P, U, U, M$1, x", None: text, 2: None, 3: ""}


def test_policies(spark):
    leaks = spark.createDataFrame([(1, 0, 5, "SSN", "a"), (1, 0, 2, "PERSON", "b"), (2, 0, 0, "SSN", "c")], "doc_id long, block_index int, start int, entity_type string, original_text string")
    with pytest.raises(policy.LeakFound, match="3 values .*first: .*PERSON. 'b'") as e:
        policy.require_no_leaks(leaks, 1)
    assert e.value.counts == {"PERSON": 1, "SSN": 2}
    policy.require_no_leaks(leaks.limit(0))
    shape = lambda rows: spark.createDataFrame(rows, "doc_id string, tables int, body_paragraphs int")
    policy.require_same_structure(shape([("a", 1, 2)]), shape([("a", 1, 2)]))
    for other in ([("a", 1, 3)], [("a", 0, 2)], [("a", 1, 2), ("b", 0, 0)], []):
        with pytest.raises(policy.StructureChanged):
            policy.require_same_structure(shape([("a", 1, 2)]), shape(other))


def test_reports(spark):
    blocks = from_documents(docs(spark))
    found = detect(blocks)
    rows = {r.doc_id: json.loads(r.result) for r in audit.result_json(found, blocks).collect()}
    assert set(rows) == {r.doc_id for r in blocks.select("doc_id").distinct().collect()}
    for r in rows.values():
        assert r["total_detections"] == len(r["entities"]) and r["entities"] == sorted(r["entities"], key=lambda e: (e["block_index"], e["start"]))
    assert sum(r["total_detections"] for r in rows.values()) == found.count()
    text = audit.console(found, blocks)
    assert f"Detections: {found.count()}" in text and "EMAIL_ADDRESS" in text and "SSN" not in text


def test_leak_guard(spark):
    blocks = spark.createDataFrame([(1, 0, "12345 only"), (1, 1, "Asha"), (1, 2, "Example")], "doc_id long, block_index int, text string")
    found = spark.createDataFrame([(1, "PHONE_NUMBER", "12345"), (1, "PERSON", "asha  example")], "doc_id long, entity_type string, original_text string")
    assert [r.entity_type for r in redact.leaked(found, blocks).collect()] == ["PERSON"]  # a value may span blocks
    assert redact.leaked(found, blocks, guard=False).count() == 2


def test_metrics(spark):
    p = lambda rows: spark.createDataFrame(rows, "entity_type string, original_text string")
    t = lambda rows: spark.createDataFrame(rows, "entity_type string, value string")
    m = evaluate.metrics(p([("PERSON", "A b"), ("PERSON", "a  B"), ("PERSON", "c"), ("PERSON", "d"), ("SSN", "x")]), t([("PERSON", "a b"), ("PERSON", "c"), ("PERSON", "e"), ("ADDRESS", "q")]))
    got = {r.entity_type: (r.tp, r.fp, r.fn) for r in m.collect()}
    assert got == {"PERSON": (2, 1, 1), "ADDRESS": (0, 0, 1)}
    means = {r.average: r for r in evaluate.averages(m).collect()}
    assert abs(means["micro"].precision - 2 / 3) < 1e-9 and abs(means["micro"].recall - 0.5) < 1e-9 and abs(means["macro"].recall - 1 / 3) < 1e-9
    one = spark.range(1).select(evaluate.precision(F.lit(0), F.lit(0), F.lit(0)), evaluate.recall(F.lit(0), F.lit(0), F.lit(0)), evaluate.f1(F.lit(1.0), F.lit(1.0))).first()
    assert tuple(one) == (1.0, 1.0, 1.0)
    text = evaluate.report(m, 5, 1234)
    assert "| PERSON | 2 | 1 | 1 |" in text and "- Blocks: 1,234" in text and "- Precision, micro average: 66.67%" in text
    none = evaluate.metrics(p([("SSN", "123-45-6789")]), evaluate.truth_or_samples(p([("SSN", "x")]), t([])))
    assert {r.entity_type: (r.tp, r.fn) for r in none.collect()}["SSN"] == (1, 0)
    assert evaluate.truth_or_samples(p([("SSN", "x")]), t([("SSN", "y")])).first().value == "y"
    assert "## Metrics by type" in evaluate.report(evaluate.metrics(p([]), t([])))


def test_audit(spark, tmp_path):
    blocks = from_documents(docs(spark))
    found = detect(blocks)
    assert {r.entity_type: r.occurrences for r in audit.summary(found).collect()}["SSN"] == 0
    assert audit.totals(found).filter("entity_type is null").first().occurrences == found.count()
    audit.write_csv(audit.audit_rows(found), str(tmp_path / "audit"))
    assert spark.read.option("header", True).csv(str(tmp_path / "audit")).count() == found.count()
    order = [r.entity_type for r in audit.ordered_uniques(audit.uniques(found)).collect()]
    assert order[0] == "PERSON" and order[-1] == "IP_ADDRESS"


def test_exports(spark):
    found = detect(from_documents(docs(spark)))
    m = mapping.build(found)
    assert mapping.typed_export(m).filter("entity_type = 'CREDIT_CARD'").selectExpr("size(values) n").first().n == 2
    raw = mapping.raw_export(mapping.with_replacements(found, m))
    assert raw.count() == found.select("original_text").distinct().count()
    assert mapping.search(m, None, "A@X").count() == 1 and mapping.search(m, "SSN", "a").count() == 0


def test_leak_queries_cover_phones(spark, tmp_path):
    # Numbers that the detector does not take: with another separator, over two lines, glued to a digit.
    rests = ["key 91_98765_43210", "9198765\n\n43210", "ref 0919876543210177777", "none"]
    rows = [(i, "Call +91 98765 43210 now.\n\n" + t) for i, t in enumerate(rests)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.block_index, r.entity_type, r.original_text) for r in catalog.QUERIES["leak_check"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, 0, "PHONE_NUMBER", "+91 98765 43210") for i in range(3)]
    assert catalog.QUERIES["key_figures"](spark, str(tmp_path)).first().leaked == 3
