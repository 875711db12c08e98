"""Streams of documents."""

from veilspark.streaming import redaction as R


def test_mapping_agrees_across_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    first = spark.createDataFrame([(1, "Mail a@x.org"), (2, "Mail b@x.org")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "Mail A@X.ORG or c@x.org")], "doc_id long, text string")
    mapping = R.Mapping(spark, str(tmp_path / "map"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = R.document_stream(spark, str(source), "doc_id long, text string")
        q = R.redact_stream(stream, mapping, out, str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    text = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    words = {k: v.split(" ") for k, v in text.items()}
    assert words[3][1] == words[1][1] != words[2][1]
    assert len({words[1][1], words[2][1], words[3][3]}) == 3 and all(w.endswith("@example.com") for w in (words[1][1], words[2][1], words[3][3]))


def test_masked_and_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "Mail a@x.org\nIP 10.0.0.1"), (2, None)], "doc_id long, text string").write.parquet(source)
    stream = R.document_stream(spark, source, "doc_id long, text string")
    for name, df, mode in (("masked", R.masked_stream(stream), "append"), ("counts", R.entity_counts_stream(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.text for r in spark.sql("select text from masked").collect()) == ["IP [IP_ADDRESS]", "Mail [EMAIL_ADDRESS]"]
    assert {r.entity_type: r.occurrences for r in spark.sql("select * from counts").collect()} == {"EMAIL_ADDRESS": 1, "IP_ADDRESS": 1}
