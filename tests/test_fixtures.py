from cuelake import fixtures, queries


def test_whole_texts_of_all_documents(spark, tmp_path):
    d = str(tmp_path)
    kinds = ["view", "click", "signup", "purchase"]
    events = spark.range(2000).selectExpr("id AS event_id", f"array({', '.join(repr(k) for k in kinds)})[id % 4] AS event_type", "20.0D AS value", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts")
    events.write.parquet(f"{d}/events.parquet")
    text = lambda i: f"document {i} has\n" + "more words than fit " * 10 + f"end {i}"
    spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    want = {text(i).replace("\n", " ") for i in range(300)}
    for lend in (fixtures.primary, fixtures.secondary, fixtures.shown):
        rows = lend(spark, d).collect()
        assert len(rows) == 500 and {r.text for r in rows} <= want
    assert {r.text for r in fixtures.primary(spark, d).collect()} == want
    assert {r.text for r in queries.QUERIES["ensemble_merge"](spark, d).collect()} & want
