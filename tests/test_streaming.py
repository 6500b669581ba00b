from cuelake.streaming import sessions


def test_sessions(spark, tmp_path):
    rows = [(0, "2024-01-01 00:00:00", 5.0), (0, "2024-01-01 00:00:05.3", 1.0), (0, "2024-01-01 00:01:00", 1.0), (0, "2024-01-01 01:00:00", 1.0)]
    src = spark.createDataFrame(rows, "video_id long, ts string, seconds double").selectExpr("video_id", "CAST(ts AS TIMESTAMP) AS ts", "seconds")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = sessions.speech_sessions(stream, 0.5).writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r.segments for r in spark.sql("SELECT segments FROM sessions ORDER BY start").collect()] == [2, 1, 1]


def test_events(spark, tmp_path):
    rows = [(0, float(t), 0, 0, 50, 20, x) for t, x in ((0, "aa"), (0.5, "aa"), (9, "bbbb"), (20, "cc"))]
    src = spark.createDataFrame(rows, "video_id long, frame_time double, x1 long, y1 long, x2 long, y2 long, text string")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = sessions.detection_events(stream).writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.start, r.end, r.frame_count) for r in spark.sql("SELECT * FROM found ORDER BY start").collect()] == [(0, 0.5, 2), (9, 9, 1)]
