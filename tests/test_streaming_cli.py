from quire import cli
from quire.streaming import incremental


def test_markdown_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "# A\nx\n## B\ny")], "doc_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    incremental.index_markdown(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "# C")], "doc_id long, text string").write.mode("append").parquet(source)
    incremental.index_markdown(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "title").collect()
    assert sorted(map(tuple, got)) == [(1, "A"), (1, "B"), (2, "C")]


def test_windows_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, 1, "a", 10 * i) for i in range(6)] + [(9, 1, "a", 300), (9, 1, "a", 300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, m int").selectExpr("event_id", "user_id", "event_type", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) AS ts")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)

    def collect(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.n for r in collect(incremental.tumbling(stream), "complete", "t")) == [2, 6]
    assert len(collect(incremental.distinct_events(stream), "append", "d")) == 7
    done = collect(incremental.sessions(stream), "append", "s")
    assert [r.n for r in done] in ([6], [])


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "doc.md").write_text("# Cats\nall about cats\n## Dogs\nbarking")
    out = str(tmp_path / "ix")
    assert cli.main(["index", "--markdown", str(tmp_path), "--out", out, "--add-doc-description", "yes"], spark) == 0
    assert cli.main(["show", "--index", out], spark) == 0
    assert "[0001] Dogs" in capsys.readouterr().out
    assert cli.main(["search", "--index", out, "barking"], spark) == 0
    assert "[0001] Dogs" in capsys.readouterr().out
