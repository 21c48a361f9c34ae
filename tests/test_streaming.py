import gzip

from lociframe.streaming import call_stream, commented_tsv_stream, latest_version_stream


def drain(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_commented_files_stream_in(spark, tmp_path, rows):
    for i in range(3):
        with gzip.open(tmp_path / f"{i}.tsv.gz", "wt") as f:
            f.write(f"#part={i}\ngene\tclass\nG{i}\tvus\n#end=1\n")
    stream = commented_tsv_stream(spark, str(tmp_path), "gene STRING, class STRING", files_per_batch=1)
    assert rows(drain(stream, "commented_rows", "append")) == [(f"G{i}", "vus") for i in range(3)]


def test_calls_and_latest_versions(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    schema = "analysis_id int, cancer_cohort string, hrd_score double, version int"
    for data in ([(1, "K", 0.1, 1), (2, "Z", 0.9, 1)], [(1, "K", 0.3, 2), (2, "Z", float("nan"), 0)]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
    thresholds = spark.createDataFrame(
        [("Pan Cancer", "m", 0.5), ("K", "m", 0.2)], "cancer_cohort string, hrd_metric string, threshold double"
    )
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    called = drain(call_stream(stream, thresholds, "m"), "calls", "append")
    assert rows(called, "analysis_id", "version", "hrd_call") == [
        (1, 1, "Not Detected"),
        (1, 2, "Positive"),
        (2, 0, "Not Detected"),
        (2, 1, "Positive"),
    ]
    newest = drain(latest_version_stream(stream, ["analysis_id"], "version", "analysis_id"), "newest", "complete")
    assert rows(newest, "analysis_id", "version") == [(1, 2), (2, 1)]
