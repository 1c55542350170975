"""A stream fed in several files gives what one batch gives."""

from pyspark.sql import functions as F

from crawlq.operators import domains, fetches
from crawlq.plans import inputs, registry
from crawlq.sources import readers
from crawlq.streaming import jobs


def test_hosts_stream(spark, tmp_path):
    hosts = ["google.com", " a.com ", "localhost", "xjwq-kd.net"]
    (tmp_path / "in").mkdir()
    for i, host in enumerate(hosts):
        (tmp_path / "in" / f"{i}.txt").write_text(host + "\n")
    source = readers.read_hosts(spark, str(tmp_path / "in"), stream=True)
    jobs.dga_scores_stream(source, f"{tmp_path}/out", f"{tmp_path}/state", available_now=True).awaitTermination()
    batch = domains.dga_scores(readers.read_hosts(spark, str(tmp_path / "in")))
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(batch.collect())


def test_state_stream(spark, tmp_path):
    changes = inputs.derived(spark, "/root/testdata/sf0.001", inputs.URL_CHANGES)
    changes.repartition(4).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.fetch_meta_stream(source, f"{tmp_path}/out", f"{tmp_path}/state", available_now=True, fold=3).awaitTermination()
    stream = jobs.read_fetch_meta(spark, f"{tmp_path}/out")
    assert jobs._runs(spark, f"{tmp_path}/out") == [(0, 2), (3, 3)]
    assert sorted(stream.collect()) == sorted(fetches.fetch_meta(changes).select(stream.columns).collect())


def _batch(spark, i, urls):
    return spark.createDataFrame([(u, i) for u in urls], "url string, http_code int")


def test_many_small_batches_leave_few_runs(spark, tmp_path):
    """40 batches folded by 3: every run of a size is whole, the newest row of every URL is read, files stay few."""
    out, newest = str(tmp_path / "out"), {}
    for i in range(40):
        urls = ["always", f"u{i % 7}", f"once{i}"]
        newest |= dict.fromkeys(urls, i)
        jobs.store_changes(_batch(spark, i, urls), i, out, fold=3)
    assert jobs._runs(spark, out) == [(0, 26), (27, 35), (36, 38), (39, 39)]
    assert len(list((tmp_path / "out").rglob("part-*.parquet"))) <= 8
    state = jobs.read_fetch_meta(spark, out)
    assert state.columns == ["url", "http_code"] and {r.url: r.http_code for r in state.collect()} == newest


def test_batches_and_merges_that_come_again(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for i in range(2):
        jobs.store_changes(_batch(spark, i, ["a", f"u{i}"]), i, out, fold=3)
    jobs.store_changes(_batch(spark, 1, ["a", "u1"]), 1, out, fold=3)  # again, before a merge
    with monkeypatch.context() as m:  # lost after the merge, before the clearing
        m.setattr(jobs.files, "remove", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        try:
            jobs.store_changes(_batch(spark, 2, ["a", "u2"]), 2, out, fold=3)
        except OSError:
            pass
    assert jobs._runs(spark, out) == [(0, 2)]
    jobs.store_changes(_batch(spark, 2, ["a", "u2"]), 2, out, fold=3)  # again, after the merge
    jobs.store_changes(_batch(spark, 3, ["a"]), 3, out, fold=3)
    assert {r.url: r.http_code for r in jobs.read_fetch_meta(spark, out).collect()} == {"a": 3, "u0": 0, "u1": 1, "u2": 2}


def test_streams_read_tables_in_one_or_many_files(spark, tmp_path):
    """A table is a file or a folder of files, beside others."""
    pages = [(i, f"https://h{i % 3}.example/{i}", "<p>") for i in range(20)]
    events = [(i, f"2024-01-01 00:00:{i:02d}", i % 4, ("click", "error", "view")[i % 3], i / 8) for i in range(20)]
    tables = {
        "pages": spark.createDataFrame(pages, "page_id bigint, url string, html string"),
        "events": spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts")),
    }
    for name, rows in tables.items():
        rows.repartition(5).write.parquet(f"{tmp_path}/folders/{name}.parquet")
        rows.coalesce(1).write.parquet(f"{tmp_path}/one-{name}")
        (tmp_path / "files").mkdir(exist_ok=True)
        next((tmp_path / f"one-{name}").glob("part-*.parquet")).rename(tmp_path / "files" / f"{name}.parquet")
    expected = {
        "stream_dga_scores": domains.dga_scores(tables["pages"].select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))),
        "stream_fetch_meta": fetches.fetch_meta(spark.sql(inputs.URL_CHANGES, events=tables["events"])),
    }
    for name, right in expected.items():
        for folder in ("files", "folders"):
            got = registry.QUERIES[name](spark, f"{tmp_path}/{folder}")
            assert sorted(got.collect()) == sorted(registry._plain(right.select(got.columns)).collect())
