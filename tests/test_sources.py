import hashlib
import re
import time
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pytest

from crawlq.operators import domains
from crawlq.plans import registry
from crawlq.sources import archive, daily, files, readers


def test_html_files(spark, tmp_path):
    for name, text in (("a", "<b>\n</b>"), ("b", "x")):
        (tmp_path / f"{name}.html").write_text(text)
    rows = {r.url.rsplit("/", 1)[1]: r.html for r in readers.read_pages(spark, str(tmp_path)).collect()}
    assert rows == {"a.html": "<b>\n</b>", "b.html": "x"}


def test_a_folder_per_page_is_not_a_task_per_folder(spark, tmp_path):
    n, context = 1000, spark.sparkContext
    for i in range(n):
        (tmp_path / f"page_id={i}").mkdir()
        (tmp_path / f"page_id={i}" / "a.txt").write_text(f"<b>{i}</b>")
    usual = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    context.setJobGroup("page folders", "listing")
    try:
        pages = readers.read_pages(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker, tasks = context.statusTracker(), 0
    for _ in range(100):  # the tracker hears of a job a little later
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("page folders") for s in tracker.getJobInfo(j).stageIds]
        tasks = sum(s.numTasks for s in stages if s)
        if tasks:
            break
        time.sleep(0.1)
    assert 0 < tasks <= 4 * context.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == usual
    assert {r.html for r in pages.select("html").collect()} == {f"<b>{i}</b>" for i in range(n)}


def test_every_page_row_has_its_file(spark, tmp_path):
    """Pages that share an id and are written by one task are files of their own."""
    rows = [(i // 20, "u", f"<b>{i}</b>") for i in range(40)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["read_page_files"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, hashlib.md5(f"{html}\n".encode()).hexdigest()) for i, _, html in rows)


def test_small_page_files_share_tasks(spark, tmp_path):
    n, most = 1000, "spark.sql.files.maxPartitionBytes"
    for i in range(n):
        (tmp_path / f"{i}.html").write_text(f"<b>{i}</b>")
    usual = spark.conf.get(most)
    spark.conf.set(most, "4m")  # a file fills a part, since opening it counts as 4 MB
    try:
        pages = readers.read_pages(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, 1 + n // readers.PARTS_PER_TASK)
        assert {r.html for r in pages.select("html").collect()} == {f"<b>{i}</b>" for i in range(n)}
        assert pages.select("url").distinct().count() == n
    finally:
        spark.conf.set(most, usual)


def test_page_files_bring_no_folders_and_checksum_files(spark, tmp_path):
    """Spark starts a process for each folder and checksum file it writes on a local file system."""
    n, most = 200, 4 * spark.sparkContext.defaultParallelism
    spark.range(n).selectExpr("id AS page_id", "'u' AS url", "concat('<b>', id) AS html").write.parquet(str(tmp_path / "pages.parquet"))
    pages = registry.QUERIES["read_page_files"](spark, str(tmp_path))
    found = [Path(unquote(urlsplit(f).path)) for f in pages.inputFiles()]
    assert len(found) == n and len({f.parent for f in found}) <= most
    assert not [f for folder in {f.parent for f in found} for f in folder.iterdir() if f.suffix == ".crc"]
    assert sorted(tuple(r) for r in pages.collect()) == sorted((i, hashlib.md5(f"<b>{i}\n".encode()).hexdigest()) for i in range(n))


@pytest.mark.parametrize("local", [True, False])
def test_page_files_of_odd_rows(spark, tmp_path, monkeypatch, local):
    """Null pages are empty lines, null ids have a name, bytes stay as they are, equal rows are files of their own."""
    monkeypatch.setattr(files, "PER_FOLDER", 3)
    if not local:
        monkeypatch.setattr(files, "local_path", lambda *_: None)
    odd = "(1, X'61'), (1, X'61'), (1, X'0a620a'), (NULL, X'63'), (-2, X'ff00e4'), (3, NULL), (4, X''), (5, encode('é€', 'utf-8'))"
    pages = spark.sql(f"SELECT CAST(id AS BIGINT) AS page_id, CAST(bytes AS STRING) AS html FROM VALUES {odd} AS t(id, bytes)").coalesce(1)
    folder = tmp_path / "a b%20c"
    readers.write_pages(pages, str(folder))
    found = sorted((f.name if local else f.parent.name, f.read_bytes()) for f in folder.rglob("*.txt"))
    names = ["-2", "1", "1", "1", "3", "4", "5", "__HIVE_DEFAULT_PARTITION__"]
    assert sorted(re.search("page_id=(-?[0-9]+|__.*__)", name)[1] for name, _ in found) == names
    bodies = [b"\n", b"\n", b"\nb\n\n", b"a\n", b"a\n", b"c\n", "é€\n".encode(), b"\xff\x00\xe4\n"]
    assert sorted(body for _, body in found) == bodies
    if local:
        assert len(list(folder.iterdir())) == 3
    back = readers.read_pages(spark, str(folder), recursiveFileLookup="true")
    assert sorted(bytes(r[0]) for r in back.selectExpr("CAST(html AS BINARY)").collect()) == bodies
    readers.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert readers.read_pages(spark, str(tmp_path / "none"), recursiveFileLookup="true").count() == 0


def test_page_files_of_broken_tasks_do_not_count(spark, tmp_path):
    """What a task wrote before it broke is not published."""
    pages = spark.range(20).selectExpr("id AS page_id", "if(id = 19, raise_error('lost'), 'x') AS html").coalesce(1)
    with pytest.raises(Exception, match="lost"):
        readers.write_pages(pages, str(tmp_path / "p"))
    assert readers.read_pages(spark, str(tmp_path / "p"), recursiveFileLookup="true").count() == 0


def test_tld_list(spark, tmp_path):
    (tmp_path / "tlds.txt").write_text("# comment\n\n COM \norg\n")
    tlds = readers.read_tlds(spark, str(tmp_path / "tlds.txt"))
    hosts = spark.createDataFrame([("a.com",), ("b.NET",), ("org",)], "host string")
    assert {r.host for r in readers.tld_check(hosts, tlds).collect()} == {"a.com", "org"}
    assert {r.host for r in readers.tld_check(hosts, tlds, known=False).collect()} == {"b.NET"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_tlds(spark, str(tmp_path / "none.txt"))


def test_hosts(spark, tmp_path):
    (tmp_path / "h.txt").write_text("  google.com \nlocalhost\n")
    assert domains.dga_scores(readers.read_hosts(spark, str(tmp_path / "h.txt"))).count() == 2


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", "same", {"b": "1", "a": "2"}), ("b", "same", {"a": "2", "b": "1"}), ("c", None, None)],
        "url string, html string, headers map<string,string>",
    )
    archive.write_archive(df, str(tmp_path))
    back = {(r.url, r.part): r.body for r in archive.read_archive(spark, str(tmp_path)).collect()}
    assert back[("a", "content")] == back[("b", "content")] == "same" and back[("c", "content")] == ""
    assert back[("a", "header")] == back[("b", "header")] == '{"a":"2","b":"1"}'
    assert archive.archive_runs(spark, str(tmp_path))[1].count() == 3


def test_archive_grows_by_runs(spark, tmp_path):
    schema = "url string, html string, meta struct<code: int>"
    first = spark.createDataFrame([("a", "same", (200,)), ("b", "same", (404,)), ("c", "old", (200,))], schema)
    second = spark.createDataFrame([("c", "new", (200,)), ("d", "same", None)], schema)
    assert archive.read_archive(spark, str(tmp_path)).collect() == []
    assert [archive.write_archive(f, str(tmp_path)) for f in (first, second, second)] == [0, 1, 2]
    refs, blobs = archive.archive_runs(spark, str(tmp_path))
    written = sorted((r.run, r.body) for r in blobs.collect())
    assert written == [(0, "old"), (0, "same"), (0, '{"code":200}'), (0, '{"code":404}'), (1, "new")]  # no body twice
    assert refs.where("run = 0").count() == 6 and refs.where("run = 2").count() == 3
    want = {("a", "content"): "same", ("b", "content"): "same", ("c", "content"): "new", ("d", "content"): "same"}
    want |= {("a", "meta"): '{"code":200}', ("b", "meta"): '{"code":404}', ("c", "meta"): '{"code":200}'}
    assert {(r.url, r.part): r.body for r in archive.read_archive(spark, str(tmp_path)).collect()} == want


def test_a_broken_archive_run_does_not_count(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "one")], "url string, html string")
    archive.write_archive(df, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(archive.files, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            archive.write_archive(spark.createDataFrame([("a", "two")], "url string, html string"), str(tmp_path))
    assert [r.body for r in archive.read_archive(spark, str(tmp_path)).collect()] == ["one"]
    assert archive.write_archive(spark.createDataFrame([("a", "three")], "url string, html string"), str(tmp_path)) == 1
    assert [r.body for r in archive.read_archive(spark, str(tmp_path)).collect()] == ["three"]


def test_publishing(spark, tmp_path):
    files.publish(spark, f"{tmp_path}/m/x.json", "whole")
    with pytest.raises(FileExistsError):
        files.publish(spark, f"{tmp_path}/m/x.json", "other")
    assert files.names(spark, f"{tmp_path}/m") == [".x.json.crc", "x.json"] or files.names(spark, f"{tmp_path}/m") == ["x.json"]
    assert (tmp_path / "m" / "x.json").read_text() == "whole" and files.names(spark, f"{tmp_path}/none") == []


def test_daily(spark):
    spans = spark.sql("SELECT DATE'2024-03-01' AS end_date, n FROM VALUES (3), (0), (-1) AS t(n)")
    rows = daily.daily_files(spans, "x_{}.zip").collect()
    assert [r.file_name for r in rows] == ["x_2024_03_01.zip", "x_2024_02_29.zip", "x_2024_02_28.zip"]
    ts = spark.sql("SELECT TIMESTAMP_NTZ'2024-02-29 23:59:59' AS ts")
    assert {str(r.day): r.cnt for r in daily.daily_gapfill(ts, "ts", "2024-03-01", 2).collect()} == {"2024-02-29": 1, "2024-03-01": 0}
    assert daily.daily_missing(ts, "ts", "2024-03-01", 0).count() == 0


def test_day_range_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = daily.daily_gapfill(orders, "o_orderdate", "1995-01-31", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan
