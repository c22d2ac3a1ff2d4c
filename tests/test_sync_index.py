"""The bucketed index: which files a batch writes, old versions, repeated batches, stamps and counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillwork.streaming import jobs
from quillwork.streaming.index import BucketedTable

NOW = dt.datetime(2024, 5, 1, 12)
KINDS = "id string, text string"


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, f"{tmp_path}/index", KINDS, buckets=8, compact_after=3, keep=2)


def put(spark, table, batch, rows, job="job", now=NOW):
    return table.merge(spark.createDataFrame(rows, KINDS), job, batch, now)


def content(table, version=None):
    return {r.id: r.text for r in table.live(version).collect()}


def test_a_batch_writes_touched_buckets_only(spark, table):
    report = put(spark, table, 0, [(f"k{n}", "old") for n in range(100)])
    assert (report["version"], report["pushed"], report["buckets"], report["compacted"]) == (0, 100, 8, 0)
    before = table.files()
    report = put(spark, table, 1, [("k3", "new"), ("other", "first")])
    after = table.files()
    changed = {b for b in after if after[b] != before.get(b)}
    assert report["buckets"] == len(changed) <= 2
    assert all(set(before[b]) < set(after[b]) for b in changed)  # what was there stays, a delta is added
    assert content(table) == {f"k{n}": "old" for n in range(100)} | {"k3": "new", "other": "first"}
    assert len(content(table, 0)) == 100  # the version before is still there


def test_compaction_and_collection(spark, table):
    put(spark, table, 0, [(f"k{n}", "0") for n in range(40)])
    for n in (1, 2, 3, 4):
        report = put(spark, table, n, [("k7", str(n))])
        assert report["compacted"] == (n == 2)  # its bucket then has three deltas; others are left alone
    assert content(table) == {f"k{n}": "0" for n in range(40)} | {"k7": "4"}
    assert table.versions() == [3, 4]
    files = {f for v in table.versions() for fs in table.files(v).values() for f in fs}
    there = {f"{kind}/{v}/{b}/{n}" for kind in ("base", "delta") for v in table._names(kind) for b in table._names(f"{kind}/{v}") if b.startswith("bucket=") for n in table._names(f"{kind}/{v}/{b}") if n.endswith(".parquet")}
    assert there == files  # nothing but what the kept versions name
    bases = {b: base for b, (base, _) in table.manifest().items()}
    assert sorted(x for x in bases.values() if x is not None) == [2]


def test_repeated_and_interrupted_batches(spark, table):
    put(spark, table, 0, [("a", "one")])
    before = table.files()
    assert put(spark, table, 0, [("a", "again")])["version"] is None
    assert table.files() == before and content(table) == {"a": "one"}
    # a batch that failed before its manifest: files of version 1 lie about, and count for nothing
    spark.createDataFrame([("z", "lost", NOW, 1, 0)], f"{KINDS}, synced_at timestamp_ntz, version long, bucket int").write.partitionBy("bucket").parquet(f"{table.root}/delta/version=1")
    assert content(table) == {"a": "one"}
    assert put(spark, table, 1, [("b", "two")])["version"] == 1
    assert content(table) == {"a": "one", "b": "two"}
    assert put(spark, table, 0, [("c", "three")], job="other")["version"] == 2  # another job counts for itself
    assert [(r.version, r.job, r.batch, r.pushed) for r in table.log().orderBy("version").collect()] == [(0, "job", 0, 1), (1, "job", 1, 1), (2, "other", 0, 1)]


def test_ties_and_empty_batches(spark, table):
    assert content(table) == {} and table.log().count() == 0
    assert put(spark, table, 0, [])["pushed"] == 0
    put(spark, table, 1, [("a", "x"), ("a", "y"), ("a", None), ("b", None)])
    assert content(table) == {"a": "y", "b": None}


def test_stream_stamps_and_counts(spark, tmp_path):
    kinds = "id string, document_id long, article_number string, text string, sort_key int, chapter string, path string, slug string, depth int, footnotes string, synced boolean"
    docs = spark.createDataFrame([(1, "Code", "fr", "LAW", None, "f")], "id long, title string, language string, type string, group string, source_file string")
    index = BucketedTable(spark, f"{tmp_path}/index", jobs.RECORD, buckets=4)
    days = iter(dt.datetime(2024, 1, n) for n in range(1, 9))

    def write(*rows):
        spark.createDataFrame([(i, d, "n", text, 0, None, None, None, None, None, done) for i, d, text, done in rows], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        jobs.sync_incremental(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), docs, index, f"{tmp_path}/state", lambda: next(days))

    write(("a", 1, "one", None), ("b", 2, "two", None), ("c", 1, "done", True))
    run()
    write(("a", 1, "new", None), ("d", 1, "four", None))
    run()
    run()  # nothing new: no batch
    assert {r.id: (r.text, r.document_title) for r in index.live().collect()} == {"a": ("new", "Code"), "b": ("two", None), "d": ("four", "Code")}
    assert [(r.batch, r.pushed, r.synced_at.day) for r in index.log().orderBy("version").collect()] == [(0, 2, 1), (1, 2, 2)]
    articles = spark.createDataFrame([(i, None) for i in "abce"], "id string, synced boolean")
    stamped = {r.id: (r.synced, r.synced_at and r.synced_at.day) for r in jobs.stamped_articles(articles, index).collect()}
    assert stamped == {"a": (True, 2), "b": (True, 1), "c": (None, None), "e": (None, None)}


def test_a_large_bucket_is_several_files(spark, table):
    """A bucket above the advisory size of a partition is dealt over tasks, and reads back whole."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000).selectExpr("concat('k', id) AS id", "sha2(string(id), 256) AS text").repartition(8)
        table.merge(rows, "job", 0, NOW)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert all(len(files) > 1 for files in table.files().values())
    assert table.live().count() == 20_000 == table.live().select("id").distinct().count()


def test_batches_of_many_rows_are_several_files(spark, tmp_path, monkeypatch):
    """Batches stay as many; no file has more rows than about FILE_ROWS."""
    monkeypatch.setattr(jobs, "FILE_ROWS", 100)
    stream = jobs._streamed(spark.range(2000), str(tmp_path))
    jobs.run_now(stream, f"{tmp_path}/out", "append", f"{tmp_path}/state")
    saved = spark.read.parquet(f"{tmp_path}/out")
    assert saved.select("batch").distinct().count() == 2 and saved.count() == 2000
    counts = spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).count().collect()
    assert len(counts) == 20 and max(r["count"] for r in counts) <= 110
