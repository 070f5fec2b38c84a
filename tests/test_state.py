"""The store, jobs that resume, and the stream form."""

import pytest
from pyspark.sql import functions as F

from sitegraph.operators import archive
from sitegraph.plans.jobs import Handler, start_job
from sitegraph.streaming import pages as stream

from .test_crawl import S, corpus


def test_commits_are_seen_whole(spark, tmp_path):
    store = archive.Store(spark, str(tmp_path))
    with pytest.raises(KeyError):
        store.read("a")
    assert store.read("a", "x int").count() == 0
    store.commit(a=spark.range(3), b=spark.range(1))
    store.commit(a=store.read("a").union(spark.range(2)))
    assert store.version() == 2 and store.read("a").count() == 5 and store.read("b").count() == 1
    assert archive.Store(spark, str(tmp_path), "other").version() == 0
    store.commit({"a": spark.range(4)}, b=spark.range(2))
    store.commit({"a": spark.range(1), "c": spark.range(6)})
    assert store.read("a").count() == 10 and store.read("b").count() == 2 and store.read("c").count() == 6 and store.has("c") and not store.has("d")
    store.drop()
    assert store.version() == 0


def test_parts_and_passing_tables(spark):
    import os

    from sitegraph.session import Parts, passing, settled

    parts = Parts(spark, schema="id long")
    assert parts.read().count() == 0
    with passing(spark):
        first = settled(spark.range(3))
        assert parts.add(first).count() == 3
        path = first.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.exists(path)
    assert not os.path.exists(path)
    parts.add(spark.range(2))
    assert parts.read().count() == 5 and parts.last.count() == 2


def test_ranks_sums_and_first_rows(spark):
    from sitegraph.operators.ranking import first_k, ranked_within, running

    rows = spark.createDataFrame([(i, "a" if i % 4 else "b", i % 3) for i in range(200)], "i long, k string, v long")
    end = []
    got = {r["i"]: r["before"] for r in running(rows, ["i"], F.col("v"), "before", 5, end).collect()}
    assert got == {i: 5 + sum(j % 3 for j in range(i)) for i in range(200)} and end == [5 + sum(j % 3 for j in range(200))]
    places = {r["i"]: r["rank"] for r in ranked_within(rows, "k", ["i"]).collect()}
    assert [places[i] for i in (0, 4, 8)] == [0, 1, 2] and [places[i] for i in (1, 2, 3, 5)] == [0, 1, 2, 3]
    first = {r["k"]: r["firsts"] for r in first_k(rows, ["k"], "i", 3).collect()}
    assert first == {"a": [1, 2, 3], "b": [0, 4, 8]}
    assert running(rows.limit(0), ["i"], F.col("v"), "before").count() == 0


def test_frontier_states(spark):
    rows = [(f"u{i}", "h" + str(i % 2), 0, float(i % 2), i, "pending") for i in range(6)]
    f = spark.createDataFrame(rows, "url string, host string, depth int, priority double, seq long, status string").withColumn("ready_at", F.lit(None).cast("timestamp"))
    taken = archive.claim(f, 3)
    assert [r["url"] for r in taken.orderBy("priority", "seq").collect()] == ["u0", "u2", "u4"]
    f = archive.set_status(f, taken, "in_flight", "pending")
    assert f.where("status = 'in_flight'").count() == 3 and archive.recover(f).where("status = 'pending'").count() == 6
    assert archive.set_status(f, f, "done", "in_flight").where("status = 'done'").count() == 3
    with pytest.raises(TypeError):
        archive.prune(f)


def test_jobs_resume(spark, tmp_path):
    site = corpus(spark, {f"{S}/": '<a href=/a>a</a><a href=/b>b</a>', f"{S}/a": '<a href=/c>c</a>', f"{S}/b": "b", f"{S}/c": "c"})
    told = []
    handler = Handler(spark, site, archive.Store(spark, str(tmp_path)), {"respect_robots": False, "traps": False}, told.append)
    job = start_job(f"{S}/", {"max_depth": 5, "nonsense": 1}, "j1", told.append)
    assert told == ["unknown option nonsense"]
    with pytest.raises(RuntimeError):
        handler.run(job, fail_after=1)
    assert handler.crawls().head()["status"] == "failed"
    second = handler.run(job)
    assert (second["done"], second["attempt"], second["resumed"], second["stopped_by"]) == (4, 2, True, "completed")
    assert sorted(r["url"] for r in handler.pages("j1").select("url").collect()) == [f"{S}/", f"{S}/a", f"{S}/b", f"{S}/c"]
    assert handler.run(job)["attempt"] == 2
    with pytest.raises(TypeError):
        start_job("x", {"max_pages": "3"})
    with pytest.raises(TypeError):
        start_job([])
    with pytest.raises(TypeError):
        start_job("x", {"scope": {"exclude": [1]}})
    with pytest.raises(KeyError):
        handler.run(start_job(f"{S}/", {}, "j2", told.append, crawl_uid="unknown"))
    row = handler.site.crawl("j1")
    assert row["started_at"] <= row["ended_at"] and handler.site.crawl_by_job("j1")["uid"] == "j1"
    assert handler.site.table("archive").count() == 4 and handler.site.pages("j1").count() == 4
    handler.site.delete("j1")
    assert handler.site.crawl("j1") is None and handler.site.table("page").count() == 0 and handler.site.table("archive").count() == 4


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.example/p?q={i % 11}", 200 if i % 4 else 404, i) for i in range(200)]
    frame = spark.createDataFrame(rows, "seq long, url string, status int, size long")
    frame.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, made, mode in (("n", stream.counts(source), "complete"), ("first", stream.first_seen(source.select("url")), "append"), ("ok", stream.admit(source, 4), "append")):
        made.writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("s_n").collect())) == sorted(map(tuple, stream.counts(frame).collect()))
    assert spark.table("s_first").count() == frame.select("url").distinct().count()
    from sitegraph.operators.policy import urls_per_path

    assert sorted((r["seq"], r["admitted"]) for r in spark.table("s_ok").collect()) == sorted((r["seq"], r["admitted"]) for r in urls_per_path(frame, "seq", 4).collect())
    out = str(tmp_path / "out")
    stream.persist(source, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 200


def test_prune_by_age_with_pages_that_share_a_url(spark, tmp_path):
    import duckdb

    from sitegraph.plans.queries import QUERIES, SQL

    rows = [(i, f"https://h.example/{i % 24}", f"<p>{i}") for i in range(96)]  # some urls are in the archive and in the run, several times each
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = con.sql(SQL["m9_prune_age"]).fetchall()
    assert sorted(map(tuple, QUERIES["m9_prune_age"](spark, str(tmp_path)).collect())) == sorted(wanted) and len(wanted) == 32


@pytest.mark.parametrize("name", ["stream_admit", "stream_host_schedule", "stream_soft_duplicates"])
def test_streams_order_groups_of_many_tables(spark, tmp_path, name):
    """A group comes to its step in many tables, whose order says nothing."""
    import duckdb

    from sitegraph.plans.queries import QUERIES, SQL

    rows = [((i * 7919) % 3000, i % 3, "view" if i % 5 else "click", float(((i * 7919) % 3000) % 137), None) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    wanted = con.sql(f"select {'seq, admitted' if name == 'stream_admit' else '*'} from ({SQL[name]})").fetchall()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == sorted(wanted) and len(got) == 3000


def test_ranges_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A hot key is cut by as many ranges as its rows need, and goes on from one to the next; rows without a key are ranked too."""
    from sitegraph.operators import ranking

    rows = [((i * 7919) % 5000, None if i % 10 == 0 else "hot" if i % 50 else f"k{i % 7}") for i in range(5000)]
    spark.createDataFrame(rows, "i long, k string").write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(ranking, "SLICE", 1 << 10)
    made = ranking.ranked_within(table, "k", ["i"])
    assert ranking.slices(table) > 5 and made.rdd.getNumPartitions() == ranking.slices(table)
    places, wanted = {}, {}
    for i, k in sorted(rows):
        wanted[i], places[k] = places.get(k, 0), places.get(k, 0) + 1
    assert {r["i"]: r["rank"] for r in made.collect()} == wanted and len(wanted) == 5000
    assert sorted(tuple(r) for r in ranking.ranked(table, ["i"]).select("i", "rank").collect()) == [(i, i) for i in range(5000)]


def _count(df, what):
    return str(df._jdf.queryExecution().optimizedPlan().toString()).count(what)


def test_a_run_is_merged_in_one_join(spark):
    """As by ``upsert_archive`` and then ``visited``; each body moves once, and not at all into an empty archive."""
    from sitegraph.plans.persist import merged

    def rows(urls, status, tag, body):
        return [(u, bytearray(body + u.encode()) if body else None, "t", None, tag, None, tag and tag + "h", status, 1 if body else None, None) for u in urls]

    old = spark.createDataFrame(rows("abcd", 200, "old", b"o"), archive.ARCHIVE)
    new = spark.createDataFrame(rows("b", 200, "new", b"n") + rows("c", 304, None, None) + rows("d", 404, None, None) + rows("e", 200, "e", b"e"), archive.ARCHIVE)
    kept = old.select("url", F.col("etag").alias("e"), F.col("content_hash").alias("h"))
    visits = new.join(kept, "url", "left").withColumns({c: F.when(F.col("last_status") == 304, F.coalesce(c, o)).otherwise(F.col(c)) for c, o in (("etag", "e"), ("content_hash", "h"))})
    wanted = archive.visited(archive.upsert_archive(old, new), visits.select(new.columns))
    got = merged(old, new)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.select(got.columns).collect())) and got.count() == 5
    assert _count(got, "Join ") == 1
    assert _count(merged(archive.Store(spark, "/tmp/none-such").read("archive", archive.ARCHIVE), new), "Join ") == 0


def test_urls_of_a_corpus_leave_bodies_where_they_are(spark):
    from sitegraph.plans import site_queries as Q

    for second in (False, True):
        urls = Q._site_urls(spark, "/root/testdata/sf0.001", second)
        assert _count(urls, "html") == _count(urls, "Relation") and urls.count() == Q._site_corpus(spark, "/root/testdata/sf0.001", second).count()  # only the scan's own names
