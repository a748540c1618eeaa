"""Streams over several micro-batches, replays and failures half way."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import metrics, ranking
from lodestream.streaming import jobs

STAR = {
    "articles": "url_hash string, article_id long, author string, publish_time timestamp, crawl_time timestamp, title string", "analyses": "batch_no string, article_id long, trend double",
    "insights": "batch_no string, article_id long, text string", "links": "batch_no string, article_id long, analysed boolean, selected boolean",
    "batches": "batch_no string, status string, article_count long, success_count long, failed_count long",
}


def test_health_over_micro_batches_equals_the_batch_form(spark, tmp_path, monkeypatch):
    """Times that micro-batches mix, equal times, sources without a success; lists longer than a piece."""
    monkeypatch.setattr(jobs, "CHUNK", 3)
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(60)), rng.choice(["failed", "failed", "partial", "success"])) for i in range(120)]
    rows = [(i, s, t, "failed" if s == 3 else x) for i, s, t, x in rows]
    df = spark.createDataFrame(rows, "run_id long, source_id long, finished_at timestamp, status string")
    path = str(tmp_path / "runs")
    for k in range(4):
        df.filter(F.col("run_id") % 4 == k).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_table(spark, path)
    out = jobs.drain(jobs.health_stream(stream, "source_id", "finished_at", "status", "run_id"), "health")
    assert out.groupBy("source_id").agg(F.sum("rows")).count() == 3 and out.count() > 8
    want = {r["source_id"]: r["failures"] for r in metrics.source_health(df.withColumn("n", F.lit(0)), "source_id", "finished_at", "status", "n", "run_id").collect()}
    # the last row of each source: the most rows seen so far come with it
    got = {}
    for r in out.collect():
        got.setdefault(r["source_id"], []).append(r["failures"])
    assert all(want[s] in found for s, found in got.items())
    files = sorted((tmp_path / "runs").glob("*.parquet"), key=lambda f: (f.stat().st_mtime, f.name))
    seen = spark.read.parquet(str(files[0]))
    first = {r["source_id"]: r["failures"] for r in metrics.source_health(seen.withColumn("n", F.lit(0)), "source_id", "finished_at", "status", "n", "run_id").collect()}
    assert all(first[s] in got[s] for s in first)


def payload(batch):
    name = F.concat(F.lit("h"), F.col("id").cast("string")).alias("url_hash")
    none = F.lit(None).cast("timestamp")
    return {
        "articles": batch.select(name, F.lit("").alias("author"), none.alias("publish_time"), none.alias("crawl_time"), F.lit("t").alias("title")),
        "analyses": batch.select(name, F.col("id").cast("double").alias("trend")), "insights": batch.filter("id % 2 = 0").select(name, F.lit("told").alias("text")),
    }


def test_a_replayed_delivery_changes_nothing(spark, tmp_path, monkeypatch):
    path, source = str(tmp_path / "star"), str(tmp_path / "in")
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    star = {n: spark.createDataFrame([], s) for n, s in STAR.items()}
    run = lambda state=None: jobs.import_stream(jobs.stream_table(spark, source), path, star, payload, state=state)
    content = lambda: {n: sorted(map(tuple, t.collect()), key=repr) for n, t in jobs.read_star(spark, path).items()}

    # the second delivery breaks after its tables are written and before the log has it
    take, calls = jobs.BatchLog.take, []

    def broken(self, batch, version):
        calls.append(batch)
        if batch == 1 and calls.count(1) == 1:
            raise RuntimeError("lost")
        take(self, batch, version)

    monkeypatch.setattr(jobs.BatchLog, "take", broken)
    state = str(tmp_path / "state")
    with pytest.raises(Exception, match="lost"):
        run(state)
    half = content()
    assert len(half["articles"]) == 10 and [b[0] for b in half["batches"]] == ["COL-0"]
    run(state)
    whole = content()
    assert len(whole["articles"]) == 20 and len(whole["links"]) == 20 and [b[:3] for b in whole["batches"]] == [("COL-0", "success", 10), ("COL-1", "success", 10)]
    run()  # without its state, all comes again
    run(str(tmp_path / "other"))
    assert content() == whole and calls == [0, 1, 1]


def test_many_caps_against_the_plain_pass(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xxxy"), rng.randint(0, 50), rng.choice("abcde"), rng.choice(["p", "q", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, s long, c string, t string")
    for caps, target in (({"c": 3, "t": 5}, 14), ({"t": 150, "c": 60}, 10**6)):
        want = {}
        for g in "xy":
            used, n = {}, 0
            for k, _, _, c, t in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])):
                tags = {"c": c, "t": t or ""}
                full = next((f"{x}_cap" for x in caps if caps[x] and used.get((x, tags[x]), 0) >= caps[x]), None)
                want[k] = full or ("capacity" if n >= target else "selected")
                if want[k] == "selected":
                    n += 1
                    for x in caps:
                        used[x, tags[x]] = used.get((x, tags[x]), 0) + 1
        got = ranking.select_capped(df, "g", [F.col("s").desc(), F.col("k")], caps, target, "k")
        assert {r["k"]: r["outcome"] for r in got.collect()} == want
    assert ranking.select_capped(df.limit(0), "g", [F.col("k")], {"c": 1}, 2, "k").count() == 0
