"""The registered queries do the whole job: no prefix, cap or window that is not their feature."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import rates
from logweir.plans import stored
from logweir.queries import analytics, ingest, search

SF = "/root/testdata/sf0.001"


@pytest.fixture
def late_words(spark, tmp_path):
    """Documents whose words of note come after the twelfth."""
    filler = " ".join(["x"] * 12)
    rows = [(1, f"{filler} the end"), (2, f"{filler} that"), (3, f"{filler} other  "), (4, "the"), (5, ""), (6, None)]
    df = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), dict(rows)


def test_lists_hold_every_word(spark, late_words):
    path, texts = late_words
    assert sorted(r.doc_id for r in search.QUERIES["f07_list_includes"](spark, path).collect()) == [1, 4]
    assert sorted(r.doc_id for r in search.QUERIES["f08_list_regexp"](spark, path).collect()) == [1, 2, 4]
    words = sorted(tuple(r) for r in search.QUERIES["p04_unnest"](spark, path).collect())
    assert words == sorted((i, w) for i, t in texts.items() if t is not None for w in t.split(" "))


N = 1_000_001


@pytest.fixture(scope="module")
def many_orders(spark, tmp_path_factory):
    """More customers, each with four dear orders, and more orders of one status, than the old cap of rows."""
    path = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{path}/nation.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{path}/lineitem.parquet")
    spark.range(1, N + 2).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), F.lit(1).alias("c_nationkey"), F.when(F.col("id") <= N, 1.0).otherwise(-1.0).alias("c_acctbal")).write.parquet(f"{path}/customer.parquet")
    spark.range(4 * N).select("id", F.expr(f"1 + id % {N}").alias("o_custkey"), F.when(F.expr(f"id < {N}"), "F").otherwise("P").alias("o_orderstatus"), F.lit(300000.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority")).withColumnRenamed("id", "o_orderkey").write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["z04_cte", "z05_subqueries", "z06_nested_views", "z07_parameters"])
def test_stored_queries_give_all_rows(spark, many_orders, name):
    assert analytics.QUERIES[name](spark, many_orders).count() == N


def test_the_cap_stays_a_feature(spark):
    assert stored.run_stored(spark, "SELECT id FROM range(2000)").count() == 1000
    assert stored.run_stored(spark, "SELECT id FROM range(2000)", max_rows=None).count() == 2000


T = dt.datetime(2023, 12, 30)


def plain_rolling(events, seconds):
    out = {}
    for source in {s for s, _ in events}:
        at = [int((t - T).total_seconds()) for s, t in events if s == source and t]
        top = 0
        for second in range(min(at), max(at) + 1):
            rate = at.count(second)
            total, top = sum(second - seconds < x <= second for x in at), max(top, rate)
            out[source, T + dt.timedelta(seconds=second)] = (rate, total, -(-total // seconds), top)
    return out


@pytest.mark.parametrize("block,seconds", [(86_400, 60), (50, 60), (50, 7), (50, 1), (60, 60)])
def test_rolling_rate_over_blocks(spark, monkeypatch, block, seconds):
    monkeypatch.setattr(rates, "BLOCK_SECONDS", block, raising=False)
    random.seed(block + seconds)
    events = [(s, T + dt.timedelta(seconds=random.choice([3, 49, 50, 51, 99, 101, 400, 777]), milliseconds=random.randrange(1000))) for s in ("a", "b", None) for _ in range(30)]
    df = spark.createDataFrame([*events, ("a", None)], "source string, timestamp timestamp_ntz")
    rows = rates.rolling_rate(df, seconds).collect()
    assert {(r["source"], r["timestamp"]): (r["rate"], r["sum"], r["average"], r["max"]) for r in rows} == plain_rolling(events, seconds)
    assert len(rows) == len(plain_rolling(events, seconds))


@pytest.fixture(scope="module")
def few_events(spark, tmp_path_factory):
    """Events within and without 2024-01-01 and 2024-01-10, one of each source."""
    path = str(tmp_path_factory.mktemp("few"))
    days = {"click": 1, "error": 1, "view": 10, "purchase": 20, "signup": 29}
    events = spark.read.parquet(f"{SF}/events.parquet").schema
    rows = [(i, dt.datetime(2024, 1, day, 1, 0, i), source) for i, (source, day) in enumerate(days.items())] + [(9, dt.datetime(2024, 1, 1, 2, 0, 0), "view"), (10, dt.datetime(2024, 1, 2, 1, 0, 0), "click")]
    given = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string")
    given.select(*((F.col(x.name) if x.name in given.columns else F.lit("1")).cast(x.dataType).alias(x.name) for x in events)).coalesce(1).write.parquet(f"{path}/written")
    os.rename(next(f"{path}/written/{x}" for x in os.listdir(f"{path}/written") if x.startswith("part-")), f"{path}/events.parquet")  # streams read a file
    return path, [(source, at) for _, at, source in rows]


def test_rolling_rate_sees_all_events(spark, few_events):
    path, events = few_events
    rows = analytics.QUERIES["n02_rolling"](spark, path)
    span = F.col("end") - F.col("start")
    by = {r["source"]: (r["n"], r["events"], r["top"]) for r in rows.groupBy("source").agg(F.sum(span).alias("n"), F.sum(F.col("rate") * span).alias("events"), F.max("max").alias("top")).collect()}
    assert by == {"click": (86_401, 2, 1), "error": (1, 1, 1), "view": (int((dt.datetime(2024, 1, 10, 1, 0, 2) - dt.datetime(2024, 1, 1, 2)).total_seconds()) + 1, 2, 1), "purchase": (1, 1, 1), "signup": (1, 1, 1)}


def test_a_wrong_clock_costs_nothing(spark):
    """An event of 1970 is one more interval; seconds are made for the times asked for."""
    df = spark.createDataFrame([("a", dt.datetime(1970, 1, 1)), ("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1, 0, 0, 30))], "source string, timestamp timestamp_ntz")
    rows = sorted(map(tuple, rates.rolling_intervals(df).collect()), key=lambda r: r[1])
    new = int((dt.datetime(2024, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds())
    assert rows == [("a", 0, 1, 1, 1, 1, 1), ("a", 1, 60, 0, 1, 1, 1), ("a", 60, new, 0, 0, 0, 1), ("a", new, new + 1, 1, 1, 1, 1), ("a", new + 1, new + 30, 0, 1, 1, 1), ("a", new + 30, new + 31, 1, 2, 1, 1)]
    seconds = rates.rolling_rate(df, low="2023-12-31 23:59:59", high="2024-01-01 00:00:01").collect()
    assert [(r["rate"], r["sum"]) for r in sorted(seconds, key=lambda r: r["timestamp"])] == [(0, 0), (1, 1), (0, 1)]


def test_stream_averages_see_all_events(spark, few_events):
    path, events = few_events
    rows = {(r["source"], r["timestamp"], r["sum"], r["average"]) for r in ingest.QUERIES["t05_averages"](spark, path).collect()}
    assert rows == {(s, t + dt.timedelta(seconds=i), 1, 1) for s, t in events for i in range(60)}


def test_updates_see_all_sources_and_paths(spark, few_events):
    rows = dict(map(tuple, ingest.QUERIES["h05_updates"](spark, few_events[0]).collect()))
    assert rows == {"event_message": "string", "id": "string", "timestamp": "datetime", "num": "string", "list": "list<float>", "metadata": "map", "metadata.level": "string", "metadata.code": "integer", "x": "float"}


@pytest.mark.parametrize("name", ["variants", "telemetry", "bodies"])
def test_a_file_of_one_row_group_is_dealt(spark, name):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # many partitions, of which one has all rows
    try:
        df = getattr(ingest, name)(spark, SF)
        counts = [r["count"] for r in df.select("id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(counts) == spark.read.parquet(f"{SF}/events.parquet").count() and max(counts) <= sum(counts) / 4
