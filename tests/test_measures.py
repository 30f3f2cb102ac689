"""Paths and patterns, snapshots, archives, percentiles by ranges, runs over several days."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.operators import activity, evaluation, maintenance, measures, vectors
from threadlake.operators.transcripts import tool_summary, with_summaries
from threadlake.sources import readers

BODY = json.dumps({"a": {"b": [10, {"c": "x"}], "7": "seven"}, "rows": [{"k": "m", "v": 1}, {"k": "n", "v": 2.5}, {"k": "n", "v": 3}], "null": None, "text": '{"inner": 1}', "a.b": 5})


@pytest.mark.parametrize(
    ("path", "want"),
    [("a.b.0", "10"), ("a.b[1].c", "x"), ("a.b.2", None), ("a.7", "seven"), ("rows[k=n].v", "2.5"), ("rows[k=z].v", None), ("a.nothing", None), ("null", None), ("text.inner", None), ("a.b.1", '{"c":"x"}'), ("a[k=n].v", None)],
)
def test_json_path(spark, path, want):
    df = spark.createDataFrame([(BODY,)], "body string")
    assert df.select(measures.json_path(F.col("body"), path)).first()[0] == want
    assert df.select(measures.json_path(F.col("body"), path, "none")).first()[0] == (want if want is not None else "none")


def test_unreadable_bodies_and_patterns(spark):
    df = spark.createDataFrame([("no json",), (None,), ("total:\n 42 stars",)], "body string")
    assert [r[0] for r in df.select(measures.json_path(F.col("body"), "a.b")).collect()] == [None] * 3
    assert [r[0] for r in df.select(measures.regex_value(F.col("body"), r"total:.*?(\d+) (\w+)", 2)).collect()] == [None, None, "stars"]
    assert [r[0] for r in df.select(measures.cast_value(measures.regex_value(F.col("body"), r"total:.*?(\d+)"), "int")).collect()] == [None, None, 42]


def test_tool_field_counts_as_a_string_only(spark):
    rows = [("Bash", '{"command": "ls"}'), ("Bash", '{"command": 5}'), ("Bash", '{"command": {"x": 1}}'), ("Read", '{"command": "ls"}'), ("Own", '{"a":1}'), ("Bash", None)]
    df = spark.createDataFrame(rows, "name string, body string")
    got = [r[0] for r in df.select(tool_summary(F.col("name"), F.col("body"))).collect()]
    assert got == ["Bash: `ls`", 'Bash: `{"command":5}`', 'Bash: `{"command":{"x":1}}`', 'Read: `{"command":"ls"}`', 'Own: `{"a":1}`', "Bash: `{}`"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    for at in (1, 3, 2):
        measures.append_snapshot(spark.createDataFrame([("stars", float(at)), ("forks", 0.0)], "metric string, value double"), path, "p", at)
    measures.append_snapshot(spark.createDataFrame([("stars", 9.0)], "metric string, value double"), path, "q", 1)
    history = spark.read.parquet(path)
    assert {(r.project, r.metric, r.value) for r in measures.latest_snapshot(history).collect()} == {("p", "stars", 3.0), ("p", "forks", 0.0), ("q", "stars", 9.0)}
    assert [r.fetched_at for r in measures.snapshot_history(history, "p").collect()] == [1, 1, 2, 2, 3, 3]


def test_archive_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "archive")

    def files(*rows):
        return spark.createDataFrame(rows, "project string, name string, raw string")

    maintenance.archive(files(("p", "a.jsonl", "1"), ("p", "a.jsonl", "1"), ("q", "a.jsonl", "2")), path)
    maintenance.archive(files(("p", "a.jsonl", "changed"), ("p", "b.jsonl", "3")), path)
    assert {(r.project, r.name, r.raw) for r in spark.read.parquet(path).collect()} == {("p", "a.jsonl", "1"), ("q", "a.jsonl", "2"), ("p", "b.jsonl", "3")}


def test_results_of_runs(spark, tmp_path):
    path = str(tmp_path / "results")
    per = spark.createDataFrame([(1, 1, 1.0), (2, 0, 0.5)], "query_id bigint, found int, ndcg double")
    evaluation.store_result(per, path, "one", {"k": "10"})
    evaluation.store_result(per, path, "two", {})
    rows = {r.run: r for r in spark.read.json(path).collect()}
    assert (rows["one"].queries, rows["one"].found_at_k, rows["one"].settings.k) == (2, 0.5, "10")
    assert set(rows) == {"one", "two"}


def test_readers_of_one_file_and_of_a_tail(spark, tmp_path):
    one = tmp_path / "aaaabbbb-cccc.jsonl"
    one.write_text('{"type":"user"}\n')
    assert [r.session_id for r in readers.transcript_file(spark, str(one)).collect()] == ["aaaabbbb"]
    with pytest.raises(ValueError, match="jsonl"):
        readers.transcript_file(spark, str(tmp_path / "x.txt"))
    log = tmp_path / "a.log"
    log.write_text("".join(f"line {i}\n\n" for i in range(500)))
    assert [r.line for r in readers.log_tail(spark, str(log), 3).collect()] == ["line 497", "line 498", "line 499"]
    (tmp_path / "logs").mkdir()
    for name in ("1.log", "2.log"):
        (tmp_path / "logs" / name).write_text(f"{name} a\n{name} b")
    assert [r.line for r in readers.log_tail(spark, str(tmp_path / "logs"), 3).collect()] == ["1.log b", "2.log a", "2.log b"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_percentiles_by_ranges(spark, fixed_partitions, partitions):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, rng.random() * 100])) for _ in range(700)] + [("c", 4.0), ("d", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    got = {r.g: (r.p50, r.p95) for r in evaluation.latency_percentiles(df, "v", (0.5, 0.95), "g").collect()}
    for g in ("a", "b", None, "c"):
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.95)))
    assert set(got) == {"a", "b", "c", None}
    every = [v for _, v in rows if v is not None and v == v]
    assert evaluation.latency_percentiles(df, "v").first().p95 == pytest.approx(np.quantile(every, 0.95))
    assert evaluation.latency_percentiles(df.limit(0), "v").first().p50 is None


def walked(events):
    """Runs of one log by a plain loop: (kind, start, complete, running, items)."""
    opened, out = {}, []
    for no, kind in events:
        for name in ("index", "enrich"):
            run = opened.get(name)
            if kind in (activity.START[name], "daemon_started"):
                if run:
                    run["running"] = kind != "daemon_started"
                    out.append(run)
                opened[name] = {"kind": name, "start": no, "complete": False, "running": True, "n": 0} if kind == activity.START[name] else None
            elif run and kind == activity.DONE[name]:
                out.append(run | {"complete": True, "running": False})
                opened[name] = None
            elif run and kind == activity.ITEM[name]:
                run["n"] += 1
    out += [r for r in opened.values() if r]
    return {(r["kind"], r["start"], r["complete"], r["running"], r["n"]) for r in out}


def test_runs_over_several_days(spark):
    """One log with all events, days apart or many on one day: as a plain loop says."""
    rng = random.Random(8)
    kinds = [*activity.START.values(), *activity.DONE.values(), *activity.ITEM.values(), *activity.ITEM.values(), "daemon_started", "other"]
    weights = [2, 2, 2, 2, 6, 6, 6, 6, 1, 1]
    at, events, rows = 1_700_000_000, [], []
    for no in range(600):
        at += rng.choice([1, 50, 40_000])
        kind = rng.choices(kinds, weights)[0]
        events.append((no, kind))
        rows.append((None, at, kind, no))
    df = spark.createDataFrame(rows, "log string, s bigint, type string, event_id int").withColumn("ts", F.timestamp_seconds("s"))
    runs = activity.run_groups(df)
    assert {(r.kind, r.start_no, r.complete, r.running, r.n_items) for r in runs.collect()} == walked(events)
    feed = activity.activity_feed(runs).collect()
    assert sum(r.n_runs for r in feed) == runs.count()
    ordered = sorted(feed, key=lambda r: r.no)
    idle = [(r.kind, r.n_items == 0 and not r.running) for r in ordered]
    assert not any(a == b and a[1] for a, b in zip(idle, idle[1:], strict=False))  # no empty neighbours are left
    assert activity.activity_feed(activity.run_groups(df.limit(0))).count() == 0


def test_stale_runs(spark):
    runs = spark.createDataFrame([("index", 0, True), ("index", 700, True), ("enrich", 0, True), ("enrich", 1280, True), ("index", 0, False)], "kind string, s bigint, running boolean").withColumn("start_ts", F.timestamp_seconds("s"))
    now = F.timestamp_seconds(F.lit(1300))
    assert [r.running for r in activity.close_stale(runs, now).collect()] == [False, True, False, True, False]
    assert [r.running for r in activity.close_stale(runs, now, enriching=True, indexing=True).collect()] == [True, True, True, True, False]


def test_vectors_by_way_of_a_cache(spark):
    asked = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "query_id bigint, query string")
    cache = spark.createDataFrame([], "query_hash string, embedding array<float>")
    got, cache = vectors.cached_vectors(asked, cache, vectors.hashed_embedding)
    assert {(r.query_id, r.hit) for r in got.collect()} == {(1, False), (2, False), (3, False)}
    assert cache.count() == 2
    again, whole = vectors.cached_vectors(asked, cache, lambda t, i, c: vectors.stub_embedding(t, i, 4))
    assert {(r.query_id, r.hit) for r in again.collect()} == {(1, True), (2, True), (3, True)}
    assert whole.count() == 2
    assert vectors.stub_embedding(asked, "query_id", 3).first().embedding == [1.0, 0.0, 0.0]


def test_summary_before_a_page(spark):
    lines = spark.createDataFrame([("s", 1, 0, "x"), ("t", 1, 0, "y")], "session_id string, line_no int, part_no bigint, line string")
    heads = spark.createDataFrame([("s", "a\n\n\n\nb"), ("u", "c")], "id string, header string")
    got = {(r.session_id, r.line_no): r.line for r in with_summaries(lines, heads).collect()}
    assert got == {("s", 1): "x", ("t", 1): "y", ("s", -2): "a\n\nb"}
