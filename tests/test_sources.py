"""Readers of transcripts, logs, notes and configurations; hand-over of micro-batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from threadlake.operators import maintenance
from threadlake.plans import gateway
from threadlake.sources import readers
from threadlake.streaming.activity import each_batch


def test_transcripts(spark, tmp_path):
    (tmp_path / "app" / "deep").mkdir(parents=True)
    (tmp_path / "01234567-89ab-cdef-0123-456789abcdef.jsonl").write_text('{"type":"user"}\n\n   \n{"type":"assistant"}\nnot json')
    (tmp_path / "app" / "aaaabbbb-cccc.jsonl").write_text('{"type":"user"}')
    (tmp_path / "app" / "deep" / "ffffffff.jsonl").write_text("{}")
    (tmp_path / "app" / "notes.txt").write_text("{}")
    files = readers.transcript_files(spark, str(tmp_path))
    assert {r.session_id for r in files.collect()} == {"01234567", "aaaabbbb"}
    lines = {(r.session_id, r.line_no) for r in readers.transcript_lines(files).collect()}
    assert lines == {("01234567", 1), ("01234567", 4), ("01234567", 5), ("aaaabbbb", 1)}

    rows = [(r.session_id, r.path, r.hash) for r in files.collect()]
    ms = 4_000_000_000_000  # indexed after every change
    indexed = spark.createDataFrame([(i, p, h, ms) for i, p, h in rows], "id string, path string, hash string, indexed_at bigint")
    assert readers.touched_files(files, indexed).count() == 0
    old = indexed.withColumn("indexed_at", F.lit(0).cast("bigint"))
    assert readers.touched_files(files, old).count() == 0  # touched, but the hash is the same
    assert readers.touched_files(files, old.withColumn("hash", F.lit("other"))).count() == 2
    assert readers.touched_files(files, indexed.limit(0)).count() == 2
    assert readers.touched_files(files, indexed, force=True).count() == 2


def test_activity_log(spark, tmp_path):
    path = str(tmp_path / "log")
    readers.append_activity(spark.createDataFrame([(i, "session_indexed", "{}") for i in range(5)], "ts bigint, type string, data string"), path)
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert [r.ts for r in readers.activity_log(spark, path, 3).collect()] == [4, 3, 2]


def test_vault_and_configs(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / "sub" / "note-0a1b2c3d.md").write_text("---\ntitle: x\n---\n" + "b" * 900)
    (tmp_path / "v" / "short-0a1b2c3e.md").write_text("---\ntitle: x\n---\nshort")
    (tmp_path / "v" / "unnamed.md").write_text("b" * 900)
    found = readers.markdown_vault(spark, str(tmp_path / "v")).collect()
    assert [(r.short_id, r.front, len(r.body)) for r in found] == [("0a1b2c3d", "title: x", 900)]
    (tmp_path / "c").mkdir()
    for name in ("b", "a"):
        (tmp_path / "c" / f"{name}.json").write_text(json.dumps({"name": name, "max": 5}))
    assert [r.name for r in readers.metric_configs(spark, str(tmp_path / "c")).collect()] == ["a", "b"]


def test_micro_batches_keep_the_newest_row(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, title string, at int").write.parquet(source)

    def take(batch, no):
        seen = spark.read.parquet(f"{target}/{no - 1}") if no else batch.limit(0)
        maintenance.last_wins(seen.unionByName(batch), ["id"], "at").write.mode("overwrite").parquet(f"{target}/{no}")

    def run():
        q = each_batch(spark.readStream.schema("id int, title string, at int").parquet(source), take, str(tmp_path / "ckpt"))
        q.awaitTermination()

    run()
    spark.createDataFrame([(2, "c", 2)], "id int, title string, at int").write.mode("append").parquet(source)
    run()
    assert {(r.id, r.title) for r in spark.read.parquet(f"{target}/1").collect()} == {(1, "a"), (2, "c")}


@pytest.mark.parametrize("sql", ["DELETE FROM x", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT 1; SELECT 2", "SELECT ';'", ""])
def test_gateway_takes_one_select_only(spark, sql):
    with pytest.raises(gateway.NotAllowed):
        gateway.run_select(spark, sql)
