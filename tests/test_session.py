"""Shared folders, staged tables and their removal, the registry without the subpackage, streams over both table forms."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from threadlake.plans import reference_queries, report_queries
from threadlake.session import Staging, in_tasks, is_folder, shared_dir, staged


def test_no_shared_folder_is_refused_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            shared_dir(SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master)))


def test_staged_tables_are_removed(spark):
    with Staging(spark) as owner:
        df = staged(spark.range(10).withColumn("x", F.rand(1)), "some")
        path = owner.paths[0].removeprefix("file://")
        assert df.count() == 10
        assert os.path.isdir(path)
        with Staging(spark):
            staged(spark.range(3), "inner")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_fixed_tasks(spark):
    assert in_tasks(spark.range(100), 7, "id").groupBy("id").count().rdd.getNumPartitions() == 7


STREAMS = {n: f for q in (reference_queries, report_queries) for n, f in q.QUERIES.items() if n.startswith("stream_")}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_streams_read_files_and_folders(spark, same_as_sql, tmp_path, name):
    """A table of many files gives the same rows as one of a single file."""
    d = "/root/testdata/sf0.001"
    spark.read.parquet(f"{d}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert is_folder(spark, f"{tmp_path}/events.parquet")
    assert not is_folder(spark, f"{d}/events.parquet")
    with Staging(spark):
        one, many = ({tuple(r) for r in STREAMS[name](spark, x).collect()} for x in (d, str(tmp_path)))
    assert one
    assert one == many


def test_only_a_missing_subpackage_is_passed_over(tmp_path):
    """A module that is missing inside the subpackage stops the registry instead of dropping its queries."""
    (tmp_path / "threadlake").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == sys.argv[1]: raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; print(len(e.queries()))\n"
    )

    def run(missing: str):
        return subprocess.run([sys.executable, "-c", code, missing], cwd=root, capture_output=True, text=True, timeout=120)

    assert int(run("threadlake." + "llm").stdout) > 50
    assert run("threadlake." + "llm.queries" if os.path.isdir(f"{root}/threadlake/" + "llm") else "threadlake.plans.gateway").returncode != 0
