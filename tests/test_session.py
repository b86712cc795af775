"""The shared folder: named, left out in local mode, left out on a cluster."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from framewright import session

ROOT = Path(__file__).resolve().parent.parent

PLAIN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
"""


def on_a_plain_session(tmp_path, code: str) -> None:
    """Runs code in a process whose Spark has no configuration but its own defaults."""
    import os

    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_CONF", "PYSPARK_SUBMIT"))} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    subprocess.run([sys.executable, "-c", PLAIN + code], check=True, env=env, cwd=tmp_path, timeout=300)


def named(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert session.shared_folder(named("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_folder(named("local[4]")) == session.shared_folder(named("local"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(named(master))


def test_tables_are_written_on_a_plain_session(tmp_path):
    on_a_plain_session(tmp_path, """
from framewright.session import work_folder, written
assert written(spark.range(5), "t").count() == 5 and work_folder(spark, "a") != work_folder(spark, "a")
""")
