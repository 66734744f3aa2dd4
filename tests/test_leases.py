"""Folders of intermediate tables: kept while their run lives, swept when it is dead, gone when it ends."""

import os
import subprocess
import sys
import time

from orrery.sources import leases, workdir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(path):
    return sorted(p for p in os.listdir(path) if p.startswith(leases.PREFIX))


def test_a_dead_runs_folder_goes_after_its_lease_a_live_ones_never(spark, tmp_path):
    root = f"file://{tmp_path}"
    dead, live = leases.Lease(spark, root, 50), leases.Lease(spark, root, 0.6)
    dead._over.set()  # no more signs of life
    spark.range(5).write.parquet(f"{dead.path}/t")
    assert leases.sweep(spark, root) == [] and len(names(tmp_path)) == 2
    time.sleep(1.5)  # longer than the live one's lease: its thread renews it
    assert leases.sweep(spark, root) == []
    gone = leases.sweep(spark, root, os.path.getmtime(dead.path.removeprefix("file://")) + 60)
    assert dead.path.rpartition("/")[2] in gone and not os.path.exists(dead.path.removeprefix("file://"))
    live = leases.Lease(spark, root, 50)
    (tmp_path / "run-without").mkdir()
    (tmp_path / "someone-elses").mkdir()
    assert leases.sweep(spark, root, time.time() + 2 * leases.SECONDS).count("run-without") == 1
    live.release()
    assert os.path.exists(tmp_path / "someone-elses") and names(tmp_path) == []


def test_nothing_is_left_after_a_run(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from orrery.plans import registry
from orrery.sources import workdir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert registry.queries()["ob3_three_axis_search"](spark, "/root/testdata/sf0.001").count()
spark.range(3).write.parquet(workdir.fresh(spark, "kept"))
import os
print("held", sum(p.startswith("run-") for p in os.listdir({str(tmp_path)!r})))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert "held 1" in out.stdout
    assert names(tmp_path) == []  # Spark makes an empty folder of its own


def test_paths_are_below_the_runs_folder(spark):
    a, b = workdir.fresh(spark, "x"), workdir.fresh(spark, "x")
    assert a != b and a.rpartition("/")[0] == b.rpartition("/")[0] and f"/{leases.PREFIX}" in a
