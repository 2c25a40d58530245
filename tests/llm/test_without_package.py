"""All operators on executors that have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"
REPO = str(Path(__file__).resolve().parent.parent.parent)
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def importable(_):
    import importlib.util
    return [importlib.util.find_spec("tracewell") is not None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
for name, build in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, len(build(spark, {sf!r}).collect()), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
def test_every_operator_in_a_fresh_process(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=REPO, sf=SF_DIR))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    names = dict(line.split() for line in done.stdout.splitlines())
    assert len(names) == 14 and all(int(n) for n in names.values())
