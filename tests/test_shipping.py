"""Executors get the library from the entry, whatever their working folder and path."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_by_path", {entry!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
import pyarrow as pa
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
entry.queries()["profile_lookup"](spark, {sf!r}).collect()

def found(batches):
    import matchday.functions.casts as m
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([m.__file__])], ["f"])
print("FOUND", spark.range(1).mapInArrow(found, "f string").first().f)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_from_another_folder(tmp_path):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(entry=entry, sf=SF)], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=300)
    assert "FOUND" in out.stdout and "matchday-code.zip" in out.stdout, out.stderr[-2000:]
