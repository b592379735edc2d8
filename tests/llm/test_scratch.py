"""Tables in the shared folder: few processes started for them, and damage that is found."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinpane.llm.common import drop_tables, stored

JOB = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from twinpane.llm.common import drop_tables, stored
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
rows = spark.range(1000).withColumn("t", F.lit("x")).repartition(4)
rows.write.parquet(sys.argv[2] + "/probe")  # Hadoop's default
open(sys.argv[2] + "/started", "a").write("from here on\\n")
held = stored(rows, "some")
assert held.agg(F.sum("id"), F.min("t")).first() == (499500, "x")
drop_tables(spark, held)
"""


def test_stored_starts_fewer_processes(tmp_path):
    tool = tmp_path / "bin/chmod"
    tool.parent.mkdir()
    tool.write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/started\nexec /bin/chmod "$@"\n')
    tool.chmod(0o755)
    (tmp_path / "shared").mkdir()
    env = os.environ | {"PATH": f"{tool.parent}:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}  # a JVM of its own
    subprocess.run([sys.executable, "-c", JOB, str(tmp_path / "shared"), str(tmp_path)], env=env, check=True, timeout=300)
    before, after = ([x for x in part.splitlines() if "attempt_" in x] for part in (tmp_path / "started").read_text().split("from here on\n"))
    assert len(before) == 3 * 4  # by task: a folder, a file, its checksums
    assert len(after) == 2 * 4
    assert list((tmp_path / "shared/twinpane").iterdir()) == []


def test_stored_finds_damage(spark):
    held = stored(spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1), "damaged", "uncompressed")
    assert held.agg(F.max(F.length("t"))).first()[0] == 64
    (file,) = (Path(x.removeprefix("file://")) for x in held.inputFiles())
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        held.agg(F.max("t")).first()
    drop_tables(spark, held)
