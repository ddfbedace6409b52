"""Tables in the shared folder are gone when the application is."""

import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{folder}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from helixframe.operators import rounds
from helixframe.shared import drop, keep, keep_at
import os
assert keep(spark.range(5)).count() == 5
table, path = keep_at(spark.range(5))
drop(spark, path)
assert not os.path.exists(path.removeprefix("file://"))
held, rules = rounds.build_spread(spark.createDataFrame([(1, "ACACACGTGTAAAA")], "seq_id long, dna string"))
assert held.count() == 1 and rules.count() > 1
assert os.listdir("{folder}")
spark.stop()
"""


def test_nothing_is_left_when_the_application_ends(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE.format(folder=tmp_path)], cwd=repo, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [name for _, _, names in os.walk(tmp_path) for name in names] == []  # Spark leaves an empty folder of its own
