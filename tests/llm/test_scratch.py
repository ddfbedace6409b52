"""Scratch tables go with their block, results with the application, stage tables with the next stage."""

import os
import subprocess
import sys

from helixframe.llm.common import Scratch
from helixframe.shared import shared_dir

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{folder}").config("spark.sql.shuffle.partitions", "4").config("spark.sql.warehouse.dir", "file://{folder}/warehouse").getOrCreate()
import os
import corpus_pipeline, sys
kept = []
real = corpus_pipeline.Scratch.keep
def keep(self, df, *by):
    found = real(self, df, *by)
    if "corpus_pipeline" in sys._getframe(1).f_code.co_filename:
        kept.append(self.paths[-1].removeprefix("file://"))
        assert sum(os.path.exists(p) for p in kept) <= 2
    return found
corpus_pipeline.Scratch.keep = keep
assert corpus_pipeline.run(spark, "{sf}").count() > 0
assert len(kept) == 4 and not any(map(os.path.exists, kept))
spark.stop()
"""


def files_below(folder):
    return [name for _, _, names in os.walk(folder) for name in names]


def test_a_block_leaves_nothing(spark):
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    with Scratch(spark) as scratch:
        before = set(files_below(folder))
        kept, ordered = scratch.keep(spark.range(9)), scratch.keep_sorted(spark.range(9), "id")
        result = scratch.result(kept.join(ordered, "id"))
        assert set(files_below(folder)) - before
    assert result.count() == 9
    assert all(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in result.inputFiles())
    assert scratch.paths == [] and scratch.names == []


def test_the_pipeline_leaves_nothing(tmp_path, sf_dir):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", CODE.format(folder=tmp_path, sf=sf_dir)], cwd=repo, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert files_below(tmp_path) == []
