"""Stages that follow their inputs, scopes that leave nothing behind, and the entry without its optional part."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from simplexspark.sources import cut, materialise, stage_scope


def test_a_changed_input_rebuilds(spark, tmp_path):
    source, stage, calls = str(tmp_path / "in"), str(tmp_path / "stage"), []
    spark.range(5).write.parquet(source)

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    def rows(**more):
        return materialise(spark, stage, build, inputs=[source], **more).count()

    assert rows() == 5 and rows() == 5 and len(calls) == 1
    spark.range(3).write.mode("append").parquet(source)
    assert rows() == 8 and rows() == 8 and len(calls) == 2
    assert rows(version="2") == 8 and len(calls) == 3
    os.remove(os.path.join(stage, "_inputs"))
    assert rows(version="2") == 8 and len(calls) == 4
    assert materialise(spark, stage, build).count() == 8 and len(calls) == 4
    empty = str(tmp_path / "none")
    os.mkdir(empty)
    assert materialise(spark, str(tmp_path / "s2"), lambda: spark.range(0), inputs=[empty]).count() == 0


def test_a_closed_scope_leaves_nothing(spark):
    with stage_scope(spark) as outer:
        kept = cut(spark.range(4), "outer")
        with stage_scope(spark) as inner:
            doubled = cut(spark.range(9).withColumn("k", F.col("id") % 2), "inner", ["k"])
            assert doubled.count() == 9 and len(inner) == 1 and os.path.isdir(inner[0])
        assert not os.path.exists(inner[0]) and kept.count() == 4
    assert len(outer) == 1 and not os.path.exists(outer[0])
    with pytest.raises(ValueError), stage_scope(spark) as failed:
        cut(spark.range(2))
        raise ValueError("lost")
    assert len(failed) == 1 and not os.path.exists(failed[0])
    assert os.path.isdir(cut(spark.range(2)).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])


def entry_with(blocked):
    """Number of queries when a module cannot be found, or the error."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r}:
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
q = __spark_entry__.queries()
print(len(q), "pipeline" in q)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)


def test_entry_without_the_subpackage_and_without_its_needs():
    gone = entry_with("simplexspark.llm")
    assert gone.returncode == 0 and gone.stdout.split()[1] == "False" and int(gone.stdout.split()[0]) > 100
    assert entry_with("corpus_pipeline").stdout.split()[1] == "False"
    if os.path.isdir(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "simplexspark", "llm")):
        broken = entry_with("public_tokenizers")
        assert broken.returncode != 0 and "public_tokenizers" in broken.stderr
