"""Workers can import the package from any working directory."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
from tabulon.llm.simhash import simhash_components
print("rows", simhash_components(df).count())
"""


def test_operators_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy without the llm folders and corpus_pipeline.py still lists the other queries."""
    import shutil
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = f"import sys; sys.path.insert(0, {str(copy)!r}); import __spark_entry__ as E; q = E.queries(); print(len(q), [n for n in q if n.startswith('op')], 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
                          capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("[] False"), done.stderr[-2000:]
