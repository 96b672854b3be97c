import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,4,1500]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
spark = spark.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, {sf!r}).count(), flush=True)
"""
#: Queries that send functions, arrays or dictionaries of this package to executors.
NAMES = ["op1_token_files", "op10_suffix_index", "op12_spelling_variants", "op13_token_alignment", "pipeline"]


def test_executors_need_no_copy_of_the_package(sf, tmp_path):
    """Drivers put the repository on their own path only; executors run in another folder, without it."""
    script = SCRIPT.format(repo=REPO, sf=sf, names=NAMES)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.split() and line.split()[0] in NAMES)
    assert list(counts) == NAMES and all(int(n) > 0 for n in counts.values())
