import os
import subprocess
import sys

CODE = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as e
from wheelgraph import storage
for name, query in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert query(spark, {sf!r}).count() > 0, name
root = storage.root(spark)
assert root.startswith({start!r}), root
at = root.removeprefix("file://")
assert len(os.listdir(at)) > 5
print("ROOT", at)
storage.clear(spark)
assert os.listdir(at) == []
query(spark, {sf!r}).count()
"""


def run(sf, tmp_path, start):
    """The training-data queries in a session of their own; its folder is gone when the process has ended."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": f"{repo}:{os.environ.get('PYTHONPATH', '')}", "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE.format(sf=sf, start=start)], env=env, cwd=repo, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    at = next(x for x in done.stdout.splitlines() if x.startswith("ROOT")).split()[1]
    assert not os.path.exists(at)


def test_queries_need_no_setting_on_a_local_master(sf, tmp_path):
    run(sf, tmp_path, "file:///")


def test_a_folder_without_a_scheme_is_on_the_default_file_system(spark, tmp_path, monkeypatch):
    """A plain path gets the scheme of Hadoop's default; here a view that only Hadoop can open."""
    from wheelgraph import storage

    class Conf:
        def get(self, name, default=None):
            return "/data" if name == "spark.checkpoint.dir" else default

    class Session:
        sparkContext, _jvm, _jsparkSession, conf = spark.sparkContext, spark._jvm, spark._jsparkSession, Conf()

    shared = spark.sparkContext._jsc.hadoopConfiguration()
    old = shared.get("fs.defaultFS")
    monkeypatch.setattr(storage, "_roots", {})
    try:
        shared.set("fs.viewfs.mounttable.shared.link./data", f"file://{tmp_path}")
        shared.set("fs.defaultFS", "viewfs://shared/")
        assert storage.root(Session()).startswith("viewfs://shared/data/wheelgraph-")
        assert list(tmp_path.iterdir())
    finally:
        shared.set("fs.defaultFS", old)
