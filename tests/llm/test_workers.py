import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from stratalake.llm import decontam, secrets, urls
docs = spark.createDataFrame([(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "s")], "doc_id long, text string, source string")
item = spark.createDataFrame([(1, "token 04dbebab91ab85687d33eeaaf9ac699e1188f962")], "item_id long, text string")
pages = spark.createDataFrame([(i, f"http://a{{i % 3}}.net/x") for i in range(9)] + [(10, "http://b.org/fr/y"), (11, "http://b.de/")], "page_id long, url string")
print(secrets.scan(docs).count(), decontam.decontamination(docs, item).first().n_hit, urls.filter_urls(pages).count())
bad = spark.range(1).mapInArrow(lambda it: (b for b in it if __import__("stratalake")), "id long")
try:
    bad.count()
    print("the workers have the package")
except Exception:
    print("the workers lack the package")
print(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
"""


def test_workers_need_no_package_and_the_session_keeps_its_settings(tmp_path):
    code = RUN.format(repo=str(REPO), shared=f"file://{tmp_path}/shared")
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    (tmp_path / "cwd").mkdir()
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "cwd", env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split("\n")[:3] == ["1 2 11", "the workers lack the package", "10000"], out.stderr[-2000:]
