"""Workers that cannot import the library run every fitted model all the same."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

# The library is on the driver's path alone: set in the process, in no variable, and the
# workers start in another folder.
JOB = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from stagecraft.llm import bm25_decon, ecoc_lang, pii_crf

spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())

def finds_library(batches):
    import importlib.util
    for batch in batches:
        yield type(batch).from_pydict({{"found": [importlib.util.find_spec("stagecraft") is not None]}})

assert not any(r.found for r in spark.range(2).mapInArrow(finds_library, "found boolean").collect())

words = " ".join(f"word{{i}}" for i in range(40))
docs = spark.createDataFrame(
    [(1, "write to ann@example.org today", "en"), (2, "guten tag und danke", "de"),
     (3, "good day and thanks", "en"), (4, words, "en"), (5, None, None)],
    "doc_id bigint, text string, lang string")
bench = spark.createDataFrame([(7, words)], "item_id bigint, text string")
found = {{r.doc_id: r.n_email for r in pii_crf.find(docs, pii_crf.train()).collect()}}
assert found == {{1: 1, 2: 0, 3: 0, 4: 0, 5: 0}}, found
assert "<EMAIL>" in pii_crf.mask(docs, pii_crf.train()).where("doc_id = 1").first().text
model = ecoc_lang.fit(docs)
langs = {{r.doc_id: r.lang_pred for r in ecoc_lang.identify(docs, model).collect()}}
assert langs[2] == "de" and langs[3] == "en" and langs[5] == "und", langs
assert ecoc_lang.keep_identified(docs, model).count() == 4
hits = [(r.doc_id, r.item_id) for r in bm25_decon.contaminated(docs, bench).collect()]
assert hits == [(4, 7)], hits
assert bm25_decon.drop_contaminated(docs, bench).where("doc_id = 4").count() == 0
print("all found")
"""


def test_models_reach_workers_that_lack_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    job = tmp_path / "job.py"
    job.write_text(JOB)
    run = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, text=True,
                         capture_output=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    assert "all found" in run.stdout
