"""The two-phase sink under tasks that fail, in a session of its own that runs failed tasks again."""

import json
import os
import subprocess
import sys
import textwrap

JOB = """
import json, os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tallyfold.sources import outbox as O

folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def accepts(batch):
    if any(r["name"] == "explode" for r in batch):
        raise RuntimeError("the network is down")
    mark = f"{folder}/failed-once"
    if TaskContext.get().partitionId() == 1 and any(r["id"] == 37 for r in batch) and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost once, after rows were written")
    return not any(r["id"] % 7 == 3 for r in batch)

spark.dataSource.register(O.outbox(accepts))
schema = "id long, campaign_id string, request_id string, name string"
rows = [(i, "c1", f"r{i // 10}", f"Shop é {i}") for i in range(40)]
put = lambda r: spark.createDataFrame(r, schema).coalesce(2).write.format("outbox").option("path", f"{folder}/out").option("batch", 4).mode("append").save()
put(spark.createDataFrame(rows, schema).collect())
first = O.committed(spark, f"{folder}/out", "sent", schema).count()
try:
    put([(100, "c1", "r9", "fine"), (101, "c1", "r9", "explode")])
    failed = False
except Exception:
    failed = True
put([])
put([(200, "c2", None, "late"), (206, "c2", None, "dead")])
sent = [tuple(r) for r in O.committed(spark, f"{folder}/out", "sent", schema).collect()]
dead = [(r.campaign_id, r.request_id, r.size, [json.loads(c)["id"] for c in r.contacts], r.timestamp[-1]) for r in O.committed(spark, f"{folder}/out", "dead", O.DEAD).collect()]
none = O.committed(spark, f"{folder}/nowhere", "sent", schema).count()
left = sum(len(f) for _, _, f in os.walk(f"{folder}/out/sent"))
print("RESULT" + json.dumps([first, failed, sorted(sent), sorted(dead), none, os.path.exists(f"{folder}/failed-once"), left]))
spark.stop()
"""


def test_each_contact_once(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(JOB), str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, check=False)
    told = [x for x in done.stdout.splitlines() if x.startswith("RESULT")]
    assert told, done.stderr[-2000:]
    first, failed, sent, dead, none, lost_once, left = json.loads(told[0][6:])
    good = [i for i in range(40) if i % 7 != 3]
    assert lost_once and failed and first == len(good)
    # each that was taken once, though a task wrote some of them twice; nothing of the job that failed
    assert [r[0] for r in sent] == [*good, 200]
    assert sorted(i for d in dead for i in d[3]) == [i for i in [*range(40), 206] if i % 7 == 3]
    assert all(d[2] == len(d[3]) and d[4] == "Z" for d in dead) and none == 0
    assert sent[1][1:] == ["c1", "r0", "Shop é 1"] and left >= 3
