"""Written cuts hold for the driver's life and go with it."""

import os
import subprocess
import sys
import time
from pathlib import Path

SCRIPT = """
import sys
import time
from lattica.session import build_session, written
spark = build_session("cuts", 1, 1, **{"spark.checkpoint.dir": "file://" + sys.argv[1], "driver_memory": "1g"})
cut = written(spark.range(5), "cut")
print("rows", cut.count())
if sys.argv[2] == "stop":
    spark.stop()
"""


def run(folder: Path, end: str) -> str:
    root = str(Path(__file__).resolve().parent.parent)
    return subprocess.run([sys.executable, "-c", SCRIPT, str(folder), end], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120, check=True).stdout


def test_cuts_go_with_the_driver(tmp_path):
    for end in ("stop", "exit"):
        folder = tmp_path / end
        folder.mkdir()
        assert "rows 5" in run(folder, end)
        for _ in range(50):
            if not list(folder.glob("cut-*")):
                break
            time.sleep(0.2)
        assert not list(folder.glob("cut-*"))


def test_executors_rest(spark):
    """Garbage is collected where tasks run, and batches are small unless the session says otherwise."""
    from lattica.session import BATCH_ROWS, rest_executors, small_batches

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    runs = lambda: sum(b.getCollectionCount() for b in beans)
    before = runs()
    rest_executors(spark)
    assert runs() > before
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for given, then in (("10000", str(BATCH_ROWS)), ("77", "77")):
            spark.conf.set(rows, given)
            small_batches(spark)
            assert spark.conf.get(rows) == then
    finally:
        spark.conf.unset(rows)
