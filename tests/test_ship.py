"""Workers find the package without any setting of the user's."""

import subprocess
import sys
import zipfile
from pathlib import Path

from gridshuttle.ship import zipped

ROOT = Path(__file__).resolve().parent.parent


def test_zip(tmp_path):
    with zipfile.ZipFile(zipped(str(ROOT / "gridshuttle"), str(tmp_path))) as z:
        names = z.namelist()
    assert "gridshuttle/__init__.py" in names and "gridshuttle/plans/plan.py" in names and all(n.endswith(".py") for n in names)


def test_from_another_folder(tmp_path):
    """Only the driver knows the path; workers still run our code."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from gridshuttle import Execute, Executor, PlanC2C
from gridshuttle.sources.grids import random_grid
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("POINTS", PlanC2C((4, 3), 2, executor=Executor.NUMPY).execute(random_grid(s, (4, 3)), Execute.FORWARD).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "POINTS 12" in out.stdout, out.stderr[-2000:]
