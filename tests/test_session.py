from __future__ import annotations

import os
import subprocess
import sys
import time
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)

SCRIPT = """
import sys, pathlib
sys.path.insert(0, sys.argv[1])
from pairaudit.session import Materialized, checkpoint_dir, local_session
spark = local_session(2, 2, "1g", **{"spark.checkpoint.dir": "file://" + sys.argv[2]})
assert checkpoint_dir(spark) == "file://" + sys.argv[2], checkpoint_dir(spark)
store = Materialized(spark, "t")
a = store.write(spark.range(10))
b = store.write(a.filter("id > 4"))
assert b.count() == 5
store.drop(a)
assert b.count() == 5
assert len(list(pathlib.Path(sys.argv[2]).glob("pairaudit/*/*"))) == 1
"""


def test_the_named_folder_is_used_and_cleared(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, REPO, str(tmp_path)], capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert not list(tmp_path.glob("pairaudit/*"))


def test_importing_needs_no_session():
    code = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    run = subprocess.run([sys.executable, "-c", code, REPO], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]


def test_old_run_folders_are_swept(spark, tmp_path, monkeypatch):
    from pairaudit import session

    monkeypatch.setattr(session, "checkpoint_dir", lambda _: f"file://{tmp_path}")
    for name, age in (("old-1", 100), ("new-1", 1)):
        folder = tmp_path / "pairaudit" / name
        folder.mkdir(parents=True)
        (folder / "part").write_text("x")
        os.utime(folder, (time.time() - age * 3600,) * 2)
    assert session.sweep(spark) == 1
    assert [p.name for p in (tmp_path / "pairaudit").iterdir()] == ["new-1"]
