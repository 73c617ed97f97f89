"""The entry module with the training-data folders and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
COUNT = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q);"
         " print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)")


def counted(folder) -> list[str]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy_of(folder, *left_out: str) -> Path:
    wanted = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "*.json", "*.txt")
    skipped = [ROOT / path for path in left_out]

    def ignore(at, names):
        return set(wanted(at, names)) | {n for n in names if Path(at, n) in skipped}

    return Path(shutil.copytree(ROOT, folder / "copy", ignore=ignore))


def test_core_alone(tmp_path):
    """Without the training-data folders, with and without the pipeline file, all core queries load."""
    from chronotext.plans import load

    core = str(len(load()[0]))
    gone = ("chronotext/llm", "tests/llm")
    assert counted(copy_of(tmp_path / "a", *gone)) == [core, "0", "False"]
    assert counted(copy_of(tmp_path / "b", *gone, "corpus_pipeline.py")) == [core, "0", "False"]


def test_whole(tmp_path):
    if not (ROOT / "chronotext" / "llm").is_dir():
        return
    every, numbered, pipeline = counted(copy_of(tmp_path))
    assert int(numbered) >= 10 and pipeline == "True" and int(every) > int(numbered)
