"""The driver's contract: the entry module with and without the corpus operators, and the bench's output."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LISTED = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"


def listed(top: Path) -> tuple[list[str], list[str]]:
    done = subprocess.run([sys.executable, "-B", "-c", LISTED], cwd=top, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
    rows = {x.split()[0]: x.split()[1:] for x in done.stdout.splitlines() if x.startswith(("NAMES", "SQL"))}
    return rows["NAMES"], rows["SQL"]


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_without_corpus_operators(tmp_path, with_pipeline):
    """Both folders gone, with or without the pipeline's module beside them: the other queries are still there."""
    from confab.plans import QUERIES, SQL

    top = tmp_path / "repo"
    shutil.copytree(ROOT, top, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"])))
    assert listed(top) == (sorted(QUERIES), sorted(SQL))


def test_bench(spark, monkeypatch, capsys):
    import __spark_entry__ as entry
    import bench

    assert bench.selected({"op10_b": 1, "optional_param_set": 1, "op2_a": 1, "join_bridge": 1, "pipeline": 1}) == ["join_bridge", "op2_a", "op10_b"]
    found = entry.queries()
    monkeypatch.setattr(entry, "queries", lambda: {n: found[n] for n in (*bench.HEADLINE, "optional_param_set")})
    monkeypatch.setattr(bench, "get_session", lambda *a, **b: spark)
    monkeypatch.setattr(spark, "stop", lambda: None, raising=False)
    monkeypatch.setenv("BENCH_SF_DIR", "/root/testdata/sf0.001")
    bench.main()
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["sf"] == "0.001" and list(said["queries"]) == bench.HEADLINE and said["value"] > 0
