import pytest

from oracle import connect, same
from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"mantel_perm_p", "bootstrap_pair_ci", "loso_confusion", "loso_group_scores"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW - {"hourly_events"}))
def test_matches_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SF), duck.sql(catalogue.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["test_gender_residual", "mcnemar_test", "lmm_neural", "lmm_pooled", "rope_lmm", "variance_components", "pca_points"])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_points_without_the_optional_part(tmp_path):
    """Without the two folders and the pipeline the rest imports; a broken optional module is not passed over."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run().returncode == 0, run().stderr
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr


def test_entry_points():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
