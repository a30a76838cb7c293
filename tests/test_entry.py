import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_imports_without_a_session():
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=REPO, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) >= 60


def test_works_without_the_llm_folders(tmp_path):
    """Everything else still imports when the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and e.llm is None; print(len(e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) >= 60


def test_other_missing_modules_are_told(tmp_path):
    """Only the absence of the subpackage is passed over, not that of something it needs."""
    import shutil

    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (tmp_path / "r" / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert run.returncode != 0 and "no_such_module_at_all" in run.stderr


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from loomline.sources import shared

    none = SimpleNamespace(getOrElse=lambda x: x, isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://somewhere:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
