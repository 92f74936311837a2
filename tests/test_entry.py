"""The driver's entry module, with and without the corpus part."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_corpus_part(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lotwise", tmp_path / "lotwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) >= 49


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lotwise", tmp_path / "lotwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_module" in out.stderr


def test_dashboard_queries_keep_their_partitions_small(spark):
    """A partition that AQE puts together must fit a task's sort; the corpus keeps Spark's size."""
    import __spark_entry__ as entry
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(key)
    before = spark.conf.get(key)
    try:
        registered = entry.queries()
        registered["op3_url_filter"](spark, entry.SMOKE_DIR)
        assert spark.conf.get(key) == before
        registered["snapshot_dealer_activity"](spark, entry.SMOKE_DIR)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key)
