import pytest

import __spark_entry__
import rillflow.queries as core

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_twin(spark, name):
    same(spark, SF, core.QUERIES[name], core.ORACLE_SQL[name])


def test_declared_types_of_values_beyond_the_widened_type(spark, tmp_path):
    spark.sql("select 7L event_id, timestamp_ntz'2024-01-01' ts, u user_id, 'a' event_type, 1d value, '{}' props from values (200L), (300L), (33402L), (-1L) t(u)").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.big, r.small, r.fits) for r in core.declared_types(spark, str(tmp_path)).collect()}
    assert got == {("200", 200, True), ("300", 300, False), ("33402", None, False), ("-1", -1, False)}


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "body"] and df.count() > 0


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "rillflow", tmp_path / "rillflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(core.QUERIES)), str(len(core.ORACLE_SQL))], out.stderr
