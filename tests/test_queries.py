"""Every registered query against its SQL, on the smallest tables."""

import os
import subprocess
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path.insert(0, os.path.join(ROOT, "tools"))

import duckdb  # noqa: E402
from check_queries import TABLES, rows_of  # noqa: E402

from callscope.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    found = frame.collect()
    if name not in ORACLES:
        assert found
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, found) == rows_of(columns, result.fetchall())


def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tasks_carry_the_package(tmp_path):
    """Python workers started elsewhere do not see the package on their path."""
    script = (
        f"import sys; sys.path.insert(0, {os.path.abspath(ROOT)!r})\n"
        "from callscope.queries import QUERIES\nfrom callscope.session import local_session\n"
        f"spark = local_session(2, 2)\nfor n in ('model_enrich', 'asr_diff', 'map_model', 'quality_job'):\n    assert QUERIES[n](spark, {FOLDER!r}).count() > 0\n"
        f"assert sum(map(len, QUERIES['model_enrich'](spark, {FOLDER!r}).collect())) > 0\n"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.parametrize("name", ["call_batch_model", "model_enrich", "model_ledger"])
def test_personal_data_changes_no_answer(spark, tmp_path, name):
    """A redacted text has another length than its original, by which the stand-in models judge."""
    texts = ["call 13912345678 " + "x" * n for n in (7, 8, 378, 380, 383, 500)] + ["id 110101199001011234 " + "y" * n for n in (5, 6, 377, 379, 500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = QUERIES[name](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())
