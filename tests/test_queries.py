"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gristmill.plans import registry
from tests.conftest import same_rows


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def text(v):
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_like_sql(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    q = db.execute(registry.ORACLE[name])
    order = [x[0] for x in q.description]
    assert cols == sorted(order)
    want = sorted(tuple(text(r[order.index(c)]) for c in cols) for r in q.fetchall())
    assert sorted(tuple(text(r[c]) for c in cols) for r in df.collect()) == want


def test_all_have_a_name_once():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_entry_point_needs_no_session():
    import pathlib
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parent.parent, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-2]) >= len(registry.QUERIES)


def test_snippets_of_all_hits(spark, tmp_path):
    t = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    t([("r", "a", 5, "KafkaListener"), ("r", "a", 5, "Get"), ("r", "a", 1, "Get"), ("r", "gone", 1, "Get"), ("r", "a", None, "Get")], "root string, file string, line int, reference_name string", "raw_facts")
    t([("r", "a", i, None if i == 3 else f"t{i}") for i in (9, 8, 7, 6, 5, 4, 3, 2, 1, 2)], "root string, file string, line int, text string", "source_lines")
    got = registry.QUERIES["snippet_text"](spark, str(tmp_path)).collect()
    want = [("r", "a", 5, 7, 2, 8, "t2\n\nt4\nt5\nt6\nt7\nt8"), ("r", "a", 1, 4, 1, 4, "t1\nt2\n\nt4"), ("r", "gone", 1, 0, None, None, None), ("r", "a", None, 0, None, None, None)]
    same_rows(got, want)
