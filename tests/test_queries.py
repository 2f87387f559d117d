"""Every registered query of the monitoring operators against its SQL, and the entry's guard."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from quillstream.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    theirs = duck.execute(registry.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in columns]
    assert sorted(repr(plain([r[i] for i in order])) for r in rows) == sorted(repr(plain(t)) for t in theirs)


def test_entry_works_without_the_corpus_operators(tmp_path):
    (tmp_path / "quillstream").mkdir()
    for p in (ROOT / "quillstream").iterdir():
        if p.name != "llm":
            (tmp_path / "quillstream" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'daily_summary' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
