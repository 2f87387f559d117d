"""Queries against their SQL on rows that the test tables of the small sizes lack."""

import os

import pytest

from quillstream.plans import registry
from test_queries import SF, plain

#: Words that go on with a letter that isn't ASCII's, texts that begin with a number longer than a time.
TEXTS = ["Des les elleévi çoivi\nles elle. la", "94.182.225.142 Oring thedo\n10.15.231.17 thenne and on", "94.182.225 Kars"]


@pytest.mark.parametrize("name", ["false_friends", "title_hygiene", "headline_stream", "upsert_cycles", "upsert_merge"])
def test_odd_rows(spark, tmp_path, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    rows = [(i, TEXTS[i // 4 % len(TEXTS)], "en", f"src{i % 2}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()[name](spark, str(tmp_path))
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.execute(registry.oracle_sql()[name]).fetchall()
    order = [got.columns.index(d[0]) for d in con.description]
    assert sorted(repr(plain([r[i] for i in order])) for r in got.collect()) == sorted(repr(plain(t)) for t in theirs)
