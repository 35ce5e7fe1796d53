import functools

import duckdb
import pytest

from quirelake.operators.objects import definitions
from quirelake.plans import fixtures as fx
from quirelake.plans import queries as q

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,files", [("page_tree", "page_tree_files"), ("xref_entries", "xref_files")])
def test_small_blocks_give_the_same_result(spark, monkeypatch, name, files):
    made = []

    def in_blocks(*args, render=getattr(fx, files)):
        made.append(render(*args, block=25))
        return made[0]

    monkeypatch.setattr(fx, files, in_blocks)
    rows = getattr(q, name)(spark, PATH).collect()
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    want = con.execute(q.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(want.fetchall())
    assert made[0].count() > 50


def test_revisions_repeat_objects(spark):
    orders = fx.table(spark, PATH, "orders")
    assert definitions(fx.revision_files(orders)).count() == orders.count()


def test_pages_of_bounded_events(spark):
    pages = fx.operator_pages(fx.table(spark, PATH, "events"), 500)
    assert pages.selectExpr("max(size(split(decode(content, 'ISO-8859-1'), '\\n')))").first()[0] <= 500 and pages.groupBy("file_id").count().agg({"count": "max"}).first()[0] > 1
