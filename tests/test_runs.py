"""Rows of a key together, small batches of results, and files that are rendered and read once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions.filters import decode_stream
from quirelake.functions.scan import objects_of
from quirelake.plans import corpus_queries
from quirelake.plans.render import literal

SF = "/root/testdata/sf0.001"


def test_by_key_gives_each_key_once(spark):
    from quirelake.operators.runs import by_key

    rows = spark.range(2000).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 700).cast("string")).alias("k"), "id")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    made = by_key(rows, "k", lambda group: [(group[0]["k"], sorted(r["id"] for r in group), b"x" * 30_000)], schema).select("k", "ids", F.length("data").alias("n")).collect()
    expected: dict = {}
    for i in range(2000):
        expected.setdefault(str(i % 700) if i % 7 else None, []).append(i)
    assert {r["k"]: r["ids"] for r in made} == expected and len(made) == len(expected) and {r["n"] for r in made} == {30_000}


def test_results_come_in_small_batches():
    from quirelake.functions.udfs import portions

    content = b"".join(b"%d 0 obj << /A 1 >> endobj\n" % i for i in range(2000))
    parts = list(portions(objects_of, pd.Series([content] * 40 + [None])))
    assert max(map(len, parts)) < 10 and sum(map(len, parts)) == 41 and len(parts[0][0]) == 2000
    column = pd.Series([bytes(100_000)] * 50)
    decoded = list(decode_stream.func(iter([(column, pd.Series([[]] * 50), pd.Series([[]] * 50))])))
    assert len(decoded) > 4 and sum(map(len, decoded)) == 50
    assert [len(x) for x in portions(len, pd.Series([], dtype=object))] == [0]


def test_maps_come_in_small_batches(spark):
    """A batch of maps of 500 codes each is given in parts; without rows, one empty part with all columns."""
    from quirelake.operators.text import parsed_cmap, parsed_map_batches

    data = b"1 beginbfchar\n" + b"".join(b"<%04x> <%04x>\n" % (i, i) for i in range(500)) + b"endbfchar"
    udf = parsed_cmap(F.lit(data))  # builds it
    assert spark.range(1).select(F.size(udf["codes"])).first()[0] == 500
    parts = list(parsed_map_batches(iter([pd.Series([data] * 400 + [None])])))
    assert max(map(len, parts)) < 50 and sum(map(len, parts)) == 401 and len(parts[0]["codes"][0]) == 500
    assert [(len(x), list(x.columns)) for x in parsed_map_batches(iter([pd.Series([], dtype=object)]))] == [(0, ["codes", "spaces", "warnings"])]


@pytest.mark.parametrize("name", ["literal_lines", "page_content_missing", "xobject_catalog", "resource_usage", "do_missing_xobject"])
def test_objects_are_read_once(spark, name):
    """Every leaf of the plan is the kept table of objects, so that no file is rendered or parsed twice."""
    leaves = corpus_queries.QUERIES[name](spark, SF)._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())} == {"InMemoryRelation"}


@pytest.mark.parametrize("name", ["recovery_modes", "warning_rollup", "page_kids_missing"])
def test_files_are_rendered_once(spark, name):
    """Leaves of the plan are kept tables and checkpoints."""
    leaves = corpus_queries.QUERIES[name](spark, SF)._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())} <= {"InMemoryRelation", "LogicalRDD"}


@pytest.mark.parametrize("name", ["mcid_first_operations", "text_run_widths"])
def test_operations_are_read_once(spark, name):
    """The steps that join a page's operations with themselves start from kept rows, not from its bytes."""
    leaves = corpus_queries.QUERIES[name](spark, SF)._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())} == {"LogicalRDD"}


def test_deep_references_take_one_pass(spark):
    """A chain of 3000 references with a way back and a short cut; a round a step would take thousands of jobs."""
    from quirelake.operators.graph import reachable

    links = [("a", f"n{i}", f"n{i + 1}") for i in range(3000)] + [("a", "n3000", "n0"), ("a", "n10", "n2000"), ("a", "x", "n5"), ("b", "n0", "n1")]
    got = reachable(spark.createDataFrame(links, "file_id string, src_id string, dst_id string"), spark.createDataFrame([("a", "n0")], "file_id string, object_id string")).collect()
    assert {(r["file_id"], r["object_id"], r["distance"]) for r in got} == {("a", f"n{i}", i if i < 2000 else i - 1989) for i in range(3001)}


def test_literal_strings():
    from quirelake.functions.syntax import string_of

    for data in (b"", b"a(b)c", b")(", b"((", b"\\(\r\n)", b"(()())("):
        assert string_of(literal(data)) == data
    assert literal(b"a(b)c") == "(a(b)c)" and literal(b")(") == "(\\051\\()"


def test_trees_of_many_files_stay_whole(spark):
    """All nodes of each of several files, which small inputs bring out of order."""
    import duckdb

    from quirelake.plans import structure_queries

    rows = structure_queries.struct_in_place(spark, SF).count()
    sql = structure_queries.ORACLE_SQL["struct_in_place"].replace("conversations", f"'{SF}/conversations.parquet'")
    assert rows == len(duckdb.sql(sql).fetchall())
