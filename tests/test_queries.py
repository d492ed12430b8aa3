"""Every registered engine query against its DuckDB equivalent, and that each one does something."""

import pytest
from gistmill.plans import catalog

NO_SQL = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(name, spark, sf, same_as_sql):
    assert same_as_sql(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf) > 0


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(name, spark, sf):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows


def test_whole_results_drop_something(spark, sf):
    from pyspark.sql import functions as F

    for name in ("conversation_compress", "iterative_prose", "model_prose", "compress_tool_output", "json_compress", "segment_compress"):
        df = catalog.QUERIES[name](spark, sf)
        assert df.where(F.expr("dropped <> ''") if name != "segment_compress" else F.size("dropped") > 0).count() > 0, name
        assert df.where("tokensAfter > tokensBefore OR compressed IS NULL").isEmpty(), name


def test_types_of_all_kinds_occur(spark, sf):
    found = {(r["src"], r["type"]) for r in catalog.detect_type_counts(spark, sf).collect()}
    assert {("pages", "html"), ("logs", "logs"), ("search", "search"), ("diff", "diff"), ("code", "code"), ("rendered", "conversation"), ("documents", "text")} <= found


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 50
    assert df.where("type <> 'html' OR tokens_after >= tokens_before").isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
