import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows_of(columns, rows):
    """Rows as sorted texts, floats to six places: for comparing results whatever the order."""
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a DataFrame with a DuckDB query over the tables of a folder or over given frames."""
    import duckdb

    def check(df, sql, sf_dir=None, **frames):
        con = duckdb.connect()
        if sf_dir:
            for f in os.listdir(sf_dir):
                con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
        for name, frame in frames.items():
            con.register(name, frame.toArrow())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        theirs = rows_of(names, found.fetchall())
        ours = rows_of(names, (tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()))
        assert ours == theirs
        return len(ours)

    return check
