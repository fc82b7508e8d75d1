"""One session for all tests, and comparison of results as bags of rows."""

import math
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{shared}/checkpoint", "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def bag(names, rows):
    """Rows as a bag, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql():
    import duckdb

    def check(df, sql, sf_dir=SMALL):
        db = duckdb.connect()
        for f in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        want = db.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        got = bag(df.columns, map(tuple, df.collect()))
        want = bag(want.columns, want.fetchall())
        assert got == want, f"only here: {list((got - want).items())[:3]}; only in SQL: {list((want - got).items())[:3]}"
        return sum(got.values())

    return check
