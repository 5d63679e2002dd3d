from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(frame) -> list[tuple]:
    """The rows of an Arrow table or a pandas frame, columns by name, in a comparable form and order.

    In an Arrow table NaN is told from null; pandas knows no difference.
    """
    import pandas as pd
    import pyarrow as pa

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, float):
            return ("NaN" if arrow else "null") if v != v else f"{v:.9g}"
        return str(v)

    arrow = isinstance(frame, pa.Table)
    names = sorted(frame.column_names if arrow else frame.columns)
    rows = zip(*[frame.column(c).to_pylist() for c in names], strict=True) if arrow else frame[names].itertuples(index=False, name=None)
    return sorted(tuple(cell(v) for v in row) for row in rows)


def duck(sql: str, folder: str, arrow: bool = False):
    """Run SQL over the tables of a folder, to pandas or to Arrow."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.sql(sql).to_arrow_table() if arrow else con.sql(sql).df()
