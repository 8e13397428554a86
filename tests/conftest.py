from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(data).glob("*.parquet")):
        source = path if path.is_file() else path / "*.parquet"
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return connection


def _cell(v):
    if v is None or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="session")
def same(duck):
    """Holds the rows of a frame against those of a SQL text, in any order."""

    def check(frame, sql: str) -> int:
        names = sorted(frame.columns)
        ours = sorted([_cell(r[c]) for c in names] for r in frame.collect())
        cursor = duck.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        theirs = sorted([_cell(r[i]) for i in order] for r in cursor.fetchall())
        assert len(ours) == len(theirs)
        assert ours == theirs
        return len(ours)

    return check
