import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "4g")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a Column function on literal rows: ``apply(fn, rows, names)`` -> list of results."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType, StructField, StructType

    def run(fn, rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        schema = StructType([StructField(n, StringType()) for n in names])
        df = spark.createDataFrame(rows, schema).coalesce(1)
        return [r[0] for r in df.select(fn(*[F.col(n) for n in names]).alias("o")).collect()]

    return run
