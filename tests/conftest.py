from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["SPARK_CHECKPOINT_DIR"] = str(tmp_path_factory.mktemp("shared"))
    from bench import local_session

    session = local_session(4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Value of a column expression over one row of the given columns."""

    def run(expression, **columns):
        from pyspark.sql import functions as F

        df = spark.range(1)
        for name, v in columns.items():
            if isinstance(v, tuple):
                v, dtype = v
                df = df.withColumn(name, F.lit(v).cast(dtype) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast(dtype))
            elif isinstance(v, list):
                df = df.withColumn(name, F.array(*[F.lit(x) for x in v]).cast("array<string>"))
            else:
                df = df.withColumn(name, F.lit(v))
        got = df.select(expression.alias("v")).first()["v"]
        return got.asDict(recursive=True) if hasattr(got, "asDict") else got

    return run
