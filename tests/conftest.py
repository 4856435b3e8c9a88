import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """make(rows, ddl): a small table; text is cast to the declared types."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from terrace.session import small_table

    def build(rows, ddl):
        schema = T.StructType.fromDDL(ddl)
        texts = [tuple(None if v is None else str(v) for v in r) for r in rows]
        raw = small_table(spark, texts, ", ".join(f"{f.name} string" for f in schema))
        return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    return build


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted([tuple(r) for r in picked.collect()], key=str)
