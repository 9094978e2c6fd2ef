import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from perilscope.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame from column lists, over several partitions."""

    def build(partitions=3, types=None, **columns):
        types = types or {}
        arrays = {n: pa.array(v, types.get(n)) for n, v in columns.items()}
        return spark.createDataFrame(pa.table(arrays)).repartition(partitions)

    return build


@pytest.fixture
def one(frame):
    """Values of an expression on a single text column, in the order of the input."""

    def run(make, values, kind=None):
        df = frame(i=list(range(len(values))), t=values, types={"t": kind} if kind else None)
        return [r["v"] for r in df.select("i", make("t").alias("v")).orderBy("i").collect()]

    return run
