import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gridlake.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "8"), 8, "8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import oracle

    return oracle.connect(SF)


@pytest.fixture
def raster(spark):
    """(array, image_id) → long pixel table with rows and cols."""
    def make(values, name="v", image_id=0):
        rows = [(image_id, r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
        df = spark.createDataFrame(rows, f"image_id long, row int, col int, {name} double")
        from pyspark.sql import functions as F

        return df.withColumns({"rows": F.lit(len(values)), "cols": F.lit(len(values[0]))})

    return make


@pytest.fixture
def dense():
    """Long table back to a list of lists."""
    def make(df, name, rows, cols, default=0.0):
        out = [[default] * cols for _ in range(rows)]
        for r in df.collect():
            out[r["row"]][r["col"]] = r[name]
        return out

    return make
