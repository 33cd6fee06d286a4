import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sigsight.session import get_spark

    s = get_spark("local[4]", app="sigsight-tests", shuffle_partitions=4,
                  extra={"spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def one_col(spark, values, expr, name="v", schema="v string"):
    """Evaluate a column expression over a list of single values, preserving order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col(name))).collect()]
