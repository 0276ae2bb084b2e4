import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # spark.checkpoint.dir comes from the environment's defaults when set;
    # viewlens.session.work_dir makes a temporary one only where it is unset.
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("viewlens-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *cols):
    """Collected rows as tuples (all columns unless named)."""
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def same_rows(a, b) -> bool:
    """Order-insensitive equality of two DataFrames (NaN equals NaN)."""
    from oracle.compare import compare
    cols = a.columns
    diff = compare(cols, [tuple(r) for r in a.collect()], b.columns, [tuple(r) for r in b.select(*cols).collect()])
    assert diff is None, diff
    return True
