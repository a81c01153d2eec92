import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def plan_of(df):
    """The physical plan as text, with what each node takes in."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchanged(df):
    """Names of all columns that some exchange of a plan carries."""
    nodes = re.findall(r"^\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan_of(df), re.MULTILINE)
    return {name for node in nodes for name in re.findall(r"(\w+)#\d+", node)}
