import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicwise.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Build RAW records from (topic, partition, offset, ms, key, value, headers) tuples."""
    from pyspark.sql import functions as F

    from topicwise.schemas import RAW

    def build(*rows):
        fields = (
            "topic string, partition int, offset bigint, ms bigint, key binary, value binary, "
            "headers array<struct<key:string,value:binary>>"
        )
        df = spark.createDataFrame([(*r[:6], list(r[6])) for r in rows], fields)
        return df.select(
            "key",
            "value",
            "topic",
            "partition",
            "offset",
            F.timestamp_millis("ms").alias("timestamp"),
            F.lit(0).alias("timestampType"),
            "headers",
        ).select(*RAW.names)

    return build


@pytest.fixture(scope="session")
def records(raw):
    from topicwise.operators.decode import to_records

    return lambda *rows: to_records(raw(*rows), wire=False)
