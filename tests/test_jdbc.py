"""Events through a database: written by the JDBC sink, read back whole and in ranges of a key."""

import pytest
from pyspark.sql import functions as F
from test_audit import events

from auditloom.sources.sinks import JdbcSink, read_jdbc

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def database(spark, tmp_path):
    """An embedded database that comes with Spark."""
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(DRIVER)
    except Exception:
        pytest.skip("no embedded database on the class path")
    return f"jdbc:derby:{tmp_path}/db"


def test_jdbc_round_trip(spark, database):
    sink = JdbcSink(f"{database};create=true", "audit", createTableColumnTypes="id VARCHAR(64), app_id VARCHAR(64)")
    columns = ["id", "app_id", "timestamp", "action", "category", "metadata", "number"]
    numbered = events(spark, 50, app_id="app1").withColumn("number", F.get_json_object("metadata", "$.i").cast("long")).select(*columns)
    for low, high in ((0, 20), (20, 50)):
        sink.write(numbered.where(F.col("number").between(low, high - 1)))
    whole = read_jdbc(spark, database, "audit").toDF(*columns)
    assert sorted(whole.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).collect()) == sorted(numbered.collect())
    ranged = read_jdbc(spark, database, "audit", key="number", low=0, high=50, parts=5)
    assert ranged.rdd.getNumPartitions() == 5 and ranged.count() == 50
    assert ranged.groupBy(F.spark_partition_id()).count().count() == 5
    picked = whole.where("number >= 45")
    assert picked.count() == 5 and "number" in picked._jdf.queryExecution().executedPlan().toString().split("PushedFilters", 1)[1]
