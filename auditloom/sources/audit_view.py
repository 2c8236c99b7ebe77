"""The driver's event stream as audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What each remainder of event_id by 16 stands for.
DEEDS = """(VALUES (0,'login','session','auth'),(1,'logout','session','auth'),(2,'access.grant','role','access'),(3,'access.revoke','role','access'),
 (4,'read','record','data'),(5,'write','record','data'),(6,'delete','record','data'),(7,'purge','record','data'),
 (8,'update','settings','config'),(9,'deploy','service','deployment'),(10,'decision','model','ai'),(11,'prediction','model','ai'),
 (12,'review','model','ai'),(13,'override','model','ai'),(14,'training','model','ml'),(15,'alarm','firewall','security')) AS d(k,action,resource,category)"""

VIEW = """SELECT concat('audit_', lpad(cast(event_id AS {text}), 26, '0')) AS id, ts AS timestamp,
 concat('app', user_id % 2) AS app_id, concat('t', user_id % 7) AS tenant_id, concat('u', user_id) AS user_id,
 concat('10.0.', user_id % 8, '.', event_id % 250) AS ip, d.action, d.resource, d.category,
 concat('r-', event_id % 97) AS resource_id, {metadata} AS metadata,
 CASE WHEN event_type='error' THEN 'failure' WHEN event_id % 13 = 0 THEN 'denied' ELSE 'success' END AS outcome,
 CASE WHEN value >= 150 THEN 'critical' WHEN value >= 75 THEN 'warning' ELSE 'info' END AS severity,
 CASE WHEN event_type='error' THEN 'upstream error' ELSE '' END AS reason,
 CASE WHEN event_id % 5 = 0 THEN concat('subj-', user_id % 20) ELSE '' END AS subject_id
FROM {events} e JOIN """ + DEEDS + " ON d.k = e.event_id % 16"

#: For DuckDB.
SQL = VIEW.format(text="VARCHAR", metadata="CAST(json(props) AS VARCHAR)", events="events")


def audit_view(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """The 15 columns of audit events that the driver's events give, batch or stream. The 16 deeds are a constant table."""
    return spark.sql(VIEW.format(text="STRING", metadata="to_json(parse_json(props))", events="{raw}"), raw=raw)


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_view(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
