"""Alert rules: an event raises each rule whose set fields all equal the event's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("severity", "category", "action", "outcome")
#: Rules up to this number are broadcast; of more, Spark chooses the join.
MOST_BROADCAST = 10_000


def alert_matches(events: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per event and rule that it raises: the event with rule_id. rules: rule_id and the four fields, '' for any."""
    named = rules.select("rule_id", *(F.col(c).alias(f"rule_{c}") for c in FIELDS))
    few = named.limit(MOST_BROADCAST + 1).collect()  # one job; rules are few, or Spark joins them as they are
    small = len(few) <= MOST_BROADCAST
    if small:
        named = rules.sparkSession.createDataFrame(few, named.schema)
    hit = F.lit(True)
    for c in FIELDS:
        hit = hit & ((F.col(f"rule_{c}") == "") | (F.col(f"rule_{c}") == F.col(c)))
    # an equi-join: a rule has the key of its set fields, an event a key for each combination that rules set
    rule_mask = sum((F.when(F.col(f"rule_{c}") != "", 1 << i).otherwise(0) for i, c in enumerate(FIELDS)), F.lit(0))
    if small:
        masks = sorted({sum(1 << i for i, c in enumerate(FIELDS) if r[f"rule_{c}"] != "") for r in few})
    else:
        masks = sorted(r[0] for r in named.select(rule_mask.alias("m")).distinct().collect())  # at most 16
    if not masks:
        return events.limit(0).select(F.lit(None).cast(rules.schema["rule_id"].dataType).alias("rule_id"), *events.columns)
    key = lambda prefix, mask: F.concat_ws("|", F.lit(str(mask)), *(F.col(f"{prefix}{c}") for i, c in enumerate(FIELDS) if mask >> i & 1))
    keyed_rules = named.withColumn("mask", rule_mask).withColumn("key", F.coalesce(*(F.when(F.col("mask") == m, key("rule_", m)) for m in masks)))
    keyed = events.withColumn("key", F.explode(F.array(*(key("", m) for m in masks))))
    if small:
        keyed_rules = F.broadcast(keyed_rules)
    return keyed.join(keyed_rules, "key").where(hit).select("rule_id", *events.columns)
