"""Decision models: what a client folds from the events of its boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.access import tag_index


def decision_model(log: DataFrame, prefix: str) -> DataFrame:
    """Per tag that starts with ``prefix``: its events by type as ``type=n,...``, their number, the last position.

    Counts are aggregated per (tag, type) before tags meet, so a tag that most
    events carry is still a handful of rows per partition.
    """
    tags = log.select("position", "event_type", F.explode(F.array_distinct("tags")).alias("tag")).filter(F.col("tag").startswith(prefix))
    per = tags.groupBy("tag", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("p"))
    pairs = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    return (
        per.groupBy("tag")
        .agg(pairs.alias("pairs"), F.sum("n").alias("events"), F.max("p").alias("last_position"))
        .select("tag", F.array_join(F.transform("pairs", lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), ",").alias("by_type"), "events", "last_position")
    )
