"""Registered queries of the general data operators, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import delivered_once as D
from .operators import drift, incremental, skew
from .operators.tables import session_path
from .queries import Queries
from .sources.tables import event_log, table


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return D.surplus(table(spark, d, "deliveries"), D.delivery_identifiers(), "delivery_id")


def p2_method(spark: SparkSession, d: str) -> DataFrame:
    """The named method alone: one aggregation by each delivery's own identifier, min_by over (arrival, id)."""
    t = table(spark, d, "deliveries").select("delivery_id", "batch_id", "received_at", "source", "position", "uuid")
    return D.keep_one(t, D.own_identifier(), ["received_at", "delivery_id"]).select("delivery_id", "batch_id")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """One delivery of each event: the whole group by any identifier, then the first to arrive."""
    t = table(spark, d, "deliveries")
    groups = D.first_copies(t, D.delivery_identifiers(), "delivery_id")
    j = t.select("delivery_id", "batch_id", "received_at").join(groups, "delivery_id", "left")
    one = D.keep_one(j, F.coalesce("first_id", "delivery_id"), ["received_at", "delivery_id"])
    return one.select("delivery_id", "batch_id")


def p2_by_uuid(spark: SparkSession, d: str) -> DataFrame:
    """One delivery per uuid, the first to arrive; those without one all stay."""
    t = table(spark, d, "deliveries").select("delivery_id", "batch_id", "received_at", "source", "position", "uuid")
    return D.keep_one(t, D.uuid_digits(F.col("uuid")), ["received_at", "delivery_id"]).select("delivery_id", "batch_id", "source", "position")


def p3_method(spark: SparkSession, d: str) -> DataFrame:
    """The named method with a written ledger: three runs, each over the batches there by then; what each of them took."""
    inc = incremental.replay(table(spark, d, "deliveries"), session_path(spark), 3)
    parts = [spark.read.parquet(p).withColumn("run", F.lit(k + 1).cast("bigint")) for k, p in enumerate(inc.results())]
    return reduce(DataFrame.unionByName, parts).select("source", "position", "version", "run")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unprocessed(table(spark, d, "deliveries"), table(spark, d, "tracking_runs")).select("source", "position")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(event_log(spark, d), _tasks(spark)).select("field", "item_value")


def p5_key_results(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_results(event_log(spark, d), _tasks(spark)).select("field", "item_value", "n", "last_position")


def p5_gap_join(spark: SparkSession, d: str) -> DataFrame:
    """Per key: how far, on average and at most, its events lie behind its last one; each event meets its key's row."""
    x = skew.log_keys(event_log(spark, d))
    keys, tasks = ["field", "item_value"], _tasks(spark)
    p = skew.plan(x, keys, tasks)
    side = skew.balanced_aggregate(x, keys, ["position"], {"__p": F.max("position")}, {"last_position": F.max("__p")}, tasks, p).drop("shards")
    j = skew.balanced_join(x, side, keys, ["position"], tasks, p=p)
    return j.groupBy(*keys).agg(F.sum(F.col("last_position") - F.col("position")).alias("behind"), F.max(F.col("last_position") - F.col("position")).alias("most_behind"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(event_log(spark, d), table(spark, d, "log_segments"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All events with their typed fields under canonical names, as sorted ``name=value`` text; second values of a name beside them."""
    u = drift.unified(event_log(spark, d), table(spark, d, "log_segments"))
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    more = F.transform("conflicts", lambda e: F.concat(e["field"], F.lit("<"), e["raw"], F.lit("="), e["value"].cast("string")))
    text = [F.array_join(pairs, "\n").alias("fields"), F.array_join(more, "\n").alias("conflicts")]
    return u.select("position", "segment_id", "event_type", *text, F.col("unread").cast("string").alias("unread"))


def p6_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Where events hold several values under one canonical name."""
    return drift.conflicts(drift.unified(event_log(spark, d), table(spark, d, "log_segments")))


def queries() -> Queries:
    return {
        "p2_method": p2_method,
        "p2_found": p2_found,
        "p2_kept": p2_kept,
        "p2_by_uuid": p2_by_uuid,
        "p3_method": p3_method,
        "p3_found": p3_found,
        "p5_found": p5_found,
        "p5_key_results": p5_key_results,
        "p5_gap_join": p5_gap_join,
        "p6_found": p6_found,
        "p6_table": p6_table,
        "p6_conflicts": p6_conflicts,
    }


IDENTIFIED = r"""
    b AS (SELECT *, regexp_replace(regexp_replace(lower(trim(uuid)), '^(urn:)?(uuid:)?', ''), '[\s{}()\[\]<>"''-]', '', 'g') AS bare FROM deliveries),
    i AS (SELECT delivery_id, batch_id, received_at, source, position,
            CASE WHEN regexp_full_match(bare, '[0-9a-f]{32}') AND bare <> repeat('0', 32) THEN bare END AS u,
            CASE WHEN source IS NOT NULL AND position IS NOT NULL THEN position || ':' || source END AS s FROM b)"""
LINKED = f"""
    WITH RECURSIVE {IDENTIFIED},
    e AS (SELECT DISTINCT a.delivery_id AS x, b.first AS y FROM i a JOIN (SELECT u, min(delivery_id) AS first FROM i WHERE u IS NOT NULL GROUP BY u) b ON a.u = b.u
          UNION SELECT DISTINCT a.delivery_id, b.first FROM i a JOIN (SELECT s, min(delivery_id) AS first FROM i WHERE s IS NOT NULL GROUP BY s) b ON a.s = b.s),
    links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r AS (SELECT delivery_id AS x, delivery_id AS m FROM i UNION SELECT links.y, r.m FROM r JOIN links ON links.x = r.x WHERE r.m < links.y),
    g AS (SELECT x AS delivery_id, min(m) AS first_id FROM r GROUP BY x)"""
KEYS = """k AS (SELECT 'event_type' AS field, event_type AS item_value, position FROM sequenced_events
    UNION ALL SELECT 'tags', unnest(list_distinct(tags)), position FROM sequenced_events)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{LINKED} SELECT delivery_id FROM g WHERE delivery_id <> first_id",
        "p2_kept": f"""{LINKED}
            SELECT delivery_id, batch_id FROM (SELECT i.delivery_id, batch_id, row_number() OVER (PARTITION BY first_id ORDER BY received_at, i.delivery_id) AS k
            FROM i JOIN g ON g.delivery_id = i.delivery_id) WHERE k = 1""",
        "p2_method": f"""WITH {IDENTIFIED}
            SELECT delivery_id, batch_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(u, s) ORDER BY received_at, delivery_id) AS k FROM i) WHERE coalesce(u, s) IS NULL OR k = 1""",
        "p2_by_uuid": f"""WITH {IDENTIFIED}
            SELECT delivery_id, batch_id, source, position FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY received_at, delivery_id) AS k FROM i) WHERE u IS NULL OR k = 1""",
        "p3_method": f"""
            WITH b AS (SELECT min(batch_id) AS a, max(batch_id) AS z FROM deliveries),
            r AS ({" UNION ALL ".join(f"SELECT {k} AS run, source, position, min(received_at) AS version FROM deliveries, b WHERE source IS NOT NULL AND position IS NOT NULL AND batch_id <= a + (z - a) * {k} // 3 GROUP BY 2, 3" for k in (1, 2, 3))})
            SELECT source, position, version, min(run)::BIGINT AS run FROM r GROUP BY 1, 2, 3""",
        "p3_found": """
            WITH p AS (SELECT source, position, min(received_at) AS version FROM deliveries WHERE source IS NOT NULL AND position IS NOT NULL GROUP BY 1, 2)
            SELECT source, position FROM p WHERE NOT EXISTS (SELECT 1 FROM tracking_runs r WHERE r.source = p.source AND r.outcome = 'committed'
              AND r.position >= p.position AND r.started_at >= p.version)""",
        "p5_found": f"""WITH {KEYS} SELECT field, item_value FROM k GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM sequenced_events)""",
        "p5_key_results": f"WITH {KEYS} SELECT field, item_value, count(*) AS n, max(position) AS last_position FROM k GROUP BY 1, 2",
        "p5_gap_join": f"""WITH {KEYS} SELECT field, item_value, (count(*) * max(position) - sum(position))::BIGINT AS behind, max(position) - min(position) AS most_behind FROM k GROUP BY 1, 2""",
    }
