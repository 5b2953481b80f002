"""The registered queries of the event log, and the SQL that gives the same rows.

Every query runs over its whole tables. Arrays and payloads are flattened to
text; ordered reads carry ``seq``, their place in the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tag_hash import tag_hash_crc, tag_hash_v5
from .model import Query, QueryItem
from .operators import conditions as C
from .operators.fold import decision_model
from .operators.integrity import print_events
from .operators.read import head_of, keyset_pages, read, response_head, with_order
from .operators.tables import global_rank
from .operators.validate import validate
from .plans.access import tag_index
from .sources.tables import event_log, events_as_log

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]

FLAT = "position, event_type, array_to_string(tags, '|') AS tags, lower(hex(data)) AS data"
TENANT, DESK, WEB = "tenant:grenorpel", "channel:desk", "channel:web"
BERTH, CARGO, FARE = "BerthReserved", "CargoScanned", "FareQuoted"

ONE_TAG = Query([QueryItem(tags=[TENANT])])
TWO_TAGS = Query([QueryItem(tags=[TENANT, DESK])])
TYPES = Query([QueryItem(types=[BERTH, FARE])])
BOTH = Query([QueryItem(types=[BERTH, CARGO], tags=[TENANT])])
OR_ITEMS = Query([QueryItem([BERTH], [DESK]), QueryItem([FARE], [WEB])])
OVERLAP = Query([QueryItem(tags=[TENANT]), QueryItem([BERTH], [TENANT, WEB])])
INDEXED = Query([QueryItem([BERTH], [TENANT, DESK]), QueryItem([], ["audit:sample"]), QueryItem([CARGO, FARE], [WEB])])

SQL_ONE = f"list_contains(tags, '{TENANT}')"
SQL_TWO = f"list_has_all(tags, ['{TENANT}', '{DESK}'])"
SQL_BOTH = f"event_type IN ('{BERTH}', '{CARGO}') AND {SQL_ONE}"
SQL_OR = f"(event_type = '{BERTH}' AND list_contains(tags, '{DESK}')) OR (event_type = '{FARE}' AND list_contains(tags, '{WEB}'))"
SQL_INDEXED = (
    f"(event_type = '{BERTH}' AND {SQL_TWO}) OR list_contains(tags, 'audit:sample') OR (event_type IN ('{CARGO}', '{FARE}') AND list_contains(tags, '{WEB}'))"
)


def flat(df: DataFrame) -> DataFrame:
    extra = [c for c in ("seq", "page") if c in df.columns]
    return df.select(*extra, "position", "event_type", F.array_join("tags", "|").alias("tags"), F.lower(F.hex("data")).alias("data"))


def _reads() -> tuple[Queries, dict[str, str]]:
    q: Queries = {}
    sql: dict[str, str] = {}

    def add(name: str, query=None, where: str = "true", start=None, backwards=False, limit=None, index=False) -> None:
        def run(spark: SparkSession, d: str) -> DataFrame:
            log = event_log(spark, d)
            out = read(log, query, start, backwards, limit, tag_index(log) if index else None, ordered=False)
            return flat(with_order(out, backwards))

        order = "DESC" if backwards else "ASC"
        bound = "true" if start is None else f"position {'<=' if backwards else '>='} {start}"
        tail = "" if limit is None else f" ORDER BY position {order} LIMIT {limit}"
        q[name] = run
        sql[name] = (
            f"SELECT row_number() OVER (ORDER BY position {order}) AS seq, {FLAT} FROM "
            f"(SELECT * FROM sequenced_events WHERE ({where}) AND {bound}{tail})"
        )

    add("read_all_seq")
    add("read_all_backwards_seq", backwards=True)
    add("read_from_start", start=700)
    add("read_backwards_from_start", start=700, backwards=True)
    add("read_backwards_start_zero", start=0, backwards=True)
    add("read_limit_forward", ONE_TAG, SQL_ONE, start=100, limit=25)
    add("read_limit_backwards", ONE_TAG, SQL_ONE, start=900, backwards=True, limit=25)
    add("read_limit_zero", limit=0)
    add("point_lookup", where="position = 77", start=77, limit=1)
    add("read_types", TYPES, f"event_type IN ('{BERTH}', '{FARE}')")
    add("read_tag", ONE_TAG, SQL_ONE)
    add("read_tags_all", TWO_TAGS, SQL_TWO)
    add("read_types_and_tags", BOTH, SQL_BOTH)
    add("read_or_items", OR_ITEMS, SQL_OR)
    add("read_or_items_overlap_dedup", OVERLAP, SQL_ONE)
    add("read_empty_item", Query([QueryItem(tags=[TENANT]), QueryItem()]))
    add("read_empty_query", Query())
    add("read_index_path", INDEXED, SQL_INDEXED, index=True)
    return q, sql


def _index_equals_scan(spark: SparkSession, d: str) -> DataFrame:
    """Positions that only one of the two access paths finds; there are none."""
    log = event_log(spark, d)
    a = read(log, INDEXED, path="scan", ordered=False).select("position")
    b = read(log, INDEXED, path="index", index=tag_index(log), ordered=False).select("position")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def _heads() -> tuple[Queries, dict[str, str]]:
    def head_with(limit, backwards=False, query=ONE_TAG):
        def run(spark, d):
            log = event_log(spark, d)
            return response_head(log, read(log, query, None, backwards, limit), limit, backwards)

        return run

    q = {
        "head": lambda s, d: head_of(event_log(s, d)),
        "head_with_limit": head_with(10),
        "head_with_limit_backwards": head_with(10, True),
        "head_filtered_no_limit": head_with(None),
        "head_limit_zero": head_with(0),
    }
    one = f"SELECT position FROM sequenced_events WHERE {SQL_ONE} ORDER BY position"
    sql = {
        "head": "SELECT max(position) AS head FROM sequenced_events",
        "head_with_limit": f"SELECT max(position) AS head FROM ({one} LIMIT 10)",
        "head_with_limit_backwards": f"SELECT min(position) AS head FROM ({one} DESC LIMIT 10)",
        "head_filtered_no_limit": "SELECT max(position) AS head FROM sequenced_events",
        "head_limit_zero": "SELECT max(position) AS head FROM sequenced_events WHERE false",
    }
    return q, sql


UNNESTED = "(SELECT position, event_type, unnest(list_distinct(tags)) AS tag FROM sequenced_events)"


def _conditions_per_actor(spark: SparkSession, d: str, after: int | None) -> DataFrame:
    """A condition per distinct tag and type pair: fails if such an event is there (beyond ``after``)."""
    log = event_log(spark, d)
    c = log.select(F.explode(F.array_distinct("tags")).alias("tag"), "event_type").distinct()
    c = c.withColumn("after", F.lit(after).cast("bigint")).withColumn("req", F.concat_ws("/", "tag", "event_type"))
    out = C.check_conditions(log, c)
    return out.select("req", F.col("violated").cast("string").alias("violated"), "first_match")


def _conditions_sql(after: int | None) -> str:
    bound = "true" if after is None else f"position > {after}"
    return f"""
        WITH u AS {UNNESTED}
        SELECT concat_ws('/', tag, event_type) AS req, CASE WHEN count(*) FILTER (WHERE {bound}) > 0 THEN 'true' ELSE 'false' END AS violated,
               min(position) FILTER (WHERE {bound}) AS first_match
        FROM u GROUP BY tag, event_type"""


def _idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Retries of three events per tag, known by synthetic ids; each tag's second-last event has a wrong one."""
    log = event_log(spark, d)
    ids = F.md5(F.col("position").cast("string"))
    t = log.select(F.explode(F.array_distinct("tags")).alias("req"), "position", ids.alias("uuid"))
    from pyspark.sql.window import Window as W

    first = t.withColumn("rank", F.row_number().over(W.partitionBy("req").orderBy("position"))).filter("rank <= 3")
    sent = first.withColumn("uuid", F.when((F.col("rank") == 2) & (F.col("position") % 5 == 0), "other").otherwise(F.col("uuid")))
    return C.idempotent_matches(first, sent.select("req", "rank", "uuid"))


def _tracking_violations(spark: SparkSession, d: str) -> DataFrame:
    """Upstream records as they arrived: does each rise above its source's greatest position before it?"""
    from .sources.tables import table

    t = table(spark, d, "deliveries").filter("source is not null and position is not null").select("source", "position", F.col("delivery_id").alias("seq"))
    return C.assign_tracking(t).select("seq", "source", "position", F.col("violates").cast("string").alias("violates"))


def queries() -> Queries:
    reads, _ = _reads()
    heads, _ = _heads()
    return {
        **reads,
        "read_index_equals_scan": _index_equals_scan,
        **heads,
        "read_events_table": lambda s, d: flat(with_order(read(events_as_log(s, d), Query([QueryItem(["purchase"], ["user:7"]), QueryItem([], ["k:50"])]), ordered=False))),
        "tag_postings": lambda s, d: tag_index(event_log(s, d)),
        "tag_counts": lambda s, d: tag_index(event_log(s, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position")),
        "type_counts": lambda s, d: event_log(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last_position")),
        "condition_batch_snapshot": lambda s, d: _conditions_per_actor(s, d, None),
        "condition_after": lambda s, d: _conditions_per_actor(s, d, 600),
        "idempotent_match": _idempotent,
        "tracking_monotonic_violations": _tracking_violations,
        "assign_positions": lambda s, d: global_rank(event_log(s, d).select("event_type", F.col("position").alias("old")), [F.col("event_type"), F.col("old")], "position", start=1000),
        "validate_events": lambda s, d: validate(event_log(s, d), max_header_bytes=100).select("position", "error"),
        "tag_hash_v5": lambda s, d: tag_index(event_log(s, d)).select("tag").distinct().withColumn("hash", tag_hash_v5(F.col("tag"))),
        "tag_hash_legacy_crc": lambda s, d: tag_index(event_log(s, d)).select("tag").distinct().withColumn("hash", tag_hash_crc(F.col("tag"))),
        "keyset_pages": lambda s, d: flat(keyset_pages(read(event_log(s, d), ONE_TAG, ordered=False), 100)),
        "decision_model_fold": lambda s, d: decision_model(event_log(s, d), "tenant:"),
        "print_events": lambda s, d: print_events(event_log(s, d)),
    }


# CRC32 by its definition: eight steps of the reflected polynomial for each byte; a salt follows the tag for the second sum.
LEGACY_SQL = f"""
    WITH t AS (SELECT DISTINCT tag FROM {UNNESTED}),
    b AS (SELECT tag, regexp_extract_all(hex(encode(tag)), '..') AS hs FROM t),
    n AS (SELECT tag, [('0x' || x)::BIGINT FOR x IN hs] AS bytes FROM b),
    steps AS (SELECT i AS byte, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
    k AS (SELECT list(v ORDER BY byte) AS v FROM steps),
    s AS (SELECT tag, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, v[xor(c, x) % 256 + 1])), 4294967295) AS high,
            xor(list_reduce(list_prepend(4294967295, bytes || [158, 55, 121, 185]::BIGINT[]), lambda c, x: xor(c >> 8, v[xor(c, x) % 256 + 1])), 4294967295) AS low FROM n, k),
    d AS (SELECT tag, lpad(lower(hex(high)), 8, '0') || lpad(lower(hex(low)), 8, '0') AS h FROM s)
    SELECT tag, h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] || repeat('0', 16) AS hash FROM d"""


def oracle_sql() -> dict[str, str]:
    _, reads = _reads()
    _, heads = _heads()
    return {
        **reads,
        "read_index_equals_scan": "SELECT position FROM sequenced_events WHERE false",
        **heads,
        "read_events_table": """
            WITH l AS (SELECT event_id + 1 AS position, event_type, ['user:' || user_id, 'k:' || json_extract_string(props, '$.k')] AS tags, encode(props) AS data FROM events)
            SELECT row_number() OVER (ORDER BY position) AS seq, position, event_type, array_to_string(tags, '|') AS tags, lower(hex(data)) AS data
            FROM l WHERE (event_type = 'purchase' AND list_contains(tags, 'user:7')) OR list_contains(tags, 'k:50')""",
        "tag_postings": f"SELECT tag, position FROM {UNNESTED}",
        "tag_counts": f"SELECT tag, count(*) AS n, min(position) AS first_position, max(position) AS last_position FROM {UNNESTED} GROUP BY tag",
        "type_counts": "SELECT event_type, count(*) AS n, max(position) AS last_position FROM sequenced_events GROUP BY event_type",
        "condition_batch_snapshot": _conditions_sql(None),
        "condition_after": _conditions_sql(600),
        "idempotent_match": f"""
            WITH r AS (SELECT tag AS req, position, row_number() OVER (PARTITION BY tag ORDER BY position) AS k FROM {UNNESTED})
            SELECT req, max(position) AS position FROM r WHERE k <= 3 GROUP BY req HAVING count(*) FILTER (WHERE k = 2 AND position % 5 = 0) = 0""",
        "tracking_monotonic_violations": """
            SELECT seq, source, position, CASE WHEN position <= before THEN 'true' ELSE 'false' END AS violates FROM (
              SELECT delivery_id AS seq, source, position, max(position) OVER (PARTITION BY source ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM deliveries WHERE source IS NOT NULL AND position IS NOT NULL)""",
        "assign_positions": "SELECT event_type, position AS old, 1000 + row_number() OVER (ORDER BY event_type, position) AS position FROM sequenced_events",
        "validate_events": """
            SELECT position, CASE
              WHEN len(tags) > 65535 THEN 'too many tags' WHEN len(metadata) > 65535 THEN 'too many metadata entries'
              WHEN list_max([strlen(m.key) FOR m IN metadata]) > 65535 THEN 'metadata key too long'
              WHEN list_max([strlen(m.value) FOR m IN metadata]) > 65535 THEN 'metadata value too long'
              WHEN len(list_distinct([m.key FOR m IN metadata])) <> len(metadata) THEN 'a metadata key stands twice'
              WHEN strlen(event_type) + coalesce(list_sum([strlen(t) FOR t IN tags]), 0) > 100 THEN 'event too large' END AS error
            FROM sequenced_events""",
        "tag_hash_v5": f"""
            WITH t AS (SELECT DISTINCT tag FROM {UNNESTED}), h AS (SELECT tag, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(tag)) AS s FROM t)
            SELECT tag, s[1:12] || '5' || s[14:16] || CASE WHEN s[17] IN ('0','4','8','c') THEN '8' WHEN s[17] IN ('1','5','9','d') THEN '9' WHEN s[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || s[18:32] AS hash FROM h""",
        "keyset_pages": f"SELECT *, (seq - 1) // 100 AS page FROM (SELECT row_number() OVER (ORDER BY position) AS seq, {FLAT} FROM sequenced_events WHERE {SQL_ONE})",
        "decision_model_fold": f"""
            WITH u AS {UNNESTED}, c AS (SELECT tag, event_type, count(*) AS n, max(position) AS p FROM u WHERE starts_with(tag, 'tenant:') GROUP BY 1, 2)
            SELECT tag, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type, sum(n)::BIGINT AS events, max(p) AS last_position FROM c GROUP BY tag""",
        "tag_hash_legacy_crc": LEGACY_SQL,
        "print_events": "SELECT position, event_type, array_to_string(tags, '|') AS tags, uuid, octet_length(data)::BIGINT AS data_len, lower(hex(data)) AS data_hex FROM sequenced_events",
    }
