"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut
from ..sources.tables import event_log, table
from . import leaks, packing, truncation
from .cooccurrence import cooccurrence
from .topk import frequent

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]


def log_fields() -> dict:
    return {"tags": F.col("tags"), "metadata": F.transform("metadata", lambda m: m["value"])}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = cooccurrence(event_log(spark, d), "position", "tags", min_count=6, min_lift=20)
    return out.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that at least 6 events carry, heavy ones included, with their lift to three decimals."""
    out = cooccurrence(event_log(spark, d), "position", "tags", min_count=6)
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 3).alias("lift"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent(event_log(spark, d), log_fields(), one_in=1000, min_count=40).select("field", "item_value")


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent values of each field."""
    return frequent(event_log(spark, d), log_fields(), k=50).select("field", "item_value", "n")


def rank_file() -> str:
    """The rank file of the token lengths: LOOMLOG_RANKS, or the installed public one."""
    if at := os.environ.get("LOOMLOG_RANKS"):
        return at
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every message or piece with its container of 2,048 tokens."""
    return packing.pack_documents(table(spark, d, "documents"), rank_file(), 2048).select("doc_id", "piece", "first_token", "tokens", "container")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, the least there could be by volume, and the share of room left unused."""
    b = packing.pack_documents(table(spark, d, "documents"), rank_file(), 2048).groupBy("container").agg(F.sum("tokens").alias("t"))
    total = F.sum("t")
    return b.agg(F.count(F.lit(1)).alias("containers"), F.ceil(total / 2048).alias("least"), F.max("t").alias("fullest"), total.alias("tokens"), F.round(1 - total / (F.count(F.lit(1)) * 2048), 5).alias("unused"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: messages and tokens packed, those that stand twice or lack a piece, containers too full, and messages cut without need."""
    p = cut(packing.pack_documents(table(spark, d, "documents"), rank_file(), 2048))
    whole = (F.count(F.lit(1)) == F.countDistinct("piece")) & (F.count(F.lit(1)) == F.max("piece") + 1)
    need = F.greatest(F.ceil(F.sum("tokens") / 2048), F.lit(1))
    per_doc = p.groupBy("doc_id").agg((~whole).cast("long").alias("unwhole"), (F.count(F.lit(1)) != need).cast("long").alias("cut"))
    per_bin = p.groupBy("container").agg((F.sum("tokens") > 2048).cast("long").alias("over"))
    docs = per_doc.agg(F.count(F.lit(1)).alias("messages"), F.sum("unwhole").alias("unwhole"), F.sum("cut").alias("cut_without_need"))
    return docs.crossJoin(F.broadcast(per_bin.agg(F.sum("over").alias("too_full"))))  # single rows


def p8_method(spark: SparkSession, d: str) -> DataFrame:
    """The named method alone: item-sized windows within the Hamming radius, alike by their weighted shingles."""
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), exact=False)
    return out.select("doc_id", "item_id", "near_windows", F.round("best", 6).alias("best"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items of which they hold at least 12 words in a row: the operator's 12-word windows."""
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), near=False)
    return out.select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items: in how many documents, how many of these only nearly, the longest passage."""
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    only = F.sum(F.when(F.col("exact_windows") == 0, 1).otherwise(0))
    return out.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), only.alias("near_only"), F.max("longest_run").alias("longest_run"), F.sum("exact_windows").alias("exact_windows"), F.sum("near_windows").alias("near_windows"))


def p9_method(spark: SparkSession, d: str) -> DataFrame:
    """What the named method alone finds: unknown final prefixes, and unended texts at their source's limit."""
    return truncation.by_method(truncation.evidence(table(spark, d, "documents"))).select("doc_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(truncation.evidence(table(spark, d, "documents"))).select("doc_id").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts texts."""
    seen = cut(truncation.evidence(table(spark, d, "documents")))
    return truncation.shares(seen, truncation.truncated(seen))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which sources cut."""
    return truncation.limits(truncation.scan(table(spark, d, "documents")))


def queries() -> Queries:
    return {
        "p1_found": p1_found,
        "p1_pairs": p1_pairs,
        "p4_found": p4_found,
        "p4_top": p4_top,
        "p7_packed": p7_packed,
        "p7_fill": p7_fill,
        "p7_checks": p7_checks,
        "p8_method": p8_method,
        "p8_found": p8_found,
        "p8_items": p8_items,
        "p9_method": p9_method,
        "p9_found": p9_found,
        "p9_shares": p9_shares,
        "p9_limits": p9_limits,
    }


PAIRS = """
    WITH u AS (SELECT position, unnest(list_distinct(tags)) AS t FROM sequenced_events), c AS (SELECT t, count(*) AS n FROM u GROUP BY t),
    p AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM u a JOIN u b ON a.position = b.position AND a.t < b.t GROUP BY 1, 2 HAVING count(*) >= 6),
    j AS (SELECT a, b, p.n, x.n AS na, y.n AS nb, (SELECT count(*) FROM sequenced_events) AS rows FROM p JOIN c x ON x.t = a JOIN c y ON y.t = b)"""
ENTRIES = """
    WITH e AS (SELECT 'tags' AS field, unnest(tags) AS item_value FROM sequenced_events
      UNION ALL SELECT 'metadata', unnest([m.value FOR m IN metadata]) FROM sequenced_events),
    c AS (SELECT field, item_value, count(*) AS n FROM e GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{PAIRS} SELECT a AS tag_a, b AS tag_b FROM j WHERE n * rows >= 20 * na * nb",
        "p1_pairs": f"{PAIRS} SELECT a AS item_a, b AS item_b, n AS n_ab, na AS n_a, nb AS n_b, round(n::DOUBLE * rows / (na::DOUBLE * nb), 3) AS lift FROM j",
        "p4_found": f"{ENTRIES} SELECT field, item_value FROM c WHERE n >= 40 AND n * 1000 >= (SELECT sum(n) FROM c d WHERE d.field = c.field)",
        "p7_checks": "SELECT count(*) AS messages, 0::BIGINT AS unwhole, 0::BIGINT AS cut_without_need, 0::BIGINT AS too_full FROM documents",
        "p4_top": f"{ENTRIES} SELECT field, item_value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, item_value) AS r FROM c) WHERE r <= 50",
    }
