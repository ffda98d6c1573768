"""Queries on readers, writers, look-ups and models of the caller, over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidelta.functions.html import html_text
from evidelta.operators import enrichment, verify, windows
from evidelta.plans.evidence import TOP, claim_pairs, sources
from evidelta.plans.runs import latest_runs
from evidelta.session import load, shared_dir, ship_package, spread
from evidelta.sources import jsonl


def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The latest candidate run written as JSON lines and read as a run again: its fields, and the state of ``exists``."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    run = latest_runs(spark, sf)[1].select("case_id", "support", "authority", "world_change", "world_change_reason")
    jsonl.write(run, path)
    back = jsonl.read_run(spark, path)
    return back.select("case_id", "support", F.col("authority.citation").alias("citation"), F.coalesce(F.col("authority.exists").cast("string"), F.lit("null")).alias("exists"), F.coalesce("world_change", F.lit(False)).alias("world_change"))


def html_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as HTML and back: the digest of its text."""
    ship_package(spark)
    escaped = F.col("text")
    for char, entity in (("&", "&amp;amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    page = F.concat(F.lit("<!-- a page --><p class='x'>"), escaped, F.lit("</p>"))
    return spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.sha2(html_text(page), 256).alias("sha256"))


_COURTS = [*enrichment.CIRCUITS, "scotus", "nysd"]
_PRECEDENTS = ["Published", " published ", "Unpublished"]


def federal_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as citing courts (customer), target courts (order) and precedents (status): orders of each federal status."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    rows = load(spark, sf, "orders").select(pick(_COURTS, F.col("o_custkey")).alias("source"), pick(_COURTS, F.col("o_orderkey")).alias("target"), pick(_PRECEDENTS, F.ascii("o_orderstatus")).alias("precedent"))
    return rows.groupBy(F.coalesce(enrichment.federal_status(F.col("source"), F.col("target"), F.col("precedent")), F.lit("unresolved")).alias("status")).agg(F.count(F.lit(1)).alias("orders"))


def verified_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The top windows of each training pair judged by a scorer, here the stand-in without a model: pairs of each verdict."""
    pairs = windows.paired(claim_pairs(spark, sf), "claim", windows.source_windows(sources(spark, sf), "key", "text"), "key")
    judged = verify.verified(windows.top_windows(pairs, TOP), "claim")
    return judged.groupBy("expected", "verdict.predicted").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("verdict.window") != "").alias("with_window"))


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_CIRCUITS = "(" + ", ".join(f"'{c}'" for c in enrichment.CIRCUITS) + ")"

QUERIES = {f.__name__: f for f in (jsonl_roundtrip, html_texts, federal_statuses, verified_claims)}
SQL = {
    "jsonl_roundtrip": """SELECT case_id, support, authority.citation AS citation, coalesce(CAST(authority.exists AS VARCHAR), CASE WHEN authority IS NULL THEN 'true' ELSE 'null' END) AS exists, coalesce(world_change, false) AS world_change
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC NULLS LAST, rec_id DESC NULLS LAST) AS rn FROM candidate WHERE case_id IS NOT NULL AND case_id <> '') WHERE rn = 1""",
    "html_texts": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "federal_statuses": f"""WITH o AS (SELECT {_list_sql(_COURTS)}[o_custkey % {len(_COURTS)} + 1] AS s, {_list_sql(_COURTS)}[o_orderkey % {len(_COURTS)} + 1] AS t, lower(trim({_list_sql(_PRECEDENTS)}[ascii(o_orderstatus) % 3 + 1])) AS p FROM orders)
SELECT CASE WHEN t NOT IN {_CIRCUITS} THEN 'unresolved' WHEN s = 'scotus' THEN 'controlling' WHEN s NOT IN {_CIRCUITS} OR p <> 'published' THEN 'unresolved' WHEN s = t THEN 'controlling' ELSE 'persuasive' END AS status, count(*) AS orders FROM o GROUP BY 1""",
}
