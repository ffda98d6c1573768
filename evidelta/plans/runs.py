"""Queries of the differential gate over the baseline and candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidelta.functions.text import WHITESPACE
from evidelta.operators import gate
from evidelta.session import load


def latest_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both runs with one row a case: of repeated deliveries the latest, then the one with the largest id; deleted and keyless rows left out."""
    def latest(df: DataFrame) -> DataFrame:
        row = F.struct(*df.columns)
        return df.where(F.col("case_id").isNotNull() & (F.col("case_id") != "")).groupBy("case_id").agg(F.max_by(row, F.struct("loaded_at", "rec_id")).alias("_r")).select("_r.*")

    baseline = load(spark, sf, "baseline").where(F.col("deleted_at").isNull()).select("case_id", "support", "authority", "loaded_at", "rec_id")
    candidate = load(spark, sf, "candidate").select("case_id", "support", "authority", "world_change", "world_change_reason", "loaded_at", "rec_id")
    return latest(baseline), latest(candidate)


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return gate.run_diff(*latest_runs(spark, sf))


def gate_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("case_id", "classification", "blocking", F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["kind"], c["finding"])), ",").alias("findings"))


def gate_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("case_id", F.posexplode("changes").alias("place", "c")).select("case_id", "place", "c.kind", "c.before", "c.after", "c.finding")


def gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gate.run_summary(_cases(spark, sf))


def gate_change_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each kind: how many of each, and in how many blocked cases."""
    opened = _cases(spark, sf).select("blocking", F.explode("changes").alias("c"))
    return opened.groupBy("c.kind", "c.finding").agg(F.count(F.lit(1)).alias("cases"), F.count_if("blocking").alias("blocked"))


def gate_rank_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix of authority status, baseline against candidate, over the cases of both runs."""
    b, c = latest_runs(spark, sf)
    side = lambda df, name: df.select("case_id", gate.fold_value(F.col("authority.status")).alias(name))
    return side(b, "before").join(side(c, "after"), "case_id").groupBy("before", "after").agg(F.count(F.lit(1)).alias("cases"))


def gate_key_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of either table as delivered that break a run's contract."""
    parts = [gate.key_violations(load(spark, sf, t), "case_id").select(F.lit(t).alias("table_name"), "key", "rows") for t in ("baseline", "candidate")]
    return parts[0].unionByName(parts[1])


def _fold(x: str) -> str:
    return f"coalesce(replace(lower(regexp_replace({x}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')), ' ', '_'), 'unknown')"


def _case(x: str, ranks: dict, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + f" ELSE {other} END"


def _latest(table: str, where: str, extra: str) -> str:
    folded = ", ".join(f"{_fold(c)} AS {n}" for n, c in (("t", "authority.treatment"), ("s", "authority.status"), ("p", "support"), ("j", "authority.jurisdiction")))
    return f"""SELECT case_id, {folded}, authority.exists AS e, authority.citation AS ci{extra} FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC NULLS LAST, rec_id DESC NULLS LAST) AS rn
FROM {table} WHERE case_id IS NOT NULL AND case_id <> ''{where}) WHERE rn = 1"""


_NEGATIVE = "(" + ", ".join(f"'{t}'" for t in gate.NEGATIVE_TREATMENTS) + ")"
_GATE = f"""WITH b AS ({_latest("baseline", " AND deleted_at IS NULL", "")}), c AS ({_latest("candidate", "", ", world_change AS w, world_change_reason AS why")}),
j AS (SELECT coalesce(b.case_id, c.case_id) AS case_id, b.case_id IS NULL AS nb, c.case_id IS NULL AS nc, coalesce(c.w, false) AS w, c.why AS why,
  b.t AS bt, c.t AS ct, b.s AS bs, c.s AS cs, b.p AS bp, c.p AS cp, b.j AS bj, c.j AS cj, b.e AS be, c.e AS ce, b.ci AS bc, c.ci AS cc,
  {_case("b.s", gate.AUTHORITY_RANK, "0")} AS bsr, {_case("c.s", gate.AUTHORITY_RANK, "0")} AS csr, {_case("b.p", gate.SUPPORT_RANK, "NULL")} AS bpr, {_case("c.p", gate.SUPPORT_RANK, "NULL")} AS cpr
  FROM b FULL OUTER JOIN c ON b.case_id = c.case_id),
k AS (SELECT *, NOT nb AND NOT nc AND NOT w AS paired FROM j),
f AS (
  SELECT case_id, 1 AS o, 'missing_candidate_case' AS kind, 'present' AS before, 'missing' AS after, 'UNKNOWN' AS finding FROM k WHERE nc
  UNION ALL SELECT case_id, 1, 'new_candidate_case', 'missing', 'present', 'UNKNOWN' FROM k WHERE nb
  UNION ALL SELECT case_id, 1, 'world_change', 'false', coalesce(why, 'true'), 'WORLD_CHANGE' FROM k WHERE NOT nb AND NOT nc AND w
  UNION ALL SELECT case_id, 1, 'citation_existence', CAST(be AS VARCHAR), CAST(ce AS VARCHAR), CASE WHEN be THEN 'REGRESSION' ELSE 'IMPROVEMENT' END FROM k WHERE paired AND be <> ce
  UNION ALL SELECT case_id, 2, 'treatment', bt, ct, CASE WHEN ct IN {_NEGATIVE} THEN 'REGRESSION' ELSE 'IMPROVEMENT' END FROM k
    WHERE paired AND (bt IN {_NEGATIVE}) <> (ct IN {_NEGATIVE}) AND (ct IN {_NEGATIVE} OR ct <> 'unknown')
  UNION ALL SELECT case_id, 3, 'authority_strength', bs, cs, CASE WHEN csr < bsr THEN 'REGRESSION' WHEN csr > bsr THEN 'IMPROVEMENT' ELSE 'UNKNOWN' END FROM k WHERE paired AND bs <> cs AND (bsr <> csr OR bsr = 0)
  UNION ALL SELECT case_id, 4, 'proposition_support', bp, cp, CASE WHEN bpr IS NULL OR cpr IS NULL THEN 'UNKNOWN' WHEN cpr < bpr THEN 'REGRESSION' ELSE 'IMPROVEMENT' END FROM k WHERE paired AND bp <> cp
  UNION ALL SELECT case_id, 5, 'jurisdiction', bj, cj, 'UNKNOWN' FROM k WHERE paired AND bj <> cj AND bj <> 'unknown' AND cj <> 'unknown' AND NOT (bs <> cs AND csr < bsr)
  UNION ALL SELECT case_id, 6, 'citation', bc, cc, 'INFORMATION' FROM k WHERE paired AND bc IS DISTINCT FROM cc),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY list_position(['REGRESSION', 'IMPROVEMENT', 'UNKNOWN', 'INFORMATION', 'WORLD_CHANGE'], finding), o) - 1 AS INTEGER) AS place FROM f),
g AS (SELECT case_id, string_agg(kind || ':' || finding, ',' ORDER BY place) AS findings, bool_or(finding = 'WORLD_CHANGE') AS w, bool_or(finding = 'REGRESSION') AS r, bool_or(finding = 'UNKNOWN') AS u, bool_or(finding = 'IMPROVEMENT') AS i FROM n GROUP BY case_id),
cases AS (SELECT k.case_id, CASE WHEN g.w THEN 'WORLD_CHANGE' WHEN g.r THEN 'REGRESSION' WHEN g.u THEN 'UNKNOWN' WHEN g.i THEN 'IMPROVEMENT' ELSE 'UNCHANGED' END AS classification, coalesce(g.r, false) AS blocking, coalesce(g.findings, '') AS findings FROM k LEFT JOIN g ON k.case_id = g.case_id)"""

QUERIES = {
    "gate_summary": gate_summary,
    "gate_cases": gate_cases,
    "gate_changes": gate_changes,
    "gate_change_kinds": gate_change_kinds,
    "gate_rank_transitions": gate_rank_transitions,
    "gate_key_violations": gate_key_violations,
}
SQL = {
    "gate_cases": f"{_GATE} SELECT * FROM cases",
    "gate_changes": f"{_GATE} SELECT case_id, place, kind, before, after, finding FROM n",
    "gate_summary": f"""{_GATE} SELECT count(*) AS cases_evaluated, {", ".join(f"CAST(count(*) FILTER (WHERE classification = '{k}') AS BIGINT) AS {n}" for n, k in (("regressions", "REGRESSION"), ("improvements", "IMPROVEMENT"), ("unchanged", "UNCHANGED"), ("unknown", "UNKNOWN"), ("world_change", "WORLD_CHANGE")))},
CASE WHEN bool_or(blocking) THEN 'BLOCK' WHEN bool_or(classification IN ('UNKNOWN', 'WORLD_CHANGE')) THEN 'REVIEW' ELSE 'PASS' END AS decision FROM cases""",
    "gate_change_kinds": f"{_GATE} SELECT kind, finding, count(*) AS cases, CAST(count(*) FILTER (WHERE blocking) AS BIGINT) AS blocked FROM n JOIN cases USING (case_id) GROUP BY kind, finding",
    "gate_rank_transitions": f"{_GATE} SELECT bs AS before, cs AS after, count(*) AS cases FROM k WHERE NOT nb AND NOT nc GROUP BY bs, cs",
    "gate_key_violations": " UNION ALL ".join(f"SELECT '{t}' AS table_name, case_id AS key, count(*) AS rows FROM {t} GROUP BY case_id HAVING case_id IS NULL OR case_id = '' OR count(*) > 1" for t in ("baseline", "candidate")),
}
