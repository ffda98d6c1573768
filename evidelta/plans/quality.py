"""Queries on the quality of whole tables: dangling references, differing copies, nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidelta.functions.text import WHITESPACE, fold_value
from evidelta.operators.comparison import differences
from evidelta.operators import nested
from evidelta.operators.references import orphan_counts, orphan_rows
from evidelta.session import load, ship_package

#: Referring table, its id, its key, the parent table and the parent's key.
REFERENCES = [("candidate", "rec_id", "case_id", "baseline", "case_id"), ("predictions", "prediction_id", "challenge_id", "candidates", "challenge_id")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [orphan_rows(load(spark, sf, c), i, k, load(spark, sf, p), pk).select(F.lit(c).alias("table_name"), "row_id") for c, i, k, p, pk in REFERENCES]
    return parts[0].unionByName(parts[1])


def p2_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    parts = [orphan_counts(load(spark, sf, c), i, k, load(spark, sf, p), pk).select(F.lit(c).alias("table_name"), "*") for c, i, k, p, pk in REFERENCES]
    return parts[0].unionByName(parts[1])


_ORPHANS = """
SELECT '{c}' AS table_name, r.{i} AS row_id, strftime(r.loaded_at, '%Y-%m') AS period,
  NOT EXISTS (SELECT 1 FROM {p} q WHERE q.{pk} = r.{k} AND q.deleted_at IS NULL AND q.loaded_at <= r.loaded_at) AS orphan
FROM {c} r WHERE r.{k} IS NOT NULL"""
_ALL_REFERENCES = " UNION ALL ".join(_ORPHANS.format(c=c, i=i, k=k, p=p, pk=pk) for c, i, k, p, pk in REFERENCES)


def _compared() -> dict[str, Column]:
    return {
        "support": fold_value(F.col("support")),
        "authority.status": fold_value(F.col("authority.status")),
        "authority.treatment": fold_value(F.col("authority.treatment")),
    }


def _p4(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    baseline = load(spark, sf, "baseline").where(F.col("deleted_at").isNull())
    return differences(baseline, load(spark, sf, "candidate"), "case_id", _compared(), ["loaded_at", "rec_id"], "missing_in_baseline", "missing_in_candidate")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p4(spark, sf).select(F.col("key").alias("case_id"), "finding")


def p4_difference_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _p4(spark, sf).groupBy("finding").agg(F.count(F.lit(1)).alias("cases"))




def _fold_sql(value: str) -> str:
    return f"coalesce(replace(lower(regexp_replace({value}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')), ' ', '_'), 'unknown')"


def _latest_sql(table: str, where: str = "") -> str:
    f = [_fold_sql(c) for c in ("support", "authority.status", "authority.treatment")]
    return f"""SELECT case_id, {f[0]} AS su, {f[1]} AS st, {f[2]} AS tr FROM
  (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC NULLS LAST, rec_id DESC NULLS LAST) AS rn FROM {table} WHERE case_id IS NOT NULL {where}) WHERE rn = 1"""


_P4_SQL = f"""WITH b AS ({_latest_sql("baseline", "AND deleted_at IS NULL")}), c AS ({_latest_sql("candidate")}),
j AS (SELECT coalesce(b.case_id, c.case_id) AS case_id, b.case_id IS NULL AS nb, c.case_id IS NULL AS nc, b.su <> c.su AS dsu, b.st <> c.st AS dst, b.tr <> c.tr AS dtr FROM b FULL OUTER JOIN c ON b.case_id = c.case_id)
SELECT case_id, 'missing_in_candidate' AS finding FROM j WHERE nc UNION ALL SELECT case_id, 'missing_in_baseline' FROM j WHERE nb
UNION ALL SELECT case_id, 'support' FROM j WHERE dsu UNION ALL SELECT case_id, 'authority.status' FROM j WHERE dst UNION ALL SELECT case_id, 'authority.treatment' FROM j WHERE dtr"""


TARGET, SPAN, ALTERNATE = ("target_authority", "[]"), ("evidence_spans", "[]"), ("evidence_spans", "[]", "alternates", "[]")
#: Name of each child table's rows in p5_found.
CHILDREN = {TARGET: "target_authority", SPAN: "evidence_span", ALTERNATE: "alternate"}
#: Scalar columns of each table.
FIELDS = {
    (): ["proposition", "proposition_owner", "current_court_stance", "treatment", "claim_consequence", "confidence", "abstain", "abstention_reason"],
    TARGET: ["name", "citation", "resolved"],
    SPAN: ["text", "role"],
    ALTERNATE: ["text", "role"],
}


def _objects(spark: SparkSession, sf: str, paths: list[tuple[str, ...]]) -> DataFrame:
    """The objects at ``paths``; each child path may hold one object in place of an array."""
    ship_package(spark)
    return nested.objects(load(spark, sf, "predictions"), "prediction_id", "extraction", [p[:-1] for p in CHILDREN], paths)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _objects(spark, sf, list(CHILDREN))
    place = lambda label: F.element_at(F.split(label, r"\."), -1).cast("int")
    parts = F.when(nested.at(TARGET), F.lit("target_authority")).when(nested.at(SPAN), F.lit("evidence_span")).otherwise(F.lit("alternate"))
    inner = nested.at(ALTERNATE)
    return rows.select(
        F.col("row_id").alias("prediction_id"),
        parts.alias("child"),
        F.when(inner, place(F.col("parent_label"))).otherwise(F.col("pos")).alias("pos"),
        F.when(inner, F.col("pos")).otherwise(F.lit(-1)).alias("sub_pos"),
    )


def _table(path: tuple[str, ...]):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return nested.table(_objects(spark, sf, [path]), path, FIELDS[path]).withColumnRenamed("row_id", "prediction_id")

    return query


p5_predictions = _table(())
p5_target_authorities = _table(TARGET)
p5_evidence_spans = _table(SPAN)
p5_alternates = _table(ALTERNATE)


def p5_other_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members that none of the tables has a column for, so that nothing of a record is lost."""
    rows = _objects(spark, sf, list(FIELDS))
    own_tables = {(): ["target_authority", "evidence_spans"], SPAN: ["alternates"]}
    return nested.other_members(rows, {p: f + own_tables.get(p, []) for p, f in FIELDS.items()}).withColumnRenamed("row_id", "prediction_id")


def p5_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions whose extraction is no complete object, which therefore have no row in any table."""
    ship_package(spark)
    return nested.unreadable(load(spark, sf, "predictions"), "prediction_id", "extraction").withColumnRenamed("row_id", "prediction_id")


_READABLE = """t AS (SELECT prediction_id, try_cast(extraction AS JSON) AS x FROM predictions),
u AS (SELECT prediction_id, CASE WHEN json_type(x) = 'VARCHAR' THEN try_cast(x ->> '$' AS JSON) ELSE x END AS x FROM t),
r AS (SELECT prediction_id, x FROM u WHERE json_type(x) = 'OBJECT')"""


def _elements(source: str, name: str, carry: str = "") -> str:
    value = f"json_extract({source}.x, '$.{name}')"
    listed = f"CASE json_type({value}) WHEN 'OBJECT' THEN [{value}] WHEN 'ARRAY' THEN from_json({value}, '[\"JSON\"]') ELSE [] END"
    return f"SELECT prediction_id{carry}, unnest({listed}) AS x, generate_subscripts({listed}, 1) - 1 AS i FROM {source}"


_P5_SQL = f"""WITH {_READABLE}, a AS ({_elements("r", "target_authority")}), s AS ({_elements("r", "evidence_spans")}),
so AS (SELECT prediction_id, x, i AS pos FROM s WHERE json_type(x) = 'OBJECT'), al AS ({_elements("so", "alternates", ", pos")})
SELECT DISTINCT * FROM (SELECT prediction_id, 'target_authority' AS child, CAST(i AS INTEGER) AS pos, CAST(-1 AS INTEGER) AS sub_pos FROM a WHERE json_type(x) = 'OBJECT'
UNION ALL SELECT prediction_id, 'evidence_span', CAST(pos AS INTEGER), CAST(-1 AS INTEGER) FROM so
UNION ALL SELECT prediction_id, 'alternate', CAST(pos AS INTEGER), CAST(i AS INTEGER) FROM al WHERE json_type(x) = 'OBJECT')"""



def _place_sql(record: str, member: str) -> str:
    """A member's ordinal in its object."""
    return f"list_position(json_keys({record}), '{member}') - 1"


def _scalar_sql(record: str, member: str) -> str:
    return f"CASE WHEN json_type({record}, '$.{member}') IN ('OBJECT', 'ARRAY') THEN NULL ELSE {record} ->> '$.{member}' END AS {member}"


def _child_sql(source: str, name: str, label: str) -> str:
    """Objects in member ``name`` of the objects x of ``source``, with the labels of both."""
    value = f"json_extract(x, '$.{name}')"
    listed = f"CASE json_type({value}) WHEN 'OBJECT' THEN [{value}] WHEN 'ARRAY' THEN from_json({value}, '[\"JSON\"]') ELSE [] END"
    under = f"SELECT prediction_id, {label} AS parent_label, {_place_sql('x', name)} AS place, unnest({listed}) AS x, generate_subscripts({listed}, 1) - 1 AS pos FROM {source}"
    return f"SELECT prediction_id, parent_label, concat_ws('.', nullif(parent_label, ''), place, pos) AS label, CAST(pos AS INTEGER) AS pos, x FROM ({under}) WHERE json_type(x) = 'OBJECT'"


_P5_TABLES = f"""WITH {_READABLE}, ta AS ({_child_sql("r", "target_authority", "''")}), es AS ({_child_sql("r", "evidence_spans", "''")}), al AS ({_child_sql("es", "alternates", "label")})"""


def _table_sql(name: str, path: tuple[str, ...]) -> str:
    cells = ", ".join(_scalar_sql("x", f) for f in FIELDS[path])
    own = "'' AS label, CAST(NULL AS VARCHAR) AS parent_label, CAST(0 AS INTEGER) AS pos" if not path else "label, parent_label, pos"
    return f"{_P5_TABLES} SELECT prediction_id, {own}, {cells} FROM {name}"


QUERIES = {
    "p2_found": p2_found,
    "p2_orphans_by_month": p2_orphans_by_month,
    "p4_found": p4_found,
    "p4_difference_counts": p4_difference_counts,
    "p5_found": p5_found,
    "p5_predictions": p5_predictions,
    "p5_target_authorities": p5_target_authorities,
    "p5_evidence_spans": p5_evidence_spans,
    "p5_alternates": p5_alternates,
    "p5_other_members": p5_other_members,
    "p5_unreadable": p5_unreadable,
}

SQL = {
    "p2_found": f"SELECT table_name, row_id FROM ({_ALL_REFERENCES}) WHERE orphan",
    "p2_orphans_by_month": f"SELECT table_name, period, count(*) AS references_n, CAST(count(*) FILTER (WHERE orphan) AS BIGINT) AS orphans FROM ({_ALL_REFERENCES}) GROUP BY ALL",
    "p4_found": _P4_SQL,
    "p4_difference_counts": f"SELECT finding, count(*) AS cases FROM ({_P4_SQL}) GROUP BY finding",
    "p5_found": _P5_SQL,
    "p5_predictions": _table_sql("r", ()),
    "p5_target_authorities": _table_sql("ta", TARGET),
    "p5_evidence_spans": _table_sql("es", SPAN),
    "p5_alternates": _table_sql("al", ALTERNATE),
    "p5_unreadable": f"WITH {_READABLE} SELECT prediction_id FROM predictions WHERE prediction_id NOT IN (SELECT prediction_id FROM r)",
}
