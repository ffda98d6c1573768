"""JSON lines: runs, pairs, challenges and extractions in, records and reports out.

Lines are split at line feeds alone. A line is parsed once, as a variant, so that a member that is absent and one that is
null can be told apart. A line that is no JSON object is kept with its file and reason, never dropped in silence:
``violations`` lists such lines and ``objects`` refuses them.

Defined results for odd input: blank lines are skipped; a file without lines is an empty table; of a line with a repeated
member nothing can be read, it is a violation; NaN and infinities are no JSON; extra members are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "case_id string, claim string, support string, world_change boolean, world_change_reason string, authority struct<citation:string,jurisdiction:string,court:string,status:string,treatment:string,exists:boolean>, context struct<target_court_id:string,support_contract:struct<required_phrases:array<string>>>"
PAIR = "pair_id string, claim_id string, claim string, citation string, expected_support string, case_name string, split string"
CHALLENGE = "challenge_id string, source_case string, source_citation string, target_case string, target_citation string, target_term string, anchor string, radius int, expected_relation string, difficulty string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (its text) and ``record`` (a variant, null if the line is no JSON) of every line that isn't blank."""
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line"))
    return read.where(F.col("line") != "").withColumn("record", F.try_parse_json("line"))


def _object() -> Column:
    return F.coalesce(F.schema_of_variant("record").like("OBJECT%"), F.lit(False))


def violations(read: DataFrame) -> DataFrame:
    """``file``, ``line`` and ``reason`` of the lines that hold no JSON object."""
    reason = F.when(F.col("record").isNull(), "invalid JSON").otherwise("each row must be an object")
    return read.where(~_object()).select("file", "line", reason.alias("reason"))


def objects(read: DataFrame) -> DataFrame:
    """The lines, all of them objects; else a ValueError that names the first that isn't."""
    first = violations(read).take(1)
    if first:
        raise ValueError(f"{first[0].file}: {first[0].reason}: {first[0].line[:80]}")
    return read


def member(path: str, kind: str = "string") -> Column:
    """A member of the record, null where it is absent, null or of another kind."""
    return F.try_variant_get("record", f"$.{path}", kind)


def state(path: str) -> Column:
    """ABSENT, NULL, TRUE, FALSE or OTHER."""
    value = F.try_variant_get("record", f"$.{path}", "variant")
    kind = F.schema_of_variant(value)
    known = F.when(kind == "BOOLEAN", F.upper(F.try_variant_get("record", f"$.{path}", "string"))).otherwise("OTHER")
    return F.when(value.isNull(), "ABSENT").when(F.is_variant_null(value), "NULL").otherwise(known)


def truthy(path: str) -> Column:
    """Whether a member counts as set: not absent, null, false, zero, an empty text, list or object."""
    value = F.try_variant_get("record", f"$.{path}", "variant")
    return F.coalesce(~F.is_variant_null(value) & ~F.to_json(value).isin("false", "0", "0.0", "-0.0", '""', "[]", "{}"), F.lit(False))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run: columns as in RUN. An authority that is no object counts as empty; ``exists`` is true where it is absent, null where it is null or no boolean."""
    read = objects(lines(spark, path))
    there = state("authority.exists")
    exists = F.when(there.isin("ABSENT", "TRUE"), F.lit(True)).when(there == "FALSE", F.lit(False))
    authority = F.struct(*[member(f"authority.{f}").alias(f) for f in ("citation", "jurisdiction", "court", "status", "treatment")], exists.alias("exists"))
    phrases = F.struct(member("context.support_contract.required_phrases", "array<string>").alias("required_phrases"))
    context = F.struct(member("context.target_court_id").alias("target_court_id"), phrases.alias("support_contract"))
    return read.select(
        *[member(f).alias(f) for f in ("case_id", "claim", "support")], truthy("world_change").alias("world_change"), member("world_change_reason").alias("world_change_reason"), authority.alias("authority"), context.alias("context")
    )


def read_flat(spark: SparkSession, path: str, schema: str, required: Iterable[str] = (), domains: dict[str, tuple] | None = None) -> DataFrame:
    """Records with flat members as in ``schema``; a ValueError names a line that lacks a ``required`` text or whose member is outside its domain."""
    read = objects(lines(spark, path))
    bad = F.lit(False)
    for name in required:
        bad = bad | (F.length(F.trim(F.coalesce(member(name), F.lit("")))) == 0)
    for name, values in (domains or {}).items():
        bad = bad | ~F.coalesce(member(name).isin(*values), F.lit(False))
    first = read.where(bad).take(1)
    if first:
        raise ValueError(f"{first[0].file}: missing or invalid member: {first[0].line[:80]}")
    return read.select(*[member(n, k).alias(n) for n, k in (c.split() for c in schema.split(", "))])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs: columns as in PAIR, ``expected_support`` supported or unsupported."""
    return read_flat(spark, path, PAIR, domains={"expected_support": ("supported", "unsupported")})


def read_challenges(spark: SparkSession, path: str) -> DataFrame:
    """Relation challenges: columns as in CHALLENGE."""
    return read_flat(spark, path, CHALLENGE, ("challenge_id", "source_citation", "target_citation"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as a variant: ``file``, ``record``."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("record"))


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON, its members in order of their names, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Each row as a JSON object on a line, members in order of their names."""
    df.select(sorted_json(df).alias("value")).write.mode(mode).text(path)


def write_report(report: dict, path: str | None) -> str:
    """A small report as indented JSON, in a file or returned for printing."""
    text = json.dumps(report, indent=2, ensure_ascii=False, default=str)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return text
