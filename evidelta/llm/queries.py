"""Queries on training data."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidelta.functions.jsonread import readable_object, scalar_text
from evidelta.functions.text import fold_value
from evidelta.llm import duplicates, leakage, overlaps, personal, tokens
from evidelta.session import load, ship_package, spread


def _extracted(challenge: object, text: object) -> tuple:
    """The compared fields of a prediction; nulls where target_authority isn't one object or the text isn't readable."""
    root = readable_object(text)
    target = root.get("target_authority") if root else None
    if not isinstance(target, dict):
        return challenge, None, None, None
    return challenge, scalar_text(root.get("treatment")), scalar_text(root.get("proposition")), scalar_text(target.get("citation"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _p1_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records of all tables."""
    ship_package(spark)
    c = F.col
    heldout = load(spark, sf, "heldout").where(c("item_kind") == "relation")
    return _union(
        [
            duplicates.records(load(spark, sf, "baseline"), "baseline", "rec_id", [("claim", "leaf", c("claim")), ("citation", "citation", c("authority.citation"))]),
            duplicates.records(
                heldout, "heldout", "heldout_id", [("source_citation", "citation", c("source_citation")), ("target_citation", "citation", c("target_citation")), ("anchor", "leaf", c("anchor"))]
            ),
            duplicates.records(
                load(spark, sf, "predictions"),
                "predictions",
                "prediction_id",
                [("challenge_id", "exact", c("challenge_id")), ("treatment", "leaf", c("extraction")), ("proposition", "leaf", None), ("citation", "citation", None)],
                _extracted,
            ),
        ]
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.members(_p1_records(spark, sf))


def p1_copies(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each group of records, also those that stand alone or can't be compared, with the number of copies."""
    return duplicates.groups(_p1_records(spark, sf)).withColumnRenamed("_table", "table_name")


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    c = F.col
    heldout = load(spark, sf, "heldout").where((c("item_kind") == "pair") & c("pair_id").isNotNull()).select(c("pair_id").alias("heldout_pair_id"), "split", c("claim").alias("heldout_claim"))
    pairs = load(spark, sf, "pairs").where(c("pair_id").isNotNull()).select("pair_id", "citation", "claim")
    return overlaps.overlaps(heldout, "heldout_claim", pairs, "claim")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).select("heldout_pair_id", "pair_id").distinct()


def p3_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs per split (case and surrounding whitespace ignored) and citation (its parts in any order, shown in its least spelling)."""
    form = F.pandas_udf(lambda texts: pd.Series([(n[0] if (n := duplicates.citation_node("citation", t)) else None) for t in texts], dtype=object), "string")
    found = _overlaps(spark, sf).withColumns({"split": fold_value(F.col("split"), None), "_form": form("citation")})
    pairs = found.groupBy("split", "_form", "heldout_pair_id", "pair_id").agg(F.min("citation").alias("citation"))
    return pairs.groupBy("split", "_form").agg(F.min("citation").alias("citation"), F.count(F.lit(1)).alias("overlaps")).drop("_form")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)

    def encode(texts: pd.Series) -> pd.Series:
        tokenizer = tokens.public("byte_bpe_50k")
        return pd.Series([tokenizer.ids(t) for t in texts], dtype=object)

    ids = F.pandas_udf(encode, "array<int>")
    return spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", ids("text").alias("ids"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return leakage.leaks(load(spark, sf, "documents"), "doc_id", "text", load(spark, sf, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where(F.col("windows") > 0).select("item_id", "doc_id")


def p7_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each item that leaked word for word, with its suite and split, the number of documents, and the most windows one of them holds."""
    found = _leaks(spark, sf).where(F.col("windows") > 0).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("windows").alias("most_windows"))
    return load(spark, sf, "eval_items").select("item_id", "suite", "split").join(found, "item_id")


def _personal(spark: SparkSession, sf: str, rows: str, make) -> DataFrame:
    """``make(model, doc_id, text)`` gives the rows of a document; the model, a few thousand weights, is broadcast."""
    ship_package(spark)
    model = spark.sparkContext.broadcast(personal.model())

    def scan(batches):
        field = model.value
        for batch in batches:
            out = [row for doc, text in zip(batch["doc_id"], batch["text"]) for row in make(field, doc, text)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in rows.split(", ")])

    docs = load(spark, sf, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return spread(docs, "doc_id").mapInPandas(scan, rows)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and first character of every mention of personal data."""
    return _personal(spark, sf, "doc_id bigint, kind string, start_at bigint", lambda field, doc, text: [(doc, kind, start) for start, _, kind, _ in field.mentions(text)]).distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with typed placeholders in place of personal data; null and empty texts stay as they are."""
    return _personal(spark, sf, "doc_id bigint, text string", lambda field, doc, text: [(doc, personal.redact(text, field.mentions(text)))])


def p8_mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of each kind and the documents that hold them."""
    return p8_found(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p3_found": p3_found,
    "p3_overlap_counts": p3_overlap_counts,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
    "p8_mention_counts": p8_mention_counts,
}


def _bag_sql(claim: str) -> str:
    """A claim's words, repeated ones numbered, so that lists of them intersect as bags do."""
    words = f"regexp_extract_all(lower({claim}), '[\\p{{L}}\\p{{N}}]+')"
    return f"list_transform({words}, lambda w, i: w || '#' || len(list_filter(({words})[1:i], lambda x: x = w)))"


_OVERLAPS_SQL = f"""WITH h AS (SELECT DISTINCT pair_id, {_bag_sql("claim")} AS bag FROM heldout WHERE item_kind = 'pair' AND pair_id IS NOT NULL AND claim IS NOT NULL), p AS (SELECT DISTINCT pair_id, {_bag_sql("claim")} AS bag FROM pairs WHERE pair_id IS NOT NULL AND claim IS NOT NULL)
SELECT DISTINCT h.pair_id AS heldout_pair_id, p.pair_id FROM h JOIN p ON len(h.bag) >= {overlaps.LEAST} AND len(p.bag) >= {overlaps.LEAST} AND len(h.bag) * 5 >= len(p.bag) * 4 AND len(p.bag) * 5 >= len(h.bag) * 4 AND len(list_intersect(h.bag, p.bag)) * 5 >= greatest(len(h.bag), len(p.bag)) * 4"""
SQL = {"p3_found": _OVERLAPS_SQL}
