"""The differential gate: is a new run of an evidence-citing system weaker than a baseline run?

Both runs are paired by key in one full outer join. Each compared field of a pair is a rule that finds for a regression, an
improvement, an unknown or a mere notice; the strongest finding is the pair's class, and one regression blocks the run.
What can't be ranked is UNKNOWN, never guessed. Everything is Column expressions over the joined row, so the plan is one
join, one projection and, for the summary, one aggregate with map-side combine.

Defined results for odd input: null values are 'unknown', an empty text stays empty; a null ``exists`` fires no rule; a
null authority has null fields; keys on one side only are UNKNOWN; keys that are null or empty, or occur several times in
a run, are violations, which ``key_violations`` lists and ``check_keys`` refuses; extra columns are ignored; two empty runs PASS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.functions.text import fold_value

# Ranks of authority and of support, and treatments that weaken an authority.
AUTHORITY_RANK = {"controlling": 3, "binding": 3, "mandatory": 3, "persuasive": 2, "secondary": 1, "unknown": 0}
SUPPORT_RANK = {"contradicted": 0, "unsupported": 1, "partial": 2, "supported": 3}
NEGATIVE_TREATMENTS = ("overruled", "superseded", "reversed", "vacated", "invalid", "negative")

WORSE, BETTER, OPEN, NOTICE = "REGRESSION", "IMPROVEMENT", "UNKNOWN", "INFORMATION"
CHANGE = "struct<kind:string,before:string,after:string,finding:string>"
#: Fields of a run that are compared folded.
FOLDED = {"treatment": "authority.treatment", "status": "authority.status", "support": "support", "jurisdiction": "authority.jurisdiction"}


def rank(value: Column, ranks: dict[str, int], other: int | None = None) -> Column:
    """The rank of a value; ``other`` (null unless given) for values without one."""
    found = F.lit(other).cast("int")
    for name, n in ranks.items():
        found = F.when(value == name, F.lit(n)).otherwise(found)
    return found


def _finding(kind: str, before: Column, after: Column, finding: Column) -> Column:
    made = F.struct(F.lit(kind).alias("kind"), before.cast("string").alias("before"), after.cast("string").alias("after"), finding.alias("finding"))
    return F.when(finding.isNotNull(), made)


def _ranked(before: Column, after: Column) -> Column:
    return F.when(after < before, WORSE).when(after > before, BETTER)


def findings(b: Column, c: Column) -> Column:
    """The findings of the baseline struct ``b`` against the candidate struct ``c``, as ``_side`` makes them: regressions first, then improvements, unknowns and notices."""
    bt, ct = b["treatment"], c["treatment"]
    bn, cn = b["negative"], c["negative"]
    bs, cs = b["status"], c["status"]
    bsr, csr = b["authority_rank"], c["authority_rank"]
    strength = F.when(bs != cs, F.coalesce(_ranked(bsr, csr), F.when(bsr == 0, OPEN)))
    bp, cp = b["support"], c["support"]
    bpr, cpr = b["support_rank"], c["support_rank"]
    support = F.when(bp != cp, F.when(bpr.isNull() | cpr.isNull(), OPEN).otherwise(_ranked(bpr, cpr)))
    bj, cj = b["jurisdiction"], c["jurisdiction"]
    moved = (bj != cj) & (bj != "unknown") & (cj != "unknown") & ~F.coalesce(strength == WORSE, F.lit(False))
    rules = [
        _finding("citation_existence", b["exists"], c["exists"], F.when(b["exists"] & ~c["exists"], WORSE).when(~b["exists"] & c["exists"], BETTER)),
        _finding("treatment", bt, ct, F.when(~bn & cn, WORSE).when(bn & ~cn & (ct != "unknown"), BETTER)),
        _finding("authority_strength", bs, cs, strength),
        _finding("proposition_support", bp, cp, support),
        _finding("jurisdiction", bj, cj, F.when(moved, OPEN)),
        _finding("citation", b["citation"], c["citation"], F.when(~b["citation"].eqNullSafe(c["citation"]), NOTICE)),
    ]
    found = F.array_compact(F.array(*rules))
    of = lambda k: F.filter(found, lambda x: x["finding"] == k)
    return F.concat(*map(of, (WORSE, BETTER, OPEN, NOTICE)))


def key_violations(run: DataFrame, key: str) -> DataFrame:
    """``key`` and ``rows`` of the keys that are null or empty, or occur several times."""
    counts = run.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("key").isNull() | (F.col("key") == "") | (F.col("rows") > 1))


def check_keys(run: DataFrame, key: str) -> DataFrame:
    """``run``, if its keys are unique and none is null or empty; else a ValueError that names one."""
    first = key_violations(run, key).take(1)
    if first:
        raise ValueError(f"a run needs one row for each non-empty {key}; {first[0].key!r} has {first[0].rows}")
    return run


def _side(run: DataFrame, key: str, name: str, extra: dict[str, str]) -> DataFrame:
    """A run as ``case_id`` and a struct of what the rules read, folded and ranked once for each row."""
    col = F.col
    plain = run.select(col(key).cast("string").alias("case_id"), col("authority.exists").alias("exists"), col("authority.citation").alias("citation"), *[fold_value(col(c)).alias(n) for n, c in FOLDED.items()], *[col(c).alias(n) for n, c in extra.items()])
    ranked = {"negative": col("treatment").isin(*NEGATIVE_TREATMENTS), "authority_rank": rank(col("status"), AUTHORITY_RANK, 0), "support_rank": rank(col("support"), SUPPORT_RANK)}
    return plain.select("case_id", F.struct(*plain.columns[1:], *[c.alias(n) for n, c in ranked.items()]).alias(name))


def run_diff(baseline: DataFrame, candidate: DataFrame, key: str = "case_id", how: str = "full_outer") -> DataFrame:
    """One row for each case of either run: ``case_id``, ``classification``, ``blocking``, ``changes``.

    A candidate whose ``world_change`` is set is a WORLD_CHANGE whatever else differs. ``how``: a join that keeps one side's cases alone.
    """
    world = {"world": "world_change", "why": "world_change_reason"}
    pairs = _side(baseline, key, "b", {}).join(_side(candidate, key, "c", world), "case_id", how)
    b, c = F.col("b"), F.col("c")
    alone = lambda kind, before, after: F.array(_finding(kind, F.lit(before), F.lit(after), F.lit(OPEN)))
    changed = F.array(_finding("world_change", F.lit("false"), F.coalesce(c["why"], F.lit("true")), F.lit("WORLD_CHANGE")))
    changes = (
        F.when(c.isNull(), alone("missing_candidate_case", "present", "missing"))
        .when(b.isNull(), alone("new_candidate_case", "missing", "present"))
        .when(c["world"], changed)
        .otherwise(findings(b, c))
    )
    has = lambda k: F.exists("changes", lambda x: x["finding"] == k)
    classes = F.when(has("WORLD_CHANGE"), "WORLD_CHANGE").when(has(WORSE), WORSE).when(has(OPEN), OPEN).when(has(BETTER), BETTER).otherwise("UNCHANGED")
    return pairs.select("case_id", changes.alias("changes")).select("case_id", classes.alias("classification"), has(WORSE).alias("blocking"), "changes")


def run_summary(cases: DataFrame) -> DataFrame:
    """One row: ``cases_evaluated``, the cases of each class, and the ``decision`` BLOCK, REVIEW or PASS."""
    of = lambda k: F.count_if(F.col("classification") == k)
    counts = cases.agg(
        F.count(F.lit(1)).alias("cases_evaluated"),
        of(WORSE).alias("regressions"),
        of(BETTER).alias("improvements"),
        of("UNCHANGED").alias("unchanged"),
        of(OPEN).alias("unknown"),
        of("WORLD_CHANGE").alias("world_change"),
        F.count_if("blocking").alias("_blocking"),
    )
    decision = F.when(F.col("_blocking") > 0, "BLOCK").when(F.col("unknown") + F.col("world_change") > 0, "REVIEW").otherwise("PASS")
    return counts.withColumn("decision", decision).drop("_blocking")
