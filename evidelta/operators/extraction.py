"""Structured extractions against their contract: shape, domains, consistency, and evidence that stands in the passage.

An extraction is a JSON text. Its contract is a table of members, kinds and domains, with rules between members; each breach
has a code, and an extraction without one is valid. What is invalid or abstains has no usable treatment; nothing is repaired
or guessed. Shapes vary from row to row, so the step works on the parsed values in Arrow batches, one parse a row.

Defined results for odd input: a null or unreadable text is ``extraction_not_object``; a null passage grounds nothing; the
name of the target isn't compared, its citation is, by letters and digits; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.functions import lexical
from evidelta.functions.jsonread import kind_of, plain, readable_object
from evidelta.functions.relations import STANCES

# The contract's members and domains, in the order in which breaches are told.
TOP = ("target_authority", "proposition", "proposition_owner", "current_court_stance", "treatment", "claim_consequence", "evidence_spans", "confidence", "abstain", "abstention_reason")
TARGET, EVIDENCE = ("name", "citation", "resolved"), ("text", "role")
OWNERS = ("CURRENT_COURT", "TARGET_AUTHORITY", "OTHER_AUTHORITY", "PARTY", "SEPARATE_OPINION", "UNKNOWN")
TREATMENTS = ("AFFIRMATIVE_USE", "DISTINGUISHES_OR_LIMITS", "NEGATIVE_TREATMENT", "MENTION_ONLY", "UNKNOWN")
CONSEQUENCES = ("SUPPORTS", "LIMITS", "INVALIDATES", "NONE", "UNKNOWN")
ROLES = ("TARGET_MENTION", "PROPOSITION", "STANCE", "CONSEQUENCE")
CONFIDENCES = ("low", "medium", "high")
MOST_SPANS = 8
_TREATMENT_OF = {s: t for t, stances in STANCES.items() for s in stances} | {"UNRESOLVED": "UNKNOWN"}

CHECKED = "valid boolean, errors array<string>, derived_treatment string, grounded int, roles int, abstain boolean, resolved boolean"
_PRINT = str.maketrans({**dict.fromkeys(lexical.DASHES, "-"), **dict.fromkeys(lexical.QUOTES, "'"), **dict.fromkeys(lexical.DOUBLE_QUOTES, '"'), lexical.SOFT_HYPHEN: None})


def _plain_print(text: str) -> str:
    return " ".join(text.translate(_PRINT).split()).lower()


def _key(citation: str) -> str:
    return re.sub("[^a-z0-9]+", "", citation.lower())


def _keys(value: dict, expected: tuple, prefix: str) -> Iterator[str]:
    missing, extra = sorted(set(expected) - value.keys()), sorted(value.keys() - set(expected))
    if missing:
        yield f"{prefix}missing_keys:" + ",".join(missing)
    if extra:
        yield f"{prefix}extra_keys:" + ",".join(extra)


def _one_of(value: Any, domain) -> bool:
    return kind_of(value) == "string" and value in domain


def check(root: dict | None, context: str, citation: str | None) -> tuple:
    """CHECKED for one extraction."""
    if root is None:
        return False, ["extraction_not_object"], "UNKNOWN", 0, 0, None, None
    errors = list(_keys(root, TOP, ""))
    say = lambda wrong, code: errors.append(code) if wrong else None
    target = root.get("target_authority")
    if isinstance(target, dict):
        errors += _keys(target, TARGET, "target_")
    else:
        errors.append("target_authority_not_object")
        target = {}
    resolved, cited = target.get("resolved"), target.get("citation")
    say(kind_of(target.get("name")) != "string", "target_name_not_string")
    if kind_of(cited) != "string":
        errors.append("target_citation_not_string")
    else:
        say(_key(cited) != _key(citation or ""), "target_citation_mismatch")
    say(not isinstance(resolved, bool), "target_resolved_not_boolean")
    proposition, owner, stance, treatment = (root.get(k) for k in TOP[1:5])
    say(kind_of(proposition) != "string", "proposition_not_string")
    say(not _one_of(owner, OWNERS), "invalid_proposition_owner")
    say(not _one_of(stance, _TREATMENT_OF), "invalid_current_court_stance")
    derived = _TREATMENT_OF[stance] if _one_of(stance, _TREATMENT_OF) else "UNKNOWN"
    if not _one_of(treatment, TREATMENTS):
        errors.append("invalid_treatment")
    else:
        say(treatment != derived, f"treatment_stance_mismatch:{treatment}!={derived}")
    say(not _one_of(root.get("claim_consequence"), CONSEQUENCES), "invalid_claim_consequence")
    confidence, abstain, why = root.get("confidence"), root.get("abstain"), root.get("abstention_reason")
    say(not _one_of(confidence, CONFIDENCES), "invalid_confidence")
    say(not isinstance(abstain, bool), "abstain_not_boolean")
    say(kind_of(why) not in ("string", "null"), "abstention_reason_not_string_or_null")
    reason = kind_of(why) == "string" and bool(why.strip())
    if abstain is True:
        say(treatment != "UNKNOWN", "abstain_requires_unknown_treatment")
        say(confidence != "low", "abstain_requires_low_confidence")
        say(not reason, "abstain_requires_reason")
    elif abstain is False:
        say(reason, "non_abstain_must_not_have_reason")
    if resolved is False:
        say(abstain is not True, "unresolved_target_requires_abstain")
        say(stance != "UNRESOLVED", "unresolved_target_requires_unresolved_stance")
    spans = root.get("evidence_spans")
    if not isinstance(spans, list):
        errors.append("evidence_spans_not_array")
        spans = []
    else:
        say(len(spans) > MOST_SPANS, "too_many_evidence_spans")
    hay, grounded, roles = _plain_print(context), 0, set()
    for i, span in enumerate(spans):
        if not isinstance(span, dict):
            errors.append(f"evidence_{i}_not_object")
            continue
        errors += _keys(span, EVIDENCE, f"evidence_{i}_")
        text, role = span.get("text"), span.get("role")
        if kind_of(text) != "string" or not text.strip():
            errors.append(f"evidence_{i}_empty_text")
        elif (needle := _plain_print(text)) and needle in hay:
            grounded += 1
        else:
            errors.append(f"evidence_{i}_not_grounded")
        if _one_of(role, ROLES):
            roles.add(str(role))
        else:
            errors.append(f"evidence_{i}_invalid_role")
    if abstain is False and derived != "UNKNOWN":
        say(not grounded, "non_unknown_requires_grounded_evidence")
        say("STANCE" not in roles, "non_unknown_requires_stance_evidence")
    say(resolved is True and abstain is False and "TARGET_MENTION" not in roles, "resolved_target_requires_target_evidence")
    say(owner == "TARGET_AUTHORITY" and kind_of(proposition) == "string" and bool(proposition.strip()) and "PROPOSITION" not in roles, "target_owned_proposition_requires_proposition_evidence")
    return not errors, [plain(e) for e in errors], derived, grounded, len(roles), abstain if isinstance(abstain, bool) else None, resolved if isinstance(resolved, bool) else None


def validated(extraction: Column, context: Column, citation: Column) -> Column:
    """CHECKED as a struct."""
    names = [c.split()[0] for c in CHECKED.split(", ")]

    @F.pandas_udf(CHECKED)
    def make(texts: pd.Series, contexts: pd.Series, citations: pd.Series) -> pd.DataFrame:
        rows = [check(readable_object(t), c if isinstance(c, str) else "", n if isinstance(n, str) else None) for t, c, n in zip(texts, contexts, citations)]
        return pd.DataFrame(rows, columns=names).astype({"abstain": "boolean", "resolved": "boolean"})

    return make(extraction, context, citation)


def envelope(checked: Column) -> Column:
    """A struct of treatment, usable and reason: what may be built on of a checked extraction."""
    made = lambda treatment, usable, why: F.struct(treatment.alias("treatment"), F.lit(usable).alias("usable"), F.lit(why).alias("reason"))
    unknown = F.lit("UNKNOWN")
    abstains = F.coalesce(checked["abstain"], F.lit(False)) | (checked["derived_treatment"] == "UNKNOWN")
    return F.when(~checked["valid"], made(unknown, False, "schema_or_grounding_failure")).when(abstains, made(unknown, False, "validated_abstention")).otherwise(made(checked["derived_treatment"], True, "validated_structured_extraction"))


def tallies(checked: DataFrame, by: list[str] = ()) -> DataFrame:
    """Valid, usable, abstaining and unresolved extractions, of all rows or of each group; needs ``checked`` and ``envelope``."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("checked.valid")).alias("valid"),
        count(F.col("envelope.usable")).alias("usable"),
        count(F.col("checked.abstain")).alias("abstaining"),
        count(~F.col("checked.resolved")).alias("unresolved"),
    )
