"""What a passage does with an authority: whose statement it is, and how it treats a cited precedent.

Roles and the relations by cues alone or by cues linked to the target are Column expressions; in a pattern, T stands for the
target (its citation or name). The structured relation needs every place of the target, which Spark has no function for,
so it is made in Arrow batches.

Defined results for odd input: a null or empty passage is UNKNOWN; so is one without the target, and a target with neither a
citation that can be read nor a name; a role outside the known ones compares as UNKNOWN.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidelta.functions import lexical
from evidelta.functions.text import let, strip

# Cues of a role, in the order in which they are looked for.
REPORTER = r"\b\d+\s+U\.?\s*S\.?\s+(?:\d+|,\s*at\s+\d+)\b"
CASE_NAME = r"\b[A-Z][A-Za-z0-9.&'’\- ]{1,60}\s+v\.\s+[A-Z][A-Za-z0-9.&'’\- ]{1,60}\b"
SYLLABUS = r"\bHeld\s*:"
SECONDARY = [r"\bL\.\s*Rev\.", r"\bLaw Review\b", r"\bLaw Journal\b", r"\bA\.L\.R\.", r"\bAm\.\s*Jur\.", r"\bC\.J\.S\.", r"\bTreatise\b"]
SELF_HOLDING = [rf"\bwe\s+(?:therefore\s+|now\s+)?{w}\b" for w in ("hold", "conclude", "decide", "determine")] + [r"\bwe\s+think\s+that\b", r"\bthe\s+court\s+(?:therefore\s+)?holds\b"]
ATTRIBUTION = [r"\bwe\s+(?:previously\s+)?held\s+in\b", r"\bas\s+we\s+held\s+in\b", r"\bour\s+decision\s+in\b", r"\bquoting\b", r"\bquoted\s+in\b", r"\bciting\b", r"\bsee\s+[A-Z][A-Za-z0-9.&'’\- ]+\s+v\.\s+"]
ROLE_STRENGTH = {"COURT_SELF_HOLDING": 3, "REPORTER_SYLLABUS_HOLDING": 2, "UNKNOWN": 1, "ATTRIBUTED_PRIOR_AUTHORITY": 0, "SECONDARY_SOURCE": 0}

# Cues of a relation, wherever the target stands.
LOOSE_CUES = {
    "AFFIRMATIVE_USE": [r"\bdeclines?\s+to\s+overrule\b", r"\breaffirm(?:s|ed|ing)?\b", r"\bis\s+governed\s+by\b", r"\bapplies?\s+to\b", r"\bapply(?:ing|ied)?\b.{0,80}\bframework\b", r"\bprevail\s+on\s+(?:his|her|the)\b.{0,60}\bclaim\b", r"\bgatekeeping\b.{0,80}\bapplies?\b"],
    "NEGATIVE_TREATMENT": [r"\bshould\s+be\s+and\s+now\s+is\s+overruled\b", r"\bwe\s+(?:therefore\s+)?overrule\b", r"\bis\s+hereby\s+overruled\b", r"\bis\s+overruled\b"],
    "DISTINGUISHES_OR_LIMITS": [r"\bin\s+contrast\s+to\b", r"\bunlike\b", r"\bdistinguish(?:ed|es|ing)?\b", r"\bdoes\s+not\s+mandate\b", r"\bdoes\s+not\s+apply\b", r"\bdid\s+not\s+apply\b", r"\bnot\s+triggered\b"],
}
# Cues of a relation that are linked to the target T.
LINKED_CUES = {
    "AFFIRMATIVE_USE": [
        r"\bdeclines?\s+to\s+overrule\s+(?:[^.;:]{0,40}\s+)?T",
        r"\breaffirm(?:s|ed|ing)?\s+(?:[^.;:]{0,50}\s+)?T",
        r"\b(?:is|are|was|were)\s+governed\s+by\s+T",
        r"\b(?:under|following|pursuant\s+to)\s+T",
        r"T.{0,90}\b(?:applies?|governs?|controls?)\b",
        r"\b(?:apply|applies|applied|applying)\s+(?:[^.;:]{0,50}\s+)?T",
        r"T.{0,120}\b(?:framework|rule|standard)\b.{0,80}\b(?:applies?|governs?|controls?)\b",
        r"\bwe\s+hold\b.{0,160}T",
        r"\bin\s+light\s+of\s+T",
        r"\bas\s+we\s+(?:stated|explained|held)\s+in\s+T",
        r"T.{0,100}\bset\s+forth\s+(?:a|the)\s+framework\b",
        r"T.{0,120}\b(?:guide|guides|guided)\s+our\s+analysis\b",
    ],
    "DISTINGUISHES_OR_LIMITS": [
        r"\bin\s+contrast\s+to\s+T",
        r"\bunlike\s+(?:in\s+)?T",
        r"\bdistinguish(?:ed|es|ing)?\s+(?:[^.;:]{0,40}\s+)?T",
        r"T.{0,90}\b(?:does|did)\s+not\s+(?:apply|mandate|control|govern|require)\b",
        r"\bdeclines?\s+to\s+extend\s+(?:[^.;:]{0,30}\s+)?T",
        r"T.{0,90}\b(?:is|was)\s+distinguishable\b",
        r"T.{0,90}\b(?:is|was)\s+limited\s+to\b",
        r"T.{0,120}\b(?:provides?|provided)\s+no\s+support\b",
        r"T.{0,120}\b(?:departs?|departed)\s+from\b",
    ],
    "NEGATIVE_TREATMENT": [
        r"T.{0,90}\bshould\s+be\s+and\s+now\s+is\s+overruled\b",
        r"T.{0,90}\b(?:is|was|has\s+been)\s+(?:expressly\s+)?overruled\b",
        r"\bwe\s+(?:therefore\s+)?overrule\s+(?:[^.;:]{0,40}\s+)?T",
        r"T.{0,90}\b(?:is|was|has\s+been)\s+abrogated\b",
        r"T.{0,120}\b(?:is|was|are|were)\s+no\s+longer\s+(?:controlling|binding|good\s+law)\b",
        r"T.{0,120}\bshould\s+no\s+longer\s+be\s+regarded\s+as\s+mandatory\b",
        r"T.{0,90}\b(?:has\s+been|was)\s+undermined\b",
        r"T.{0,90}\b(?:is|was)\s+disapproved\b",
    ],
}
# What the deciding court does with the target T, outside what it reports of the target's own holding.
ACTIONS = [
    ("OVERRULE", r"T(?:\s|,|\([^)]*\)){0,12}should\s+be\s+and\s+now\s+is\s+overruled\b"),
    ("OVERRULE", r"\bwe\s+(?:therefore\s+)?overrule\b[^.;:]{0,90}T"),
    ("OVERRULE", r"T(?:\s|,|\([^)]*\)){0,18}(?:is|are|was|were|has\s+been)\s+(?:expressly\s+)?overruled\b"),
    ("WEAKEN", r"T.{0,220}\b(?:is|are|was|were)\s+no\s+longer\s+(?:controlling|binding|good\s+law)\b"),
    ("WEAKEN", r"T.{0,260}\bshould\s+no\s+longer\s+be\s+regarded\s+as\s+mandatory\b"),
    ("WEAKEN", r"T.{0,420}\b(?:was|were|is|are)\s+wrongly\s+decided\b"),
    ("LIMIT", r"\bdeclines?\s+to\s+extend\s+T"),
    ("LIMIT", r"\b(?:find|finds|found)\b.{0,160}\birrelevant\b.{0,240}T"),
    ("LIMIT", r"\bstrictly\s+based\b.{0,240}\bfacts?\b.{0,260}T"),
    ("LIMIT", r"T.{0,220}\b(?:provides?|provided)\s+no\s+support\b"),
    ("LIMIT", r"T.{0,220}\b(?:departs?|departed)\s+from\b"),
    ("LIMIT", r"T.{0,180}\b(?:does|did)\s+not\s+(?:apply|mandate|control|govern|require)\b"),
    ("LIMIT", r"\bin\s+contrast\s+to\s+T"),
    ("LIMIT", r"\bunlike\s+(?:in\s+)?T"),
    ("KEEP", r"\bdeclines?\s+to\s+overrule\s+T"),
    ("KEEP", r"\breaffirm(?:s|ed|ing)?\b.{0,90}T"),
    ("APPLY", r"\bunder\s+T"),
    ("APPLY", r"\bin\s+light\s+of\s+T"),
    ("APPLY", r"\bas\s+we\s+(?:stated|explained|held)\s+in\s+T"),
    ("APPLY", r"T.{0,180}\b(?:guide|guides|guided)\s+our\s+analysis\b"),
    ("APPLY", r"T.{0,240}\bset\s+forth\s+(?:a|the)\s+framework\b"),
    ("APPLY", r"T.{0,220}\b(?:factors?|principles?|test)\b.{0,120}\b(?:guide|guides|guided)\s+our\s+analysis\b"),
    ("APPLY", r"T.{0,160}\b(?:applies?|governs?|controls?)\b"),
    ("APPLY", r"\bwe\s+hold\b.{0,180}T"),
]
#: The frozen form of the second action, whose gap may cross the end of a sentence.
CROSSING_OVERRULE = r"\bwe\s+(?:therefore\s+)?overrule\b.{0,90}T"
HOLDING = re.compile(r"(?:,\s*)?(?:this\s+Court|the\s+Court)?\s*(?:had\s+)?held\s+(?:that\s+)?", re.I)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'])")
MASK, NEAR = " [ATTRIBUTED_TARGET_PROPOSITION] ", 140

NEVER = r"(?!)"


def _ci(patterns: list[str]) -> list[str]:
    return ["(?iu)" + p for p in patterns]


def role(window: Column) -> Column:
    """A struct of role, confidence, cues, citations and case names of a passage."""
    return let(strip(F.coalesce(window, F.lit(""))), lambda text: let(_cues(text), _role))


def _cues(text: Column) -> Column:
    found = {n: lexical.first_matches(text, _ci(p)) for n, p in (("secondary", SECONDARY), ("own", SELF_HOLDING), ("attributed", ATTRIBUTION))}
    every = {"citations": F.regexp_extract_all(text, F.lit("(?iu)" + REPORTER), F.lit(0)), "names": F.regexp_extract_all(text, F.lit(CASE_NAME), F.lit(0)), "syllabus": F.regexp_like(text, F.lit("(?iu)" + SYLLABUS))}
    return F.struct(*[c.alias(n) for n, c in {**found, **every}.items()])


def _role(x: Column) -> Column:
    secondary, own, attributed, citations, names = (x[n] for n in ("secondary", "own", "attributed", "citations", "names"))
    cited = (F.size(citations) > 0) | (F.size(names) > 0)

    def made(name: str, confidence: str, cues: Column) -> Column:
        return F.struct(F.lit(name).alias("role"), F.lit(confidence).alias("confidence"), cues.cast("array<string>").alias("cues"), citations.alias("citations"), names.alias("case_names"))

    return (
        F.when(x["syllabus"], made("REPORTER_SYLLABUS_HOLDING", "high", F.array(F.lit("Held:"))))
        .when(F.size(own) > 0, made("COURT_SELF_HOLDING", "high", own))
        .when(F.size(secondary) > 0, made("SECONDARY_SOURCE", "high", secondary))
        .when((F.size(attributed) > 0) & cited, made("ATTRIBUTED_PRIOR_AUTHORITY", "high", attributed))
        .when(cited, made("ATTRIBUTED_PRIOR_AUTHORITY", "medium", F.array(F.lit("external judicial citation/name"))))
        .otherwise(made("UNKNOWN", "low", F.array()))
    )


def role_change(before: Column, after: Column) -> Column:
    """REGRESSION, IMPROVEMENT, UNCHANGED or UNKNOWN between two roles."""
    rank = lambda r: F.coalesce(*[F.when(r == k, F.lit(n)) for k, n in ROLE_STRENGTH.items()])
    b, a = rank(before), rank(after)
    return F.when((b >= 2) & (a == 0), "REGRESSION").when((b == 0) & (a >= 2), "IMPROVEMENT").when((before == after) & b.isNotNull(), "UNCHANGED").otherwise("UNKNOWN")


def _relation(name: str | Column, confidence: str, cues: Column, categories: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("relation"), F.lit(confidence).alias("confidence"), cues.cast("array<string>").alias("cues"), categories.cast("array<string>").alias("categories"))


def loose_relation(context: Column, citation: Column, term: Column) -> Column:
    """The relation by the first kind of cue that the passage holds: affirmative, negative, distinguishing. The target's name has to stand there as it is written."""
    bound = F.struct(lexical.plain_quotes(context).alias("text"), lexical.plain_quotes(term).alias("name"), lexical.citation_pattern(citation).alias("cite"))
    return let(bound, lambda x: let(_loose_cues(x["text"], x["name"], x["cite"]), _loose))


def _loose_cues(text: Column, name: Column, cite: Column) -> Column:
    there = F.coalesce(F.regexp_like(text, F.concat(F.lit("(?iu)"), cite)), F.lit(False)) | ((name != "") & F.contains(F.lower(text), F.lower(name)))
    return F.struct((there & (text != "")).alias("there"), *[F.when(there, lexical.first_matches(text, _ci(p))).otherwise(F.array().cast("array<string>")).alias(k) for k, p in LOOSE_CUES.items()])


def _loose(x: Column) -> Column:
    none = F.array()
    out = F.when(~x["there"], _relation("UNKNOWN", "low", none, none))
    for kind in LOOSE_CUES:
        out = out.when(F.size(x[kind]) > 0, _relation(kind, "high", x[kind], F.array(F.lit(kind))))
    return out.otherwise(_relation("MENTION_ONLY", "medium", F.array(F.lit("target authority present without stronger local cue")), none))


def linked_relation(context: Column, citation: Column, term: Column) -> Column:
    """The relation by cues linked to the target; cues of several kinds are MIXED_OR_CONFLICTING."""
    bound = F.struct(lexical.plain_print(context).alias("text"), F.coalesce(lexical.target_pattern(citation, term), F.lit(NEVER)).alias("target"))
    return let(bound, lambda x: let(_linked_cues(x["text"], x["target"]), _linked))


def _linked_cues(text: Column, target: Column) -> Column:
    there = (text != "") & F.regexp_like(text, F.concat(F.lit("(?iu)"), target))

    def linked(pattern: str) -> Column:
        before, after = pattern.split("T", 1) if pattern.startswith("T") else pattern.rsplit("T", 1)
        return F.concat(F.lit("(?iu)" + before), target, F.lit(after))

    none = F.array().cast("array<string>")
    return F.struct(there.alias("there"), *[F.when(there, lexical.all_matches(text, [linked(p) for p in patterns])).otherwise(none).alias(k) for k, patterns in LINKED_CUES.items()])


def _linked(x: Column) -> Column:
    kinds = F.array_compact(F.array(*[F.when(F.size(x[k]) > 0, k) for k in LINKED_CUES]))
    cues, none = F.concat(*[x[k] for k in LINKED_CUES]), F.array()
    return (
        F.when(~x["there"], _relation("UNKNOWN", "low", none, none))
        .when(F.size(kinds) > 1, _relation("MIXED_OR_CONFLICTING", "high", cues, kinds))
        .when(F.size(kinds) == 1, _relation(F.get(kinds, F.lit(0)), "high", cues, kinds))
        .otherwise(_relation("MENTION_ONLY", "medium", F.array(F.lit("target authority present without target-linked relation cue")), none))
    )


def from_actions(actions: set[str]) -> tuple[str, str]:
    """Relation and confidence of what the court does: negative treatment outweighs everything, use and limits together are mixed."""
    if actions & {"OVERRULE", "WEAKEN"}:
        return "NEGATIVE_TREATMENT", "high"
    used, limited = bool(actions & {"APPLY", "KEEP"}), "LIMIT" in actions
    if used or limited:
        return "MIXED_OR_CONFLICTING" if used and limited else "AFFIRMATIVE_USE" if used else "DISTINGUISHES_OR_LIMITS", "high"
    return "MENTION_ONLY", "medium"


@lru_cache(maxsize=4096)
def _action_patterns(target: str, crossing: bool) -> list[tuple[str, re.Pattern]]:
    def linked(p: str) -> str:
        return target + p[1:] if p.startswith("T") else p[:-1] + target

    return [(a, re.compile(linked(CROSSING_OVERRULE if crossing and i == 1 else p), re.I)) for i, (a, p) in enumerate(ACTIONS)]


def masked(text: str, target: re.Pattern) -> tuple[str, list[str]]:
    """``text`` with what the target itself is reported to have held masked, and those propositions."""
    spans = []
    for m in target.finditer(text):
        holding = HOLDING.search(text, m.start())
        if not holding or holding.start() - m.start() > NEAR:
            continue
        end = SENTENCE_END.search(text, holding.end())
        stop = end.start() if end else len(text)
        if text[holding.end() : stop].strip():
            spans.append((holding.end(), stop))
    said = [text[a:b].strip() for a, b in spans]
    for a, b in reversed(spans):
        text = text[:a] + MASK + text[b:]
    return text, said


FRAME = "target_present boolean, owner string, proposition string, actions array<string>, cues array<string>, relation string, confidence string, abstention string"


def frame(text: str, target: str | None, crossing: bool) -> tuple:
    """One row of FRAME for a passage in plain print."""
    nothing = (False, "UNKNOWN", "", [], [], "UNKNOWN", "low")
    if not text:
        return (*nothing, "empty_context")
    pattern = re.compile(target, re.I) if target else None
    if pattern is None or not pattern.search(text):
        return (*nothing, "target_absent")
    rest, said = masked(text, pattern)
    found = [(a, m.group().strip()) for a, p in _action_patterns(target, crossing) for m in p.finditer(rest)]
    actions, cues = list(dict.fromkeys(a for a, _ in found)), list(dict.fromkeys(c for _, c in found))
    relation, confidence = from_actions(set(actions))
    why = None
    if relation == "MENTION_ONLY":
        why = "attributed_target_holding_not_current_treatment" if said else "no_current_court_treatment_cue"
    return True, "TARGET_AUTHORITY" if said else "CURRENT_COURT", " ".join(said)[:1600], actions, cues, relation, confidence, why


def structured_relation(context: Column, citation: Column, term: Column, crossing: bool = False) -> Column:
    """FRAME as a struct: the court's own actions towards the target decide, not what the target is reported to have held. ``crossing``: as in the frozen form."""
    names = [c.split()[0] for c in FRAME.split(", ")]

    @F.pandas_udf(FRAME)
    def make(texts: pd.Series, targets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([frame(t or "", p if isinstance(p, str) else None, crossing) for t, p in zip(texts, targets)], columns=names)

    return make(lexical.plain_print(context), lexical.target_pattern(citation, term))


# Stances of a court, by the treatment that they mean.
STANCES = {
    "AFFIRMATIVE_USE": ["ADOPTS", "APPLIES", "RELIES_ON", "REAFFIRMS", "DECLINES_TO_OVERRULE"],
    "DISTINGUISHES_OR_LIMITS": ["DISTINGUISHES", "DECLINES_TO_EXTEND", "LIMITS"],
    "NEGATIVE_TREATMENT": ["OVERRULES", "WEAKENS", "DISAPPROVES"],
    "MENTION_ONLY": ["DESCRIBES", "CITES", "QUOTES"],
}


def treatment_of(stance: Column) -> Column:
    out = F.lit("UNKNOWN")
    for treatment, stances in STANCES.items():
        out = F.when(stance.isin(*stances), treatment).otherwise(out)
    return out


def transition(before: Column, after: Column, before_role: Column, after_role: Column, relation: Column | None = None, threshold: float = 0.34, mixed: bool = True) -> Column:
    """A struct of classification and reason for the support of a claim before and after.

    Scores and roles alone decide without a ``relation``; with one, an explicit negative treatment is a change of the world,
    a limit (and, if ``mixed``, a mixed relation) is unknown, an affirmative use keeps a claim that has support on both sides.
    """
    ok_before, ok_after = F.coalesce(before >= threshold, F.lit(False)), F.coalesce(after >= threshold, F.lit(False))
    made = lambda k, why: F.struct(F.lit(k).alias("classification"), F.lit(why).alias("reason"))
    plain = [
        (ok_before & ~ok_after, "REGRESSION", "lexical_support"),
        (~ok_before, "UNKNOWN", "baseline_below_lexical_threshold"),
        (role_change(before_role, after_role) == "REGRESSION", "REGRESSION", "authority_role"),
        (F.lit(True), "NO_REGRESSION_DETECTED", "no_high_confidence_downgrade"),
    ]
    rules = plain if relation is None else [
        (relation == "NEGATIVE_TREATMENT", "WORLD_CHANGE", "explicit_negative_treatment"),
        (relation == "DISTINGUISHES_OR_LIMITS", "UNKNOWN", "distinguished_or_limited_authority"),
        (F.lit(mixed) & (relation == "MIXED_OR_CONFLICTING"), "UNKNOWN", "mixed_or_conflicting_relation"),
        ((relation == "AFFIRMATIVE_USE") & ok_before & ~ok_after, "REGRESSION", "lexical_support"),
        ((relation == "AFFIRMATIVE_USE") & ok_before & ok_after, "NO_REGRESSION_DETECTED", "affirmative_precedent_use"),
        *[(c, k, f"v0.7_fallback:{why}") for c, k, why in plain],
    ]
    out = F.when(rules[0][0], made(*rules[0][1:]))
    for condition, kind, why in rules[1:]:
        out = out.when(condition, made(kind, why))
    return out


def extraction_transition(before: Column, after: Column, before_role: Column, after_role: Column, envelope: Column, threshold: float = 0.34) -> Column:
    """The same by a validated extraction's envelope (``usable``, ``reason``, ``treatment``)."""
    inner = transition(before, after, before_role, after_role, envelope["treatment"], threshold)
    unusable = F.struct(F.lit("UNKNOWN").alias("classification"), F.concat(F.lit("v0.11:"), envelope["reason"]).alias("reason"))
    return F.when(~envelope["usable"], unusable).otherwise(F.struct(inner["classification"].alias("classification"), F.concat(F.lit("v0.11:"), inner["reason"]).alias("reason")))
