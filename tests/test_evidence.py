import json
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evidelta.functions import anchors, lexical, relations
from evidelta.operators import evaluation, extraction, windows


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, (list, int, float)) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_words_sentences_and_windows(spark):
    t = F.col("t")
    assert one(spark, lexical.tokens(t), t="The Court's 2 rules — it’s A b 1996 don't") == ["court's", "rules", "1996", "don't"]
    assert one(spark, lexical.pairs(lexical.tokens(t)), t="alpha beta alpha beta") == ["alpha beta", "beta alpha"]
    assert one(spark, lexical.pairs(lexical.tokens(t)), t="alpha") == [] == one(spark, lexical.tokens(t), t=None)
    assert one(spark, lexical.sentences(t), t="  One. Two! three? 4. ") == ["One.", "Two! three?", "4."]
    assert one(spark, lexical.windows(lexical.sentences(t), 3), t="A. B. C.") == ["A.", "A. B.", "A. B. C.", "B.", "B. C.", "C."]
    assert one(spark, lexical.windows(lexical.sentences(t)), t=" ") == [] == one(spark, lexical.windows(lexical.sentences(t)), t=None)


def score(claim, window):
    """Brute force in plain Python."""
    def words(x):
        return [w for w in re.findall(lexical.WORD, x.lower()) if w not in lexical.STOPWORDS and len(w) > 1]

    c, w = words(claim), words(window)
    cs, ws, cp, wp = set(c), set(w), set(zip(c, c[1:])), set(zip(w, w[1:]))
    n = len(cs & ws)
    f1 = 2 * n / (len(cs) + len(ws)) if n else 0.0
    return 0.55 * f1 + 0.35 * (n / len(cs) if cs else 0) + 0.10 * (len(cp & wp) / len(cp) if cp else 0)


def test_best_window_and_top_windows(spark):
    text = "The ferry sailed north. The clerk was absent. A toll on the ferry is unlawful under the charter. Nothing else."
    claims = [("a", "toll on the ferry is unlawful", "k"), ("b", "zebra", "k"), ("c", "toll", "none"), ("d", None, "k"), ("d", None, "k")]
    df = spark.createDataFrame(claims, "id string, claim string, key string")
    src = windows.source_windows(spark.createDataFrame([("k", text, 1)], "key string, text string, place int"), "key", "text")
    rows = {r.id: r for r in windows.best_window(windows.paired(df, "claim", src, "key")).collect()}
    every = one(spark, lexical.windows(lexical.sentences(F.col("t"))), t=text)
    best = max(every, key=lambda w: score(claims[0][1], w))
    assert rows["a"].best.text == best and abs(rows["a"].best.score - score(claims[0][1], best)) < 1e-9
    assert rows["b"].best is None and rows["c"].best is None and rows["d"].best is None
    top = {r.id: r.top for r in windows.top_windows(windows.paired(df, "claim", src, "key"), 3).collect()}
    assert [w.text for w in top["a"]][0] == "A toll on the ferry is unlawful under the charter." and [w.place for w in top["b"]] == [0, 1, 2] and top["c"] is None


def test_metrics(spark):
    rows = spark.createDataFrame([(0.9, "supported"), (0.1, "supported"), (0.8, "unsupported"), (0.2, "unsupported"), (None, "unsupported"), (0.9, None)], "s double, e string")
    got = evaluation.ratios(evaluation.binary_counts(rows, evaluation.predict(F.col("s"), 0.34), F.col("e"))).first()
    assert (got.tp, got.fn, got.fp, got.tn, got.total) == (1, 1, 1, 3, 6) and got.recall == 0.5 and got.false_positive_rate == 0.25
    assert evaluation.ratios(evaluation.binary_counts(rows.limit(0), F.col("e"), F.col("e"))).first().accuracy == 0.0
    a = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "k int, correct boolean")
    b = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False), (5, True)], "k int, correct boolean")
    assert {r.k: r.outcome for r in evaluation.compare(a, b, "k").collect()} == {1: "same_correct", 2: "broken", 3: "fixed", 4: "same_wrong"}
    assert {(r.k, r.side) for r in evaluation.key_sets(a, b, "k").collect()} == {(5, "right_only")}
    assert evaluation.differs(a, a).collect() == [] and len(evaluation.differs(a, b).collect()) == 5
    names = spark.createDataFrame([("g", 1, 0.9), ("g", 2, 0.5), ("h", 1, 0.9), ("h", 2, 0.8), ("i", 1, 0.4), ("j", 1, 0.6), ("l", 2, 0.7), ("l", 1, 0.7)], "g string, o int, s double")
    assert {(r.g, r.o) for r in evaluation.top_with_margin(names, "g", F.col("s"), "o").collect()} == {("g", 1), ("j", 1)}


def test_phrases_citations_and_scores(spark):
    held = one(spark, lexical.phrase_contract(F.col("t"), F.col("p")), t="The “toll” &amp; the ferry – both.", p=[" ferry - both ", "TOLL&", "", "lantern"])
    assert (held.support, held.matched, held.missing) == ("partial", ["ferry - both"], ["TOLL&", "lantern"])
    assert one(spark, lexical.phrase_contract(F.col("t"), F.col("p")), t=None, p=[""]).support == "unknown"
    parts = one(spark, lexical.citation_parts(F.col("t")), t="384 U. S. 436 (1966)")
    assert (parts.volume, parts.page) == (384, 436) and one(spark, lexical.citation_parts(F.col("t")), t="see 384") is None
    pattern = one(spark, lexical.target_pattern(F.col("t"), F.col("n")), t="384 U.S. 436", n="Mi-a")
    assert re.search(pattern, "x 384 U. S. 436.", re.I) and re.search(pattern, "M i — A", re.I) and not re.search(pattern, "1384 U.S. 436", re.I)
    assert one(spark, lexical.target_pattern(F.col("t"), F.col("n")), t="none", n=None) is None
    assert abs(sum(one(spark, lexical.softmax(F.array(F.lit(700.0), F.lit(710.0), F.lit(1.0))), t="")) - 1) < 1e-12
    nli = one(spark, lexical.label_scores(F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(" Entailment"), F.lit("other"))), t="")
    assert 0.7 < nli.entailment < 0.74 and nli.neutral == 0.0
    assert abs(one(spark, lexical.bag_recall(F.split("a", " "), F.split("b", " ")), a="x x y", b="x y z") - 2 / 3) < 1e-12
    assert one(spark, lexical.in_context(F.col("t"), F.lit("cd"), 1), t="abcdef") == "bcde" and one(spark, lexical.in_context(F.col("t"), F.lit("zz"), 1), t="abcdef") == "zz"


ROLES = [
    ("Held: the toll falls.", "REPORTER_SYLLABUS_HOLDING", "high"),
    ("We therefore hold, citing 12 U. S. 3, that it falls.", "COURT_SELF_HOLDING", "high"),
    ("See 12 Harv. L. Rev. 3.", "SECONDARY_SOURCE", "high"),
    ("Quoting 12 U.S. 34 the clerk agreed.", "ATTRIBUTED_PRIOR_AUTHORITY", "high"),
    ("In Stelow v. Brand the toll fell.", "ATTRIBUTED_PRIOR_AUTHORITY", "medium"),
    ("The toll fell.", "UNKNOWN", "low"),
    (None, "UNKNOWN", "low"),
]


def test_roles_and_transitions(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(ROLES)], "i int, t string")
    got = {r.i: (r.r.role, r.r.confidence) for r in df.select("i", relations.role(F.col("t")).alias("r")).collect()}
    assert got == {i: tuple(x[1:]) for i, x in enumerate(ROLES)}
    own, other = F.lit("COURT_SELF_HOLDING"), F.lit("SECONDARY_SOURCE")
    cases = [
        (0.5, 0.1, own, own, None, "REGRESSION", "lexical_support"),
        (0.1, 0.5, own, own, None, "UNKNOWN", "baseline_below_lexical_threshold"),
        (0.5, 0.5, own, other, None, "REGRESSION", "authority_role"),
        (0.5, 0.5, other, own, None, "NO_REGRESSION_DETECTED", "no_high_confidence_downgrade"),
        (0.5, 0.1, own, own, "NEGATIVE_TREATMENT", "WORLD_CHANGE", "explicit_negative_treatment"),
        (0.5, 0.5, own, other, "AFFIRMATIVE_USE", "NO_REGRESSION_DETECTED", "affirmative_precedent_use"),
        (0.1, 0.5, own, other, "AFFIRMATIVE_USE", "UNKNOWN", "v0.7_fallback:baseline_below_lexical_threshold"),
        (0.5, 0.5, own, own, "MIXED_OR_CONFLICTING", "UNKNOWN", "mixed_or_conflicting_relation"),
        (0.5, 0.5, own, other, "MENTION_ONLY", "REGRESSION", "v0.7_fallback:authority_role"),
    ]
    row = spark.range(1).select(*[relations.transition(F.lit(b), F.lit(a), r, s, None if k is None else F.lit(k)).alias(f"c{i}") for i, (b, a, r, s, k, *_) in enumerate(cases)]).first()
    assert [(c.classification, c.reason) for c in row] == [c[5:] for c in cases]


#: Passage about 12 U.S. 34 (Stelow), then the relation by loose cues, by linked cues, and of the structured frame.
PASSAGES = [
    ("The Court declines to overrule Stelow today.", "AFFIRMATIVE_USE", "AFFIRMATIVE_USE", "AFFIRMATIVE_USE"),
    ("Stelow should be and now is overruled.", "NEGATIVE_TREATMENT", "NEGATIVE_TREATMENT", "NEGATIVE_TREATMENT"),
    ("Unlike Stelow, this toll is new.", "DISTINGUISHES_OR_LIMITS", "DISTINGUISHES_OR_LIMITS", "DISTINGUISHES_OR_LIMITS"),
    ("Under Stelow the toll falls. Unlike in Stelow, it is new.", "DISTINGUISHES_OR_LIMITS", "MIXED_OR_CONFLICTING", "MIXED_OR_CONFLICTING"),
    ("In Stelow, 12 U. S. 34, the Court held that the rule applies to ferries.", "AFFIRMATIVE_USE", "AFFIRMATIVE_USE", "MENTION_ONLY"),
    ("Unlike Brand, Stelow is old.", "DISTINGUISHES_OR_LIMITS", "MENTION_ONLY", "MENTION_ONLY"),
    ("S te low is cited.", "UNKNOWN", "MENTION_ONLY", "MENTION_ONLY"),
    ("Nothing is cited.", "UNKNOWN", "UNKNOWN", "UNKNOWN"),
    (None, "UNKNOWN", "UNKNOWN", "UNKNOWN"),
]


def test_relations(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PASSAGES)], "i int, t string")
    args = F.col("t"), F.lit("12 U.S. 34"), F.lit("Stelow")
    made = df.select("i", relations.loose_relation(*args)["relation"], relations.linked_relation(*args)["relation"], relations.structured_relation(*args)["relation"])
    assert {r[0]: tuple(r[1:]) for r in made.collect()} == {i: p[1:] for i, p in enumerate(PASSAGES)}
    crossing = F.lit("We overrule the toll. It was Stelow that set it."), F.lit("12 U.S. 34"), F.lit("Stelow")
    row = spark.range(1).select(relations.structured_relation(*crossing)["relation"].alias("a"), relations.structured_relation(*crossing, crossing=True)["relation"].alias("b"), relations.structured_relation(F.lit("x"), F.lit("none"), F.lit(None).cast("string"))["abstention"].alias("c")).first()
    assert tuple(row) == ("MENTION_ONLY", "NEGATIVE_TREATMENT", "target_absent")


def test_anchors(spark):
    source = "One two. The lantern was sealed by the clerk of Dovane in spring. " + "Filler words go here. " * 20 + "Stelow, 12 U.S. 34, was cited."
    assert anchors.span(source, "THE LANTERN was") == (9, 24)
    assert anchors.span(source.replace("lantern", "lan tern"), "the lantern was") == (9, 26)  # with the space after it
    place = anchors.nearly(source, "lantern was then sealed by a clerk of Dovane")
    assert source[slice(*place)] == "lantern was sealed by the clerk of Dovane"
    assert anchors.nearly(source, "zebra yak gnu emu owl") is None and anchors.span("", "x") is None

    def brute(text, anchor):
        words, want, best = re.findall("[a-z0-9]+", text.lower()), re.findall("[a-z0-9]+", anchor.lower()), None
        for width in range(max(5, len(want) - 3), len(want) + 6):
            for i in range(len(words) - width + 1):
                part = words[i : i + width]
                recall = sum(min(part.count(w), want.count(w)) for w in set(want)) / len(want)
                if recall >= 0.6:
                    s = 0.6 * recall + 0.4 * SequenceMatcher(None, want, part, autojunk=False).ratio()
                    if best is None or s > best[0]:
                        best = (s, i, width)
        return best if best and best[0] >= 0.72 else None

    import random

    r = random.Random(2)
    for _ in range(60):
        text = " ".join(r.choice("abcdefgh") * 2 for _ in range(60))
        anchor = " ".join(x if r.random() < 0.7 else "zz" for x in text.split()[20 : 20 + r.randrange(5, 12)])
        want, got = brute(text, anchor), anchors.nearly(text, anchor)
        assert (want is None) == (got is None)
        if want:
            assert text[slice(*got)].split() == text.split()[want[1] : want[1] + want[2]]
    df = spark.createDataFrame([(source, "the lantern was", 5), (source, "lantern was then sealed by a clerk of Dovane", 0), (None, "x", 5), (source, None, None)], "s string, a string, r int")
    got = [x[0] for x in df.select(anchors.anchor_context(F.col("s"), F.col("a"), F.col("r"))).collect()]
    assert got == ["two. The lantern was seal", "lantern was sealed by the clerk of Dovane", "", ""]
    wide = df.limit(1).select(anchors.relation_context(F.col("s"), F.col("a"), F.lit("12 U.S. 34"), F.lit(None).cast("string"), F.col("r")).alias("x")).first().x
    assert wide.target_found and wide.distance > 400 and wide.text.endswith("was cited.") and wide.resolution == "TARGET_EXPANDED_INTO_CONTEXT"


GOOD = {
    "target_authority": {"name": "Stelow", "citation": "12 U. S. 34", "resolved": True}, "proposition": "p", "proposition_owner": "CURRENT_COURT", "current_court_stance": "APPLIES", "treatment": "AFFIRMATIVE_USE",
    "claim_consequence": "SUPPORTS", "evidence_spans": [{"text": "under STELOW", "role": "STANCE"}, {"text": "Stelow", "role": "TARGET_MENTION"}], "confidence": "high", "abstain": False, "abstention_reason": None,
}
ABSTAINS = GOOD | {"current_court_stance": "UNRESOLVED", "treatment": "UNKNOWN", "confidence": "low", "abstain": True, "abstention_reason": "unclear", "evidence_spans": []}


@pytest.mark.parametrize(
    ("value", "errors"),
    [
        (GOOD, []),
        (ABSTAINS, []),
        ([], ["extraction_not_object"]),
        ({k: v for k, v in GOOD.items() if k != "confidence"} | {"z": 1}, ["missing_keys:confidence", "extra_keys:z", "invalid_confidence"]),
        (GOOD | {"target_authority": "Stelow"}, ["target_authority_not_object", "target_name_not_string", "target_citation_not_string", "target_resolved_not_boolean"]),
        (GOOD | {"target_authority": GOOD["target_authority"] | {"citation": "1 U.S. 2"}}, ["target_citation_mismatch"]),
        (GOOD | {"treatment": "MENTION_ONLY"}, ["treatment_stance_mismatch:MENTION_ONLY!=AFFIRMATIVE_USE"]),
        (GOOD | {"proposition_owner": ["x"], "abstain": "no"}, ["invalid_proposition_owner", "abstain_not_boolean"]),
        (GOOD | {"evidence_spans": [{"text": "absent", "role": "STANCE"}, 3, {"text": " ", "role": "X"}]}, ["evidence_0_not_grounded", "evidence_1_not_object", "evidence_2_empty_text", "evidence_2_invalid_role", "non_unknown_requires_grounded_evidence", "resolved_target_requires_target_evidence"]),
        (GOOD | {"evidence_spans": GOOD["evidence_spans"] * 5}, ["too_many_evidence_spans"]),
        (GOOD | {"proposition_owner": "TARGET_AUTHORITY"}, ["target_owned_proposition_requires_proposition_evidence"]),
        (ABSTAINS | {"abstention_reason": " "}, ["abstain_requires_reason"]),
        (GOOD | {"abstention_reason": "why"}, ["non_abstain_must_not_have_reason"]),
        (GOOD | {"target_authority": GOOD["target_authority"] | {"resolved": False}}, ["unresolved_target_requires_abstain", "unresolved_target_requires_unresolved_stance"]),
    ],
)
def test_contract(value, errors):
    assert extraction.check(extraction.readable_object(json.dumps(value)), "We decide under  Stelow.", "12 U.S. 34")[1] == errors


def test_envelopes(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps(ABSTAINS),), ("{",), (None,)], "t string")
    checked = df.withColumn("checked", extraction.validated(F.col("t"), F.lit("Under Stelow."), F.lit("12 U.S. 34"))).withColumn("envelope", extraction.envelope(F.col("checked")))
    assert [(x.envelope.treatment, x.envelope.usable, x.envelope.reason) for x in checked.collect()] == [("AFFIRMATIVE_USE", True, "validated_structured_extraction"), ("UNKNOWN", False, "validated_abstention"), *[("UNKNOWN", False, "schema_or_grounding_failure")] * 2]
    assert tuple(extraction.tallies(checked).first()) == (4, 2, 1, 1, 0)
    pair = F.lit(0.5), F.lit(0.5), F.lit("UNKNOWN"), F.lit("UNKNOWN")
    assert [x[0].reason for x in checked.select(relations.extraction_transition(*pair, F.col("envelope"))).collect()][:2] == ["v0.11:affirmative_precedent_use", "v0.11:validated_abstention"]
