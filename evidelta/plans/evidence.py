"""Queries on evidence: claims against sources, phrases, roles, relations and extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidelta.functions import anchors, lexical, relations
from evidelta.functions.text import WHITESPACE, fold_value, strip
from evidelta.operators import enrichment, evaluation, extraction, windows
from evidelta.session import load, ship_package, spread

THRESHOLD, STRICT_THRESHOLD, TOP = 0.34, 0.50, 8


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """One text for each citation (``key``: volume, reporter and page): that of the document with the least id, as the sources are unique by citation."""
    docs = load(spark, sf, "documents").where(F.col("source_citation").isNotNull() & F.col("text").isNotNull()).select(lexical.source_key(F.col("source_citation")).alias("key"), "doc_id", "text")
    return docs.groupBy("key").agg(F.min_by("text", "doc_id").alias("text"))


def claim_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "pairs"), "pair_id").select("pair_id", "claim_id", "claim", fold_value(F.col("expected_support")).alias("expected"), lexical.source_key(F.col("citation")).alias("key"))


def tokens_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Words, distinct words and distinct word pairs of every document."""
    words = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", lexical.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"), F.size(lexical.pairs(F.col("w"))).alias("distinct_pairs"))


def sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every window of one or two sentences of every document: its place and its length."""
    made = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", lexical.windows(lexical.sentences(F.col("text"))).alias("w"))
    return made.select("doc_id", F.posexplode("w").alias("place", "t")).select("doc_id", "place", F.char_length("t").alias("characters"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    pairs = windows.paired(claim_pairs(spark, sf), "claim", windows.source_windows(sources(spark, sf), "key", "text"), "key")
    return windows.best_window(pairs).withColumn("score", F.round(F.coalesce(F.col("best.score"), F.lit(0.0)), 6))


def lexical_support_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The best window of each training pair's source: what it shares with the claim, and ten thousandths of the score."""
    counts = [F.coalesce(F.col(f"best.{n}"), F.lit(0)).alias(n) for n in ("shared", "window_words", "shared_pairs")]
    return _scored(spark, sf).select("pair_id", "claim_id", *counts, F.floor(F.coalesce(F.col("best.score"), F.lit(0.0)) * 10000).cast("bigint").alias("score_4"))


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The eight windows of each training pair's source that retrieval ranks highest."""
    pairs = windows.paired(claim_pairs(spark, sf), "claim", windows.source_windows(sources(spark, sf), "key", "text"), "key")
    opened = windows.top_windows(pairs, TOP).select("pair_id", "claim_id", F.posexplode("top").alias("rank", "w"))
    return opened.select("pair_id", "claim_id", (F.col("rank") + 1).alias("rank"), "w.place", "w.shared", "w.window_words")


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts and ratios of the lexical scores, at two thresholds."""
    scored = _scored(spark, sf).crossJoin(F.broadcast(spark.createDataFrame([(THRESHOLD,), (STRICT_THRESHOLD,)], "threshold double")))
    counts = evaluation.binary_counts(scored.withColumn("p", F.when(F.col("score") >= F.col("threshold"), "supported").otherwise("unsupported")), F.col("p"), F.col("expected"), ["threshold"])
    return evaluation.ratios(counts).select(F.round(F.col("threshold") * 100).cast("int").alias("threshold_pct"), "tp", "fn", "fp", "tn", "total", *[F.floor(F.col(c) * 10000).cast("bigint").alias(c) for c in ("accuracy", "precision", "recall", "false_positive_rate", "false_negative_rate")])


def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf).withColumn("s", F.floor(F.coalesce(F.col("best.score"), F.lit(0.0)) * 10000).cast("bigint"))
    return evaluation.distribution(scored, F.col("s"), F.col("expected")).select("label", "rows", F.floor("mean").cast("bigint").alias("mean"), "least", "greatest")


def model_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the strict threshold fixes or breaks against the lenient one."""
    scored = _scored(spark, sf).groupBy("pair_id").agg(F.max_by(F.struct("score", "expected"), F.struct("score", "expected")).alias("m"))
    right = lambda t: scored.select("pair_id", F.coalesce(evaluation.predict(F.col("m.score"), t) == F.col("m.expected"), F.lit(False)).alias("correct"))
    return evaluation.compare(right(THRESHOLD), right(STRICT_THRESHOLD), "pair_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("pairs"))


def pair_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each label, with the distinct citations."""
    return claim_pairs(spark, sf).groupBy("expected").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("citations"))


def phrase_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """How far the source of each baseline case holds the phrases that its contract requires."""
    cases = load(spark, sf, "baseline").select("rec_id", lexical.source_key(F.col("authority.citation")).alias("key"), F.col("context.support_contract.required_phrases").alias("phrases"))
    ready = sources(spark, sf).select("key", lexical.contract_text(F.col("text")).alias("text"))
    judged = cases.join(ready, "key", "left").select("rec_id", lexical.phrase_contract(F.col("text"), F.col("phrases"), ready=True).alias("c"))
    return judged.select("rec_id", F.when(F.col("c.source_characters") == 0, "unknown").otherwise(F.col("c.support")).alias("support"), F.size("c.matched").alias("matched"), F.size("c.missing").alias("missing"))


def source_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Length and SHA-256 of every document as phrases are compared."""
    return load(spark, sf, "documents").select("doc_id", F.char_length("text").alias("characters"), F.sha2("text", 256).alias("sha256"))


def citation_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Volume, reporter and page of the training citations that begin with them."""
    parts = lexical.citation_parts(F.col("citation"))
    return load(spark, sf, "pairs").where(F.col("citation").isNotNull()).select("pair_id", "citation").distinct().select("pair_id", "citation", parts.alias("c")).select("pair_id", "citation", "c.volume", "c.page")


def enrichment_states(spark: SparkSession, sf: str) -> DataFrame:
    """What a look-up of each baseline citation among the documents finds: records of each state. A citation of several cases is ambiguous."""
    docs = load(spark, sf, "documents").where(F.col("source_citation").isNotNull()).select(lexical.source_key(F.col("source_citation")).alias("key"), "case_name")
    known = docs.groupBy("key").agg(F.count_distinct("case_name").alias("cases"))
    cited = load(spark, sf, "baseline").select(F.nullif(strip(F.col("authority.citation")), F.lit("")).alias("citation")).select("citation", lexical.source_key(F.col("citation")).alias("key"))
    status = F.when(F.col("cases").isNull(), 404).when(F.col("cases") > 1, 300).otherwise(200)
    state = F.when(F.col("citation").isNull(), "NO_CITATION").otherwise(enrichment.lookup_state(status))
    return cited.join(known, "key", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("records"))


def authority_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Whose statement each window of every document is: windows of each role."""
    made = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(F.explode(lexical.windows(lexical.sentences(F.col("text")))).alias("t"))
    return made.select(relations.role(F.col("t")).alias("r")).groupBy("r.role", "r.confidence").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.size("r.cues")).alias("cues"))


def _role_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Supported against unsupported pairs of one claim, with score and role of their best windows."""
    scored = _scored(spark, sf).join(sources(spark, sf), "key", "left")
    own = scored.select("claim_id", "pair_id", "expected", "score", relations.role(lexical.in_context(F.coalesce("text", F.lit("")), F.col("best.text"), 320))["role"].alias("role"))
    side = lambda label, name: own.where(F.col("expected") == label).groupBy("claim_id").agg(F.min(F.struct("pair_id", "score", "role")).alias(name))
    return side("supported", "b").join(side("unsupported", "c"), "claim_id")


def role_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """What happens to a claim's support between its supported and its unsupported citation, by score and role."""
    moved = relations.transition(F.col("b.score"), F.col("c.score"), F.col("b.role"), F.col("c.role"), threshold=THRESHOLD)
    return _role_pairs(spark, sf).select(moved.alias("t")).groupBy("t.classification", "t.reason").agg(F.count(F.lit(1)).alias("claims"))


def identity_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """The control: a row against itself never regresses."""
    moved = relations.transition(F.col("b.score"), F.col("b.score"), F.col("b.role"), F.col("b.role"), threshold=THRESHOLD)
    return _role_pairs(spark, sf).select(moved.alias("t")).groupBy("t.classification", "t.reason").agg(F.count(F.lit(1)).alias("claims"))


#: A case cited in a sentence: what stands before "v." is the target's name.
CITED = r"\b([A-Z][a-z]+) v\. [A-Z]"


def citing_relations(spark: SparkSession, sf: str) -> DataFrame:
    """How the sentences of all documents treat the first case that each cites: sentences of each relation, by cues alone and by cues linked to the case."""
    parts = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(F.explode(lexical.sentences(F.regexp_replace("text", r" v\.", " v_"))).alias("t"))
    cited = parts.select(F.replace("t", F.lit(" v_"), F.lit(" v.")).alias("t")).withColumn("term", F.regexp_extract("t", CITED, 1)).where(F.col("term") != "")
    none = F.lit(None).cast("string")
    made = cited.select(relations.loose_relation(F.col("t"), none, F.col("term"))["relation"].alias("loose"), relations.linked_relation(F.col("t"), none, F.col("term"))["relation"].alias("linked"))
    return made.groupBy("loose", "linked").agg(F.count(F.lit(1)).alias("sentences"))


def _challenges(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "heldout").where(F.col("item_kind") == "relation")
    picked = rows.select("heldout_id", "challenge_id", "target_citation", "target_term", "anchor", "radius", F.col("expected_relation").alias("expected"), "difficulty", lexical.source_key(F.col("source_citation")).alias("key"))
    return spread(picked, "heldout_id").join(sources(spark, sf), "key", "left")


def _related(spark: SparkSession, sf: str) -> DataFrame:
    """The relation of each held-out challenge: cues alone, linked cues, the court's actions."""
    ship_package(spark)
    c = F.col
    with_context = _challenges(spark, sf).withColumn("x", anchors.relation_context(c("text"), c("anchor"), c("target_citation"), c("target_term"), c("radius"))).withColumn("near", anchors.anchor_context(c("text"), c("anchor"), c("radius")))
    loose = relations.loose_relation(c("near"), c("target_citation"), c("target_term"))["relation"]
    linked = relations.linked_relation(c("near"), c("target_citation"), c("target_term"))["relation"]
    frame = relations.structured_relation(c("x.text"), c("target_citation"), c("target_term"))
    return with_context.select("heldout_id", "expected", "difficulty", "x", loose.alias("loose"), linked.alias("linked"), frame.alias("frame"))


def relation_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf).select("heldout_id", "expected", "difficulty", "x.resolution", "x.distance", "loose", "linked", F.col("frame.relation").alias("structured"), F.col("frame.owner").alias("owner"), F.col("frame.abstention").alias("abstention"))


def relation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Correct challenges of each model by expected label and difficulty; ``resolved`` counts those whose target stands near the anchor."""
    made = _related(spark, sf).withColumns({"structured": F.col("frame.relation"), "near": F.col("x.target_found") | (F.col("expected") == "UNKNOWN")})
    right = lambda m: F.count_if(F.col(m) == F.col("expected")).alias(m)
    return made.groupBy("expected", "difficulty").agg(F.count(F.lit(1)).alias("total"), F.count_if("near").alias("resolved"), right("loose"), right("linked"), right("structured"), F.count_if(F.col("near") & (F.col("structured") == F.col("expected"))).alias("structured_resolved"))


def relation_confusion(spark: SparkSession, sf: str) -> DataFrame:
    opened = _related(spark, sf).select("expected", F.explode(F.create_map(F.lit("loose"), F.col("loose"), F.lit("linked"), F.col("linked"), F.lit("structured"), F.col("frame.relation"))).alias("model", "predicted"))
    return opened.groupBy("model", "expected", "predicted").agg(F.count(F.lit(1)).alias("rows"))


def relation_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """The relation-aware policies on fixed scores: what each model's relation does to a claim that is supported before and after."""
    pair = (F.lit(0.50), F.lit(0.45), F.lit("COURT_SELF_HOLDING"), F.lit("ATTRIBUTED_PRIOR_AUTHORITY"))
    made = _related(spark, sf).select(
        relations.transition(*pair, F.col("loose"), mixed=False).alias("loose"), relations.transition(*pair, F.col("linked")).alias("linked"), relations.transition(*pair, F.col("frame.relation")).alias("structured"), relations.transition(*pair).alias("roles")
    )
    opened = made.select(F.explode(F.create_map(*[x for m in ("roles", "loose", "linked", "structured") for x in (F.lit(m), F.col(m))])).alias("model", "t"))
    return opened.groupBy("model", "t.classification", "t.reason").agg(F.count(F.lit(1)).alias("rows"))


def _live_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One live row a challenge: the latest, then the largest by its fields."""
    rows = load(spark, sf, "candidates").where(F.col("challenge_id").isNotNull() & F.col("deleted_at").isNull())
    fields = F.struct("source_case", "source_citation", "target_case", "target_citation", "target_term", "radius")
    return rows.groupBy("challenge_id").agg(F.max_by(fields, F.struct("loaded_at", fields)).alias("c")).select("challenge_id", "c.*")


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Each live challenge with the first place of its target's name in the source, and where that failed."""
    rows = _live_candidates(spark, sf).withColumn("key", lexical.source_key(F.col("source_citation"))).join(sources(spark, sf), "key", "left")
    text = lexical.plain_print(F.col("text"))
    context = lexical.first_occurrence(text, lexical.plain_print(F.col("target_term")), F.coalesce(F.col("radius"), F.lit(1200)))
    state = F.when(F.col("text").isNull(), "SOURCE_NOT_FOUND").when(context.isNull(), "TARGET_NOT_FOUND").otherwise("CONTEXT_FOUND")
    return rows.select("challenge_id", "source_case", "source_citation", "target_case", "target_citation", "target_term", state.alias("context_state"), context.alias("context"))


def blind_packet(spark: SparkSession, sf: str) -> DataFrame:
    """What a reviewer gets of each challenge: identity and context, an empty review, and nothing that was predicted."""
    review = ["gold_treatment", "confidence", "evidence_span", "notes", "reviewer"]
    packet = _contexts(spark, sf)
    assert not {"expected_relation", "extraction"} & set(packet.columns), "a packet must not show labels or predictions"
    return packet.select("challenge_id", "source_citation", "target_citation", "context_state", F.char_length("context").alias("context_characters"), *[F.lit(None).cast("string").alias(r) for r in review])


def challenge_key_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Challenges without a prediction, and predictions without a live challenge."""
    return evaluation.key_sets(_live_candidates(spark, sf), load(spark, sf, "predictions"), "challenge_id")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    joined = load(spark, sf, "predictions").select("prediction_id", "challenge_id", "run_label", "extraction").join(_contexts(spark, sf), "challenge_id", "left")
    checked = joined.select("prediction_id", "run_label", extraction.validated(F.col("extraction"), F.col("context"), F.col("target_citation")).alias("checked"))
    return checked.withColumn("envelope", extraction.envelope(F.col("checked")))


def extraction_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("prediction_id", "checked.valid", F.array_join("checked.errors", "|").alias("errors"), "checked.derived_treatment", "checked.grounded", "envelope.usable", "envelope.reason")


def extraction_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Extractions with each kind of breach; numbers of spans and lists of keys are left out of the kind."""
    opened = _checked(spark, sf).select("prediction_id", F.explode("checked.errors").alias("e"))
    kind = F.regexp_replace(F.regexp_replace("e", ":.*$", ""), r"_\d+_", "_")
    return opened.groupBy(kind.alias("breach")).agg(F.count(F.lit(1)).alias("breaches"), F.countDistinct("prediction_id").alias("extractions"))


def extraction_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.tallies(_checked(spark, sf), ["run_label"])


def extraction_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """The bridge from validated extractions to the policy, on fixed scores."""
    pair = (F.lit(0.50), F.lit(0.45), F.lit("COURT_SELF_HOLDING"), F.lit("ATTRIBUTED_PRIOR_AUTHORITY"))
    return _checked(spark, sf).select(relations.extraction_transition(*pair, F.col("envelope")).alias("t")).groupBy("t.classification", "t.reason").agg(F.count(F.lit(1)).alias("extractions"))


_STOP = "[" + ", ".join(f"'{w}'" for w in lexical.STOPWORDS) + "]"


def _tokens_sql(x: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)), [])"


def _pairs_sql(w: str) -> str:
    return f"list_distinct(CASE WHEN len({w}) < 2 THEN [] ELSE list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) END)"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"


def _windows_sql(source: str, key: str, most: int = 2) -> str:
    """Windows of one or two (``most``) sentences of ``source`` (key, text): key, place, t."""
    split = f"string_split(regexp_replace(text, '([.!?]){WHITESPACE}+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    parts = f"list_filter(list_transform({split}, lambda x: {_strip_sql('x')}), lambda x: x <> '')"
    return f"""(SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i, n) - 1 AS INTEGER) AS place, t FROM (
  SELECT {key}, i, n, CASE n WHEN 1 THEN s[i] ELSE s[i] || ' ' || s[i + 1] END AS t FROM (SELECT {key}, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {key}, {parts} AS s FROM {source} WHERE text IS NOT NULL)), (VALUES (1), (2)) v(n) WHERE n <= {most} AND i + n - 1 <= len(s)))"""


def _key_sql(x: str) -> str:
    clean = f"trim(regexp_replace(lower(regexp_replace({x}, '{lexical.INVISIBLE}', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    part = lambda i: f"regexp_extract({clean}, '{lexical.UNIT}', {i})"
    return f"CASE WHEN regexp_matches({clean}, '{lexical.UNIT}') THEN {part(1)} || '|' || replace({part(2)}, ' ', '') || '|' || {part(3)} ELSE replace({clean}, ' ', '') END"


_SCORES = f"""WITH src AS (SELECT {_key_sql("source_citation")} AS key, arg_min(text, doc_id) AS text FROM documents WHERE source_citation IS NOT NULL AND text IS NOT NULL GROUP BY 1),
win AS (SELECT key, place, t, {_tokens_sql("t")} AS w FROM {_windows_sql("src", "key")}),
wins AS (SELECT key, place, t, list_distinct(w) AS words, {_pairs_sql("w")} AS prs FROM win),
p AS (SELECT row_number() OVER () AS r, pair_id, claim_id, coalesce(replace(lower({_strip_sql("expected_support")}), ' ', '_'), 'unknown') AS expected, {_key_sql("citation")} AS key, {_tokens_sql("claim")} AS w FROM pairs),
ps AS (SELECT r, pair_id, claim_id, expected, key, list_distinct(w) AS words, {_pairs_sql("w")} AS prs FROM p),
m AS (SELECT r, place, CAST(len(list_intersect(ps.words, wins.words)) AS INTEGER) AS sh, len(ps.words) AS cw, CAST(len(wins.words) AS INTEGER) AS ww, CAST(len(list_intersect(ps.prs, wins.prs)) AS INTEGER) AS sp, len(ps.prs) AS cp FROM ps JOIN wins ON ps.key = wins.key),
q AS (SELECT *, 0.55::DOUBLE * CASE WHEN sh = 0 THEN 0 ELSE 2 * (sh::DOUBLE / ww) * (sh::DOUBLE / cw) / (sh::DOUBLE / ww + sh::DOUBLE / cw) END + 0.35::DOUBLE * CASE WHEN cw = 0 THEN 0 ELSE sh::DOUBLE / cw END + 0.10::DOUBLE * CASE WHEN cp = 0 THEN 0 ELSE sp::DOUBLE / cp END AS score FROM m),
f AS (SELECT r, list_reduce(list(struct_pack(s := score, sh := sh, ww := ww, sp := sp) ORDER BY place), lambda a, x: CASE WHEN x.s > round(a.s, 6) THEN x ELSE a END, struct_pack(s := 0::DOUBLE, sh := 0, ww := 0, sp := 0)) AS b FROM q GROUP BY r),
scored AS (SELECT ps.pair_id, ps.claim_id, ps.expected, coalesce(b.sh, 0) AS shared, coalesce(b.ww, 0) AS window_words, coalesce(b.sp, 0) AS shared_pairs, CAST(floor(coalesce(b.s, 0) * 10000) AS BIGINT) AS score_4, round(coalesce(b.s, 0), 6) AS score FROM ps LEFT JOIN f ON ps.r = f.r)"""


def _ratio_sql(part: str, whole: str) -> str:
    return f"CAST(floor(CASE WHEN {whole} = 0 THEN 0 ELSE ({part})::DOUBLE / ({whole}) END * 10000) AS BIGINT)"


_METRICS = f"""{_SCORES}, c AS (SELECT threshold_pct, count(*) FILTER (WHERE expected = 'supported' AND y) AS tp, count(*) FILTER (WHERE expected = 'supported' AND NOT y) AS fn, count(*) FILTER (WHERE expected = 'unsupported' AND y) AS fp, count(*) AS total
FROM (SELECT *, score >= threshold_pct / 100.0 AS y FROM scored, (VALUES (34), (50)) v(threshold_pct)) GROUP BY threshold_pct), d AS (SELECT *, total - tp - fn - fp AS tn FROM c)
SELECT threshold_pct, tp, fn, fp, tn, total, {_ratio_sql("tp + tn", "total")} AS accuracy, {_ratio_sql("tp", "tp + fp")} AS precision, {_ratio_sql("tp", "tp + fn")} AS recall, {_ratio_sql("fp", "fp + tn")} AS false_positive_rate, {_ratio_sql("fn", "fn + tp")} AS false_negative_rate FROM d"""



def _like_sql(x: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({x}, '(?i){quoted}')"


def _count_sql(x: str, patterns: list[str]) -> str:
    """Patterns that have a match."""
    return "(" + " + ".join(f"CAST({_like_sql(x, p)} AS INTEGER)" for p in patterns) + ")"


_NAME = relations.CASE_NAME.replace("'", "''")
_ROLES = f"""WITH w AS (SELECT {_strip_sql("t")} AS t FROM {_windows_sql("documents", "doc_id")}),
c AS (SELECT t, {_like_sql("t", relations.SYLLABUS)} AS held, {_count_sql("t", relations.SELF_HOLDING)} AS own, {_count_sql("t", relations.SECONDARY)} AS second, {_count_sql("t", relations.ATTRIBUTION)} AS att, {_like_sql("t", relations.REPORTER)} OR regexp_matches(t, '{_NAME}') AS cited FROM w),
r AS (SELECT CASE WHEN held THEN 'REPORTER_SYLLABUS_HOLDING' WHEN own > 0 THEN 'COURT_SELF_HOLDING' WHEN second > 0 THEN 'SECONDARY_SOURCE' WHEN cited THEN 'ATTRIBUTED_PRIOR_AUTHORITY' ELSE 'UNKNOWN' END AS role,
  CASE WHEN held OR own > 0 OR second > 0 OR (att > 0 AND cited) THEN 'high' WHEN cited THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN held THEN 1 WHEN own > 0 THEN own WHEN second > 0 THEN second WHEN att > 0 AND cited THEN att WHEN cited THEN 1 ELSE 0 END AS cues FROM c)
SELECT role, confidence, count(*) AS windows, CAST(sum(cues) AS BIGINT) AS cues FROM r GROUP BY role, confidence"""

_PRINT = lexical.DASHES + lexical.QUOTES + lexical.DOUBLE_QUOTES + lexical.SOFT_HYPHEN


def _squeeze_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WHITESPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def _print_sql(x: str, chars: str, plain: str) -> str:
    return _squeeze_sql(f"translate({x}, '{chars}', '{plain}')")


def _any_sql(x: str, patterns: list[str], target: str | None = None) -> str:
    def one(p: str) -> str:
        if target is None:
            return _like_sql(x, p)
        before, after = p.split("T", 1) if p.startswith("T") else p.rsplit("T", 1)
        return f"regexp_matches({x}, '(?i){before}' || {target} || '{after}')"

    return "(" + " OR ".join(map(one, patterns)) + ")"


_STRAIGHT = "\'\'\'\'" + '"' * 2  # two quotes, doubled as SQL writes them, and two double ones
_LOOSE_TEXT = _print_sql("t", lexical.QUOTES + lexical.DOUBLE_QUOTES + lexical.SOFT_HYPHEN, _STRAIGHT)
_LINKED_TEXT = _print_sql("t", _PRINT, "-----" + _STRAIGHT)
_LOOSE_CASE = " ".join(f"WHEN {_any_sql('q', ps)} THEN '{k}'" for k, ps in relations.LOOSE_CUES.items())
_LINKED_LIST = ", ".join(f"CASE WHEN {_any_sql('t', ps, 'target')} THEN '{k}' END" for k, ps in relations.LINKED_CUES.items())
_CITING = f"""WITH d AS (SELECT doc_id, regexp_replace(text, ' v\\.', ' v_', 'g') AS text FROM documents), w AS (SELECT doc_id, place, replace(t, ' v_', ' v.') AS t FROM {_windows_sql("d", "doc_id", 1)}),
c AS (SELECT t, regexp_extract(t, '{CITED}', 1) AS term FROM w), e AS (SELECT {_LOOSE_TEXT} AS q, {_LINKED_TEXT} AS t, array_to_string(list_transform(string_split(term, ''), lambda x: x || '\\s*'), '') AS target FROM c WHERE term <> ''),
f AS (SELECT CASE {_LOOSE_CASE} ELSE 'MENTION_ONLY' END AS loose, list_filter([{_LINKED_LIST}], lambda x: x IS NOT NULL) AS kinds FROM e)
SELECT loose, CASE len(kinds) WHEN 0 THEN 'MENTION_ONLY' WHEN 1 THEN kinds[1] ELSE 'MIXED_OR_CONFLICTING' END AS linked, count(*) AS sentences FROM f GROUP BY 1, 2"""


def _contract_sql(x: str) -> str:
    for entity, char in lexical.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"lower({_print_sql(x, lexical.DASHES + lexical.QUOTES, '-----' + chr(39) * 4)})"


_PHRASES = f"""WITH src AS (SELECT {_key_sql("source_citation")} AS key, arg_min(text, doc_id) AS text FROM documents WHERE source_citation IS NOT NULL AND text IS NOT NULL GROUP BY 1), st AS (SELECT key, {_contract_sql("text")} AS text FROM src),
b AS (SELECT rec_id, {_key_sql("authority.citation")} AS key, coalesce(list_filter(list_transform(context.support_contract.required_phrases, lambda p: {_strip_sql("p")}), lambda p: p IS NOT NULL AND p <> ''), []) AS ph FROM baseline),
m AS (SELECT rec_id, len(ph) AS n, coalesce(st.text, '') AS text, len(list_filter(ph, lambda p: contains(coalesce(st.text, ''), {_contract_sql("p")}))) AS k FROM b LEFT JOIN st ON b.key = st.key)
SELECT rec_id, CASE WHEN text = '' OR n = 0 THEN 'unknown' WHEN k = n THEN 'supported' WHEN k > 0 THEN 'partial' ELSE 'unsupported' END AS support, CAST(k AS INTEGER) AS matched, CAST(n - k AS INTEGER) AS missing FROM m"""

_PARSED = lexical.CITATION.replace("'", "''")
_LIVE = """live AS (SELECT challenge_id, arg_max(ROW(source_citation, target_citation), ROW(loaded_at, source_case, source_citation, target_case, target_citation, target_term, radius)) AS c FROM candidates WHERE challenge_id IS NOT NULL AND deleted_at IS NULL GROUP BY challenge_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        tokens_per_doc, sentence_windows, lexical_support_scores, lexical_topk, binary_metrics, score_distribution, model_compare, pair_labels, phrase_contracts, source_fingerprints, citation_parse, enrichment_states,
        authority_roles, citing_relations, role_transitions, identity_transitions, relation_predictions, relation_accuracy, relation_confusion, relation_transitions, blind_packet, challenge_key_sets,
        extraction_checks, extraction_error_counts, extraction_tallies, extraction_transitions,
    )
}
SQL = {
    "tokens_per_doc": f"SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_words, CAST(len({_pairs_sql('w')}) AS INTEGER) AS distinct_pairs FROM (SELECT doc_id, {_tokens_sql('text')} AS w FROM documents)",
    "sentence_windows": f"SELECT doc_id, place, CAST(length(t) AS INTEGER) AS characters FROM {_windows_sql('documents', 'doc_id')}",
    "lexical_support_scores": f"{_SCORES} SELECT pair_id, claim_id, shared, window_words, shared_pairs, score_4 FROM scored",
    "lexical_topk": f"""{_SCORES}, t AS (SELECT r, place, sh, ww, row_number() OVER (PARTITION BY r ORDER BY round(CASE WHEN cw = 0 OR ww = 0 THEN 0 ELSE 0.65::DOUBLE * (sh::DOUBLE / cw) + 0.35::DOUBLE * CASE WHEN sh = 0 THEN 0 ELSE 2 * (sh::DOUBLE / ww) * (sh::DOUBLE / cw) / (sh::DOUBLE / ww + sh::DOUBLE / cw) END END, 6) DESC, place) AS rank FROM m)
SELECT pair_id, claim_id, CAST(rank AS INTEGER) AS rank, place, sh AS shared, ww AS window_words FROM t JOIN ps ON t.r = ps.r WHERE rank <= {TOP}""",
    "binary_metrics": _METRICS,
    "score_distribution": f"{_SCORES} SELECT expected AS label, count(*) AS rows, CAST(floor(avg(score_4)) AS BIGINT) AS mean, min(score_4) AS least, max(score_4) AS greatest FROM scored GROUP BY expected",
    "model_compare": f"""{_SCORES}, m1 AS (SELECT pair_id, arg_max(expected, ROW(score, expected)) AS e, max(score) AS s FROM scored WHERE pair_id IS NOT NULL GROUP BY pair_id), m2 AS (SELECT coalesce((s >= 0.34) = (e = 'supported') AND e IN ('supported', 'unsupported'), false) AS a, coalesce((s >= 0.5) = (e = 'supported') AND e IN ('supported', 'unsupported'), false) AS b FROM m1)
SELECT CASE WHEN NOT a AND b THEN 'fixed' WHEN a AND NOT b THEN 'broken' WHEN a THEN 'same_correct' ELSE 'same_wrong' END AS outcome, count(*) AS pairs FROM m2 GROUP BY 1""",
    "pair_labels": f"SELECT coalesce(replace(lower({_strip_sql('expected_support')}), ' ', '_'), 'unknown') AS expected, count(*) AS rows, count(DISTINCT {_key_sql('citation')}) AS citations FROM pairs GROUP BY 1",
    "source_fingerprints": "SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, sha256(text) AS sha256 FROM documents",
    "authority_roles": _ROLES,
    "citing_relations": _CITING,
    "phrase_contracts": _PHRASES,
    "citation_parse": f"SELECT DISTINCT pair_id, citation, try_cast(regexp_extract(citation, '{_PARSED}', 1) AS INTEGER) AS volume, try_cast(regexp_extract(citation, '{_PARSED}', 3) AS INTEGER) AS page FROM pairs WHERE citation IS NOT NULL",
    "enrichment_states": f"""WITH k AS (SELECT {_key_sql("source_citation")} AS key, count(DISTINCT case_name) AS cases FROM documents WHERE source_citation IS NOT NULL GROUP BY 1), b AS (SELECT nullif({_strip_sql("authority.citation")}, '') AS citation FROM baseline), c AS (SELECT citation, {_key_sql("citation")} AS key FROM b)
SELECT CASE WHEN citation IS NULL THEN 'NO_CITATION' WHEN cases IS NULL THEN 'NOT_FOUND' WHEN cases > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS state, count(*) AS records FROM c LEFT JOIN k ON c.key = k.key GROUP BY 1""",
    "challenge_key_sets": f"WITH {_LIVE} SELECT DISTINCT challenge_id, 'left_only' AS side FROM live WHERE challenge_id NOT IN (SELECT challenge_id FROM predictions WHERE challenge_id IS NOT NULL) UNION ALL SELECT DISTINCT challenge_id, 'right_only' FROM predictions WHERE challenge_id IS NOT NULL AND challenge_id NOT IN (SELECT challenge_id FROM live)",
}
