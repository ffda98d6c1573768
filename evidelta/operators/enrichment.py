"""Evidence from look-ups laid over a run: does the citation exist, how strong is it, does its text hold the phrases.

Look-ups, dockets and opinions are dimension tables, one row a key, however they came about; a run is joined to them by
citation, left, so that every record stays. What isn't resolved leaves a record as it was: missing evidence is no
negative evidence.

Defined results for odd input: a record without a citation gets the state NO_CITATION and no look-up; a status outside the
known ones is UNKNOWN, none at all UNPARSED; several clusters, or none, resolve nothing; opinions without a usable text are
skipped; ties between opinions go to the first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.functions import lexical
from evidelta.functions.html import html_text

# States by status, the federal circuits, opinions that speak for the court.
STATES = {200: "FOUND", 404: "NOT_FOUND", 300: "AMBIGUOUS", 400: "INVALID_OR_UNSUPPORTED", 429: "THROTTLED"}
CIRCUITS = (*(f"ca{i}" for i in range(1, 12)), "cadc", "cafc")
PRIMARY = ("010combined", "015unamimous", "015unanimous", "020lead", "025plurality", "combined-opinion", "unanimous-opinion", "lead-opinion", "plurality-opinion", "080onthemerits", "on-the-merits")
TEXTS = ("html_with_citations", "html", "html_lawbox", "html_columbia", "html_anon_2020")
SHOWN_CLUSTERS = 5
CLUSTER = ("id", "case_name", "date_filed", "precedential_status", "absolute_url", "docket_id")


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def lookup_state(status: Column, answered: Column | None = None) -> Column:
    """The state of a look-up; UNPARSED where nothing was ``answered``."""
    state = F.lit("UNKNOWN")
    for code, name in STATES.items():
        state = F.when(status == code, name).otherwise(state)
    return state if answered is None else F.when(answered, state).otherwise("UNPARSED")


def federal_status(source: Column, target: Column, precedent: Column) -> Column:
    """controlling or persuasive for a federal circuit, null where that can't be told; the highest court comes before the question whether a decision was published."""
    source, target = _low(source), _low(target)
    return F.when(~target.isin(*CIRCUITS), None).when(source == "scotus", "controlling").when(~source.isin(*CIRCUITS) | (_low(precedent) != "published"), None).when(source == target, "controlling").otherwise("persuasive")


def name_words(name: Column) -> Column:
    return F.array_distinct(lexical.tokens(name, lexical.NAME_STOPWORDS))


def disambiguated(lookups: DataFrame, expected: Column, least: float = 0.5, margin: float = 0.15) -> DataFrame:
    """``lookups`` (status, adapter_state, clusters) where an ambiguous one whose clusters hold one clearly best case name is narrowed to it: status 200, state FOUND_DISAMBIGUATED."""
    words = name_words(expected)
    scores = F.transform("clusters", lambda c, i: F.struct((-lexical.jaccard(words, name_words(F.coalesce(c["case_name"], F.lit(""))))).alias("down"), i.alias("place")))
    ranked = lookups.withColumn("_s", F.array_sort(F.when((F.col("status") == 300) & (F.size(words) > 0), scores)))
    best = -F.get("_s", F.lit(0))["down"]
    lead = best + F.coalesce(F.get("_s", F.lit(1))["down"], F.lit(0.0))
    clear = F.coalesce((best >= least) & (lead >= margin), F.lit(False))
    return ranked.withColumns({
        "clusters": F.when(clear, F.array(F.get("clusters", F.get("_s", F.lit(0))["place"]))).otherwise(F.col("clusters")),
        "status": F.when(clear, F.lit(200)).otherwise(F.col("status")),
        "adapter_state": F.when(clear, "FOUND_DISAMBIGUATED").otherwise(F.col("adapter_state")),
        "name_score": F.when(clear, best),
    }).drop("_s")


def resolved(lookups: DataFrame, dockets: DataFrame) -> DataFrame:
    """``lookups`` with the court of those that found one cluster: ``metadata_state``, ``source_court_id``, ``docket_number``, ``precedential_status``, ``sub_opinions``."""
    only = F.when((F.col("status") == 200) & (F.size("clusters") == 1), F.get("clusters", F.lit(0)))
    with_url = lookups.withColumn("_c", only).withColumn("_url", F.when(F.col("_c.docket").startswith("http"), F.col("_c.docket")))
    court = dockets.select(F.col("url").alias("_url"), F.col("court_id").alias("source_court_id"), "docket_number", F.lit(True).alias("_found"))
    there = with_url.join(court, "_url", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return there.withColumns({
        "metadata_state": F.when(found, "RESOLVED").otherwise("UNRESOLVED"),
        "precedential_status": F.when(found, F.col("_c.precedential_status")),
        "sub_opinions": F.when(found, F.col("_c.sub_opinions")).otherwise(F.array().cast("array<string>")),
    }).drop("_c", "_url", "_found")


def opinion_texts(opinions: DataFrame) -> DataFrame:
    """``url``, ``type`` and ``text`` of opinions: the first of the HTML fields that isn't blank, as text, else the plain one; those without any are left out."""
    blank = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    markup = F.coalesce(*[blank(F.col(c)) for c in TEXTS])
    return opinions.select("url", "type", F.when(markup.isNotNull(), html_text(markup)).otherwise(blank(F.col("plain_text"))).alias("text")).where(F.col("text").isNotNull())


def source_texts(lookups: DataFrame, key: str, opinions: DataFrame) -> DataFrame:
    """One text a ``key``: of its opinions the first that speaks for the court, else the first with a text. ``opinions``: as ``opinion_texts`` gives them."""
    refs = lookups.where(F.col("status") == 200).select(key, F.posexplode("sub_opinions").alias("place", "url"))
    rank = F.struct((~_low(F.col("type")).isin(*PRIMARY)).alias("other"), "place")
    return refs.join(opinions, "url").groupBy(key).agg(F.min_by(F.struct("text", "type", "url"), rank).alias("s"), F.count(F.lit(1)).alias("opinions")).select(key, "s.text", "s.type", "s.url", "opinions")


def whole_texts(lookups: DataFrame, key: str, opinions: DataFrame) -> DataFrame:
    """All opinions of a ``key`` as one text, in order, a line break between; a key has a handful of opinions."""
    refs = lookups.where((F.col("status") == 200) & (F.col("metadata_state") == "RESOLVED")).select(key, F.posexplode("sub_opinions").alias("place", "url"))
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return refs.join(opinions.select("url", "text"), "url").groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("opinion_text"), F.count(F.lit(1)).alias("opinion_count"))


def enriched(run: DataFrame, lookups: DataFrame, texts: DataFrame | None = None, key: str = "citation") -> DataFrame:
    """``run`` with the evidence laid over: ``authority.exists``, ``authority.status`` and ``support`` where they are resolved, and ``authority.verification``.

    ``lookups``: as ``resolved`` gives them, unique by ``key``; ``texts``: as ``whole_texts`` gives them.
    """
    own = lookups.select(F.col(key).alias("_key"), F.struct(*[c for c in lookups.columns if c != key]).alias("_l"))
    cited = F.nullif(F.trim(F.col("authority.citation")), F.lit(""))
    joined = run.withColumn("_key", cited).join(own, "_key", "left")
    if texts is not None:
        joined = joined.join(texts.select(F.col(key).alias("_key"), "opinion_text", "opinion_count"), "_key", "left")
    else:
        joined = joined.withColumns({"opinion_text": F.lit(None).cast("string"), "opinion_count": F.lit(None).cast("bigint")})
    status, asked = F.col("_l.status"), F.col("_key").isNotNull()
    derived = federal_status(F.col("_l.source_court_id"), F.col("context.target_court_id"), F.col("_l.precedential_status"))
    contract = F.when(F.col("opinion_text").isNotNull(), lexical.phrase_contract(F.col("opinion_text"), F.col("context.support_contract.required_phrases")))
    made = joined.withColumns({"_derived": derived, "_contract": contract})
    judged = F.col("_contract.support")
    matches = F.transform(F.slice(F.coalesce(F.col("_l.clusters"), F.array()), 1, SHOWN_CLUSTERS), lambda c: F.struct(*[c[n].alias(n) for n in CLUSTER]))
    verification = F.struct(
        F.when(asked, F.coalesce(F.col("_l.adapter_state"), F.lit("UNPARSED"))).otherwise("NO_CITATION").alias("lookup_status"),
        status.alias("status"),
        matches.alias("matches"),
        F.coalesce(F.col("_l.metadata_state"), F.lit("UNRESOLVED")).alias("metadata_state"),
        F.col("_l.source_court_id").alias("source_court_id"),
        F.col("_l.docket_number").alias("docket_number"),
        F.col("_l.precedential_status").alias("precedential_status"),
        F.col("context.target_court_id").alias("target_court_id"),
        F.col("_derived").alias("derived_status"),
        F.col("_contract").alias("support"),
        F.col("opinion_count").alias("opinion_count"),
    )
    authority = (
        F.col("authority")
        .withField("exists", F.when(status == 200, F.lit(True)).when(status == 404, F.lit(False)).otherwise(F.col("authority.exists")))
        .withField("status", F.coalesce("_derived", F.col("authority.status")))
        .withField("verification", verification)
    )
    return made.withColumn("authority", authority).withColumn("support", F.when(judged.isin("supported", "partial", "unsupported", "contradicted"), judged).otherwise(F.col("support"))).drop("_key", "_l", "_derived", "_contract", "opinion_text", "opinion_count")


def state_tally(run: DataFrame) -> DataFrame:
    """Records of each look-up state."""
    return run.groupBy(F.coalesce(F.col("authority.verification.lookup_status"), F.lit("UNKNOWN")).alias("state")).agg(F.count(F.lit(1)).alias("records"))
