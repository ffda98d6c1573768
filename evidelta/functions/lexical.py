"""Column functions on words, sentences and windows of text, and the scores made of them.

Everything is native: arrays and higher-order functions, no Python. Scores are made from counts (words shared, words of
either side), so that a caller may keep the counts, which are exact, in place of the scores.

Defined results for odd input: a null text has no words, sentences or windows; a score with an empty side is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidelta.functions.text import WHITESPACE, let, strip

# Words that carry no meaning of their own.
STOPWORDS = (
    "a an and are as at be been being by can could did do does for from had has have if in into is it its may must no not of on or shall should that the "
    "their them there these they this those to under was were when where which who will with would"
).split()
#: Of names of cases.
NAME_STOPWORDS = "v vs versus co company inc corp corporation".split()
WORD = "[a-z0-9]+(?:'[a-z0-9]+)?"
SENTENCE_END = rf"(?<=[.!?]){WHITESPACE}+(?=[A-Z0-9])"
#: Weights of the support score: shared words both ways, the claim's words found, its word pairs found.
F1_WEIGHT, RECALL_WEIGHT, PAIR_WEIGHT = 0.55, 0.35, 0.10
#: Weights of the retrieval score: the claim's words found, shared words both ways.
RETRIEVAL_RECALL, RETRIEVAL_F1 = 0.65, 0.35


def tokens(text: Column, dropped: list[str] = STOPWORDS) -> Column:
    """The words of ``text`` in order, lower case, without one-letter and ``dropped`` words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    kept = F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*dropped))
    return F.coalesce(kept, F.array().cast("array<string>"))


def pairs(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    both = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.array_compact(let(words, both)))


def sentences(text: Column) -> Column:
    """``text`` split after .!? before a capital or digit, without blank parts."""
    parts = F.transform(F.split(text, SENTENCE_END), strip)
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def windows(parts: Column, most: int = 2) -> Column:
    """Runs of one to ``most`` neighbouring sentences, by their start, shorter ones first."""
    def made(s: Column) -> Column:
        begin = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(s) - i)), lambda n: F.array_join(F.slice(s, i + 1, n), " "))
        return F.when(F.size(s) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 1), begin))).otherwise(F.array().cast("array<string>"))

    return let(parts, made)


def ratio(part: Column, whole: Column) -> Column:
    """``part`` of ``whole``; 0 where that is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def f1(shared: Column, left: Column, right: Column) -> Column:
    """Harmonic mean of the shares that ``shared`` has of both sides."""
    precision, recall = ratio(shared, right), ratio(shared, left)
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def support_score(shared: Column, claim: Column, window: Column, shared_pairs: Column, claim_pairs: Column) -> Column:
    return F1_WEIGHT * f1(shared, claim, window) + RECALL_WEIGHT * ratio(shared, claim) + PAIR_WEIGHT * ratio(shared_pairs, claim_pairs)


def retrieval_score(shared: Column, claim: Column, window: Column) -> Column:
    return F.when((claim > 0) & (window > 0), RETRIEVAL_RECALL * ratio(shared, claim) + RETRIEVAL_F1 * f1(shared, claim, window)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays, of all their elements."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def bag_recall(needle: Column, hay: Column) -> Column:
    """The share of the ``needle``'s elements, repeats counted, that ``hay`` has as often."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(needle), F.lit(0), lambda n, w: n + F.least(count(needle, w), count(hay, w)))
    return ratio(shared, F.size(needle))


def softmax(values: Column) -> Column:
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def label_scores(logits: Column, labels: Column, known: tuple[str, ...] = ("contradiction", "entailment", "neutral")) -> Column:
    """A struct of the probability of each known label, by its name; 0 for one that ``labels`` lacks."""
    shares = F.zip_with(labels, softmax(logits), lambda n, p: F.struct(F.lower(F.trim(n)).alias("n"), p.alias("p")))
    own = lambda k: F.coalesce(F.try_element_at(F.filter(shares, lambda x: x["n"] == k), F.lit(-1))["p"], F.lit(0.0))
    return F.when(F.size(logits) > 0, F.struct(*[own(k).alias(k) for k in known])).otherwise(F.struct(*[F.lit(0.0).alias(k) for k in known]))


# Dashes and quotes of print, and their plain forms.
DASHES, QUOTES, DOUBLE_QUOTES, SOFT_HYPHEN = "‐‑‒–—", "‘’", "“”", "­"


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{WHITESPACE}+", " "), "^ | $", "")


def plain_quotes(text: Column) -> Column:
    """Soft hyphens dropped, quotes of print straightened, whitespace squeezed; dashes and case stay."""
    return F.coalesce(_squeezed(F.translate(text, QUOTES + DOUBLE_QUOTES + SOFT_HYPHEN, "''\"\"")), F.lit(""))


def plain_print(text: Column) -> Column:
    """As ``plain_quotes``, with dashes of print as hyphens too."""
    return F.coalesce(_squeezed(F.translate(text, DASHES + QUOTES + DOUBLE_QUOTES + SOFT_HYPHEN, "-----''\"\"")), F.lit(""))


# The entities that text carries most.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&#160;": " ", "&rsquo;": "’", "&lsquo;": "‘", "&ndash;": "–", "&mdash;": "—", "&sect;": "§", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """The common entities as characters, natively; ``html_text`` knows all of them."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def contract_text(text: Column) -> Column:
    """As phrases are compared: entities and print resolved, whitespace squeezed, lower case."""
    return F.lower(_squeezed(F.translate(unescape(text), DASHES + QUOTES, "-----''")))


def phrase_contract(source: Column, phrases: Column, ready: bool = False) -> Column:
    """How far ``source`` holds the required ``phrases``: a struct of support (supported, partial, unsupported, or unknown without phrases), required, matched, missing, source_sha256 and source_characters. ``ready``: the source is in ``contract_text`` already, as where many contracts share one."""
    return let(F.struct((F.coalesce(source, F.lit("")) if ready else contract_text(F.coalesce(source, F.lit("")))).alias("text"), phrases.alias("phrases")), lambda x: _contract(x["text"], x["phrases"]))


def _contract(text: Column, phrases: Column) -> Column:
    required = F.coalesce(F.filter(F.transform(phrases, strip), lambda p: p.isNotNull() & (p != "")), F.array().cast("array<string>"))
    held = lambda p: F.contains(text, contract_text(p))
    matched, missing = F.filter(required, held), F.filter(required, lambda p: ~held(p))
    support = F.when(F.size(required) == 0, "unknown").when(F.size(missing) == 0, "supported").when(F.size(matched) > 0, "partial").otherwise("unsupported")
    return F.struct(support.alias("support"), required.alias("required"), matched.alias("matched"), missing.alias("missing"), F.sha2(text, 256).alias("source_sha256"), F.char_length(text).alias("source_characters"))


def citation_key(text: Column) -> Column:
    """Lower-case letters and digits of a citation, as two spellings of one are compared."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


#: Characters that show nothing, and volume, reporter and page wherever they stand in a citation's lower-case words; a number of four digits is a year.
INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]+"
UNIT = r"\b(\d{1,3}) ((?:(?:[a-z]+|\d(?:d|st|nd|rd|th)) )+)(\d{1,4})\b"


def source_key(text: Column) -> Column:
    """Volume, reporter and page of a citation whatever its spelling and the order of its parts; its letters and digits where they aren't found."""
    def key(x: Column) -> Column:
        unit = F.concat_ws("|", F.regexp_extract(x, UNIT, 1), F.replace(F.regexp_extract(x, UNIT, 2), F.lit(" "), F.lit("")), F.regexp_extract(x, UNIT, 3))
        return F.when(F.regexp_like(x, F.lit(UNIT)), unit).otherwise(F.replace(x, F.lit(" "), F.lit("")))

    return let(F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, INVISIBLE, "")), "[^a-z0-9]+", " ")), key)


#: Volume, reporter and page at the start of a citation.
CITATION = r"^\s*(\d+)\s+((?:[A-Za-z][A-Za-z.']*\s+|\d[a-z]+\s+)+?),?\s*(\d+)\b"


def citation_parts(text: Column) -> Column:
    """A struct of volume, reporter and page; null where ``text`` doesn't begin with them."""
    part = lambda i: F.regexp_extract(text, CITATION, i)
    made = F.struct(F.try_to_number(part(1), F.lit("999999999")).cast("int").alias("volume"), F.trim(part(2)).alias("reporter"), F.try_to_number(part(3), F.lit("999999999")).cast("int").alias("page"))
    return F.when(F.regexp_like(text, F.lit(CITATION)), made)


def citation_pattern(text: Column) -> Column:
    """A pattern that finds a citation with points and spaces between the reporter's words as they may be; null where it has no parts."""
    parts = citation_parts(text)
    words = F.filter(F.split(parts["reporter"], r"[\s.]+"), lambda w: w != "")
    return F.concat(F.lit(r"\b"), parts["volume"].cast("string"), F.lit(r"\s+"), F.array_join(words, r"\.?\s*"), F.lit(r"\.?\s*,?\s*"), parts["page"].cast("string"), F.lit(r"\b"))


def loose_pattern(term: Column) -> Column:
    """A pattern that finds ``term`` though a scan has put spaces into words: letters and digits with spaces between as they may be, anything but word characters for the rest."""
    chars = F.split(plain_quotes(term), "")
    piece = lambda c: F.when(F.regexp_like(c, F.lit(r"(?U)^[\p{L}\p{N}]$")), F.concat(c, F.lit(r"\s*"))).when(c == " ", r"\s*").when(c != "", r"[^\w]*").otherwise("")
    return F.array_join(F.transform(chars, piece), "")


def target_pattern(citation: Column, term: Column) -> Column:
    """A pattern for a cited authority: its citation, or its name where there is one; null where there is neither."""
    name = F.when(F.length(plain_quotes(term)) > 0, F.concat(F.lit("(?:"), loose_pattern(term), F.lit(")")))
    cite = F.concat(F.lit("(?:"), citation_pattern(citation), F.lit(")"))
    return F.when(cite.isNotNull() | name.isNotNull(), F.concat(F.lit("(?:"), F.concat_ws("|", cite, name), F.lit(")")))


def first_matches(text: Column, patterns: list[str]) -> Column:
    """The first match of each pattern that has one, in the patterns' order."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    return F.array_compact(F.array(*[found(p) for p in patterns]))


def all_matches(text: Column, patterns: list[Column]) -> Column:
    """The distinct matches of all patterns, pattern by pattern, as they are first seen."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, p, F.lit(0)) for p in patterns])))


def around(text: Column, start: Column, length: Column, radius: Column | int) -> Column:
    """``length`` characters of ``text`` from the one-based ``start``, with ``radius`` more on both sides."""
    radius = F.greatest(F.lit(radius) if isinstance(radius, int) else radius, F.lit(0))
    first = F.greatest(start - radius, F.lit(1))
    return F.substring(text, first, start + length + radius - first)


def in_context(text: Column, needle: Column, radius: Column | int) -> Column:
    """The first place of ``needle``, letter for letter, with its surroundings; ``needle`` itself where there is none."""
    at = F.instr(text, needle)
    return F.when((at > 0) & (needle != ""), around(text, at, F.char_length(needle), radius)).otherwise(F.coalesce(needle, F.lit("")))


def first_occurrence(text: Column, needle: Column, radius: Column | int) -> Column:
    """The first place of ``needle``, whatever its case, with its surroundings; null where there is none."""
    at = F.instr(F.lower(text), F.lower(needle))
    return F.when((at > 0) & (needle != ""), around(text, at, F.char_length(needle), radius))
