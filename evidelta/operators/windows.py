"""Claims against the windows of a source: best window, top windows.

A source's windows, with their words and word pairs, are made once; pairs of claim and source are joined to them by the
source's key, one row a key, so a join multiplies nothing. A pair's windows stay in its row, as an array: best window and
top windows are folds over that array, without a shuffle for each window.

Defined results for odd input: a null or empty source has no windows; a pair without a window that shares a word has score 0
and no window; of equal windows the first counts; repeated pairs give repeated rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.functions import lexical

#: Characters of the window that is shown.
SHOWN = 500
WINDOW = "array<struct<place:int,text:string,words:array<string>,pairs:array<string>>>"


def source_windows(sources: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """``key`` and ``windows`` of each source; ``key`` has to be unique."""
    texts = lexical.windows(F.col("_s"), most)
    opened = F.transform(texts, lambda t, i: F.struct(i.alias("place"), t.alias("text"), lexical.tokens(t).alias("_t")))
    made = F.transform(opened, lambda w: F.struct(w["place"].alias("place"), w["text"].alias("text"), F.array_distinct(w["_t"]).alias("words"), lexical.pairs(w["_t"]).alias("pairs")))
    return sources.select(F.col(key), lexical.sentences(F.col(text)).alias("_s")).select(key, made.alias("windows"))


def paired(claims: DataFrame, claim: str, sources: DataFrame, key: str) -> DataFrame:
    """``claims`` with their words and the windows of their source: left join, so that a claim without a source stays."""
    with_words = claims.withColumn("_t", lexical.tokens(F.col(claim)))
    with_words = with_words.withColumns({"_words": F.array_distinct("_t"), "_pairs": lexical.pairs(F.col("_t"))}).drop("_t")
    return with_words.join(sources, key, "left")


def _counts(w: Column) -> dict[str, Column]:
    return {
        "shared": F.size(F.array_intersect(w["words"], F.col("_words"))),
        "claim_words": F.size("_words"),
        "window_words": F.size(w["words"]),
        "shared_pairs": F.size(F.array_intersect(w["pairs"], F.col("_pairs"))),
        "claim_pairs": F.size("_pairs"),
    }


def best_window(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``best``: counts, score and text of the best window.

    A fold in the windows' order: a window replaces the best one if its score is above that one's score rounded to six
    places, beginning with 0, so that a window that shares nothing never wins.
    """
    scored = F.transform("windows", lambda w: F.struct(w["place"].alias("place"), w["text"].alias("text"), *[c.alias(n) for n, c in _counts(w).items()]))
    with_scores = F.transform(
        scored,
        lambda x: F.struct(lexical.support_score(x["shared"], x["claim_words"], x["window_words"], x["shared_pairs"], x["claim_pairs"]).alias("score"), *[x[n].alias(n) for n in ("place", "text", "shared", "claim_words", "window_words", "shared_pairs", "claim_pairs")]),
    )
    kind = "struct<score:double,place:int,text:string,shared:int,claim_words:int,window_words:int,shared_pairs:int,claim_pairs:int>"
    none = F.lit(None).cast(kind)
    fold = F.aggregate("_scored", none, lambda best, x: F.when(x["score"] > F.round(F.coalesce(best["score"], F.lit(0.0)), 6), x).otherwise(best))
    return pairs.withColumn("_scored", with_scores.cast(f"array<{kind}>")).withColumn("best", fold).drop("_scored", "windows", "_words", "_pairs")


def top_windows(pairs: DataFrame, k: int = 8) -> DataFrame:
    """``pairs`` with ``top``: the ``k`` windows (one at least) with the highest retrieval scores, best first, ties in the windows' order."""
    scored = F.transform(
        "windows",
        lambda w: F.struct((-F.round(lexical.retrieval_score(F.size(F.array_intersect(w["words"], F.col("_words"))), F.size("_words"), F.size(w["words"])), 6)).alias("down"), w["place"].alias("place"), F.size(F.array_intersect(w["words"], F.col("_words"))).alias("shared"), F.size(w["words"]).alias("window_words"), w["text"].alias("text")),
    )
    top = F.slice(F.array_sort(scored), 1, max(1, k))
    return pairs.withColumn("top", top).drop("windows", "_words", "_pairs")
