"""Models that the caller brings: entailment of a claim by windows, and extractions by a language model.

Both are plain functions over batches, given by the caller and made once in a worker; nothing here loads a model or opens a
connection. A failure of the model is a value, never a failed job.

Defined results for odd input: a claim without windows is unsupported and neutral; of windows with equal entailment the one
ranked first counts; a refusal, an empty or an unreadable answer is an ``error`` and no extraction.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidelta.functions.jsonread import readable_object
from evidelta.session import ship_package

SHOWN = 1000
VERDICT = "entailment double, neutral double, contradiction double, predicted string, window string"
Scorer = Callable[[list[str], list[str]], list[dict[str, float]]]


def overlap_scorer() -> Scorer:
    """A stand-in without a model: entailment is the share of the claim's words that the window holds."""
    def score(premises: list[str], claims: list[str]) -> list[dict[str, float]]:
        out = []
        for p, c in zip(premises, claims):
            words = set(c.lower().split())
            share = len(words & set(p.lower().split())) / len(words) if words else 0.0
            out.append({"entailment": share, "neutral": 1 - share, "contradiction": 0.0})
        return out

    return score


def verified(pairs: DataFrame, claim: str, make: Callable[[], Scorer] = overlap_scorer, threshold: float = 0.5) -> DataFrame:
    """``pairs`` (with ``top``, as ``windows.top_windows`` gives it) with ``verdict``: the window of highest entailment; supported if that reaches ``threshold`` and both other labels."""
    ship_package(pairs.sparkSession)
    names = [c.split()[0] for c in VERDICT.split(", ")]

    @F.pandas_udf(VERDICT)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorer = make()  # once for a partition
        for claims, tops in batches:
            flat = [(i, w, c) for i, (c, ws) in enumerate(zip(claims, tops)) for w in (ws if ws is not None and isinstance(c, str) else [])]
            scores = scorer([w for _, w, _ in flat], [c for *_, c in flat]) if flat else []
            best: dict[int, tuple] = {}
            for (i, w, _), s in zip(flat, scores):
                if i not in best or s["entailment"] > best[i][0]:
                    ok = s["entailment"] >= threshold and s["entailment"] >= s["neutral"] and s["entailment"] >= s["contradiction"]
                    best[i] = (s["entailment"], s["neutral"], s["contradiction"], "supported" if ok else "unsupported", w[:SHOWN])
            yield pd.DataFrame([best.get(i, (0.0, 1.0, 0.0, "unsupported", "")) for i in range(len(claims))], columns=names)

    return pairs.withColumn("verdict", judge(F.col(claim), F.transform("top", lambda w: w["text"])))


def request(context: str, name: str, citation: str, claim: str | None) -> str:
    """What a model is asked, as JSON."""
    return json.dumps({"target_authority": {"name": name, "citation": citation}, "tested_claim": claim or "", "passage": context}, ensure_ascii=False)


def extracted(rows: DataFrame, ask: Callable[[str], dict]) -> DataFrame:
    """``rows`` (context, target_case, target_citation, claim) with ``extraction`` and ``error``. ``ask``: request to {"text", "refusal", "status"}."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("extraction string, error string")
    def run(contexts: pd.Series, names: pd.Series, citations: pd.Series, claims: pd.Series) -> pd.DataFrame:
        out = []
        for c, n, t, k in zip(contexts, names, citations, claims):
            if not all(isinstance(x, str) and x.strip() for x in (c, n, t)):
                out.append((None, "missing_field"))
                continue
            try:
                answer = ask(request(c, n, t, k if isinstance(k, str) else None))
            except Exception as e:
                out.append((None, f"request_failed:{str(e)[:500]}"))
                continue
            text, refusal, status = (answer.get(x) for x in ("text", "refusal", "status"))
            if refusal:
                out.append((None, f"model_refusal:{refusal}"))
            elif status not in (None, "completed"):
                out.append((None, f"incomplete_response:{status}"))
            elif not (text or "").strip():
                out.append((None, "empty_structured_output"))
            else:
                out.append((text, None) if readable_object(text) is not None else (None, "structured_output_not_json"))
        return pd.DataFrame(out, columns=["extraction", "error"])

    made = rows.withColumn("_e", run(F.col("context"), F.col("target_case"), F.col("target_citation"), F.col("claim")))
    return made.select(*rows.columns, "_e.extraction", "_e.error")
