"""Fetching from outside, once for each key: citation look-ups, documents, PDF files, model answers.

What fetches is a function that the caller gives, so that tests and offline runs need no network. Keys are made distinct
before anything is fetched, and the result is written to the shared folder once, so that neither a retried task nor a later
action asks again for what is there. A failure is a value in the column ``error``, never a failed job.

Defined results for odd input: null keys are fetched for nobody and left out; an empty table fetches nothing; a function that
raises gives the message, cut to 500 characters; a message with 429 or "throttl" is tried again, after a wait that grows.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.functions.lexical import citation_parts
from evidelta.session import ship_package, stored

ATTEMPTS, WAIT, PAUSE = 5, 20.0, 1.05


def attempt(fetch: Callable[[str], Any], key: str, attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, str | None]:
    """Result and error of one key; tries again, ever later, while it is throttled."""
    for n in range(1, attempts + 1):
        try:
            return fetch(key), None
        except Exception as e:
            message = str(e)[:500] or type(e).__name__
            if n == attempts or ("429" not in message and "throttl" not in message.lower()):
                return None, message
            sleep(wait * n)
    return None, None


def fetched(df: DataFrame, key: str, fetch: Callable[[str], Any], attempts: int = ATTEMPTS, wait: float = WAIT, pause: float = 0.0, at_once: int | None = None) -> DataFrame:
    """``key``, ``answer`` (JSON) and ``error`` of each distinct key. ``at_once``: the tasks that may fetch at a time; ``pause``: seconds between two fetches of one."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, k in enumerate(batch[key]):
                if i and pause:
                    time.sleep(pause)
                answer, error = attempt(fetch, k, attempts, wait)
                rows.append((k, None if error else json.dumps(answer, ensure_ascii=False, default=str), error))
            yield pd.DataFrame(rows, columns=[key, "answer", "error"])

    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct()
    if at_once:
        keys = keys.repartition(at_once, key)
    return stored(keys.mapInPandas(run, f"`{key}` string, answer string, error string"))


def single_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``values`` of the keys that have several values, null among them; a cache by key needs none."""
    return df.groupBy(key).agg(F.count_distinct(F.coalesce(F.to_json(F.struct(value)), F.lit(""))).alias("values")).where(F.col("values") > 1)


def reports_url(citation: Column, base: str) -> Column:
    """Address of the PDF of a citation to the U.S. Reports under ``base``; null for other citations."""
    parts = citation_parts(citation)
    ours = F.regexp_replace(F.upper(parts["reporter"]), r"[.\s]", "") == "US"
    return F.when(ours, F.format_string(f"{base}/USREPORTS-%d/pdf/USREPORTS-%d-%d.pdf", parts["volume"], parts["volume"], parts["page"]))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit(b"%PDF")), F.lit(False))


def pdf_text(content: bytes) -> dict:
    """Text, pages, characters and SHA-256 of a PDF; needs the optional package ``pypdf``."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e
    pages = PdfReader(io.BytesIO(content)).pages
    text = "\n".join(t for t in ((p.extract_text() or "") for p in pages) if t.strip()).strip()
    if not text:
        raise ValueError("the PDF holds no text")
    return {"text": text, "pages": len(pages), "characters": len(text), "text_sha256": hashlib.sha256(text.encode()).hexdigest()}


def pdf_texts(files: DataFrame, read: Callable[[bytes], dict] = pdf_text) -> DataFrame:
    """``path``, ``text``, ``pages``, ``characters``, ``text_sha256`` and ``error`` of files as ``spark.read.format("binaryFile")`` gives them."""
    ship_package(files.sparkSession)
    names = ["path", "text", "pages", "characters", "text_sha256", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                if not bytes(content).startswith(b"%PDF"):
                    rows.append((path, None, None, None, None, "not a PDF"))
                    continue
                try:
                    got = read(bytes(content))
                    rows.append((path, *[got[n] for n in names[1:5]], None))
                except Exception as e:
                    rows.append((path, None, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=names).astype({"pages": "Int32", "characters": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, text string, pages int, characters bigint, text_sha256 string, error string")
