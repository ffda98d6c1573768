"""Text of HTML."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def text_of(value: str | None) -> str | None:
    """The pieces of text between tags, joined by spaces, entities resolved (also those written twice); comments are dropped, bodies of scripts and styles kept. Null stays null."""
    if not isinstance(value, str):
        return None
    parser = _Texts()
    parser.feed(value)
    parser.close()
    return html.unescape(" ".join(parser.found))


def html_text(value: Column) -> Column:
    """``text_of`` as a column, in Arrow batches: Spark has no function for entities."""
    return F.pandas_udf(lambda s: pd.Series([text_of(v) for v in s], dtype=object), "string")(value)
