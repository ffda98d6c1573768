"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace of any kind, as a Java character class.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is made once though the body uses it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(text: Column) -> Column:
    """Without surrounding whitespace of any kind."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def fold_value(text: Column, default: str | None = "unknown") -> Column:
    """Stripped, in lower case, spaces as underscores; null becomes ``default``, an empty text stays empty."""
    folded = F.replace(F.lower(strip(text)), F.lit(" "), F.lit("_"))
    return folded if default is None else F.coalesce(folded, F.lit(default))
