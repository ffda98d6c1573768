"""Reading JSON texts that may be broken, wrapped, misshapen or very deep."""

from __future__ import annotations

import json
import re
from typing import Any


class Number(str):
    """A number as it is written, so that none is too long or loses digits."""


def _no_constant(name: str) -> Any:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant).decode
_SCALAR = re.compile(r'("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)', re.ASCII)
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str) -> Any:
    """The same without recursion, for texts nested beyond the decoder's limit."""
    stack: list[tuple[Any, str | None]] = []  # open containers; of an object, the key that waits for its value
    at, value = 0, None
    state = "value"
    skip = lambda i: _BLANK.match(text, i).end()
    while True:
        at = skip(at)
        c = text[at : at + 1]
        if state == "key":
            m = _SCALAR.match(text, at)
            if not m or not m.group(1):
                raise ValueError(at)
            at = skip(m.end())
            if text[at : at + 1] != ":":
                raise ValueError(at)
            stack[-1] = (stack[-1][0], json.loads(m.group(1)))
            at, state = at + 1, "value"
            continue
        if state == "value":
            if c and c in "{[":
                stack.append(({} if c == "{" else [], None))
                at = skip(at + 1)
                if text[at : at + 1] != ("}" if c == "{" else "]"):
                    state = "key" if c == "{" else "value"
                    continue
                at, value = at + 1, stack.pop()[0]
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise ValueError(at)
                value = json.loads(m.group(1)) if m.group(1) else Number(m.group(2)) if m.group(2) else _WORDS[m.group(3)]
                at = m.end()
        # a value is complete: put it into its container, and close what ends here
        while stack:
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            at = skip(at)
            c = text[at : at + 1]
            at += 1
            if c == ",":
                state = "key" if isinstance(holder, dict) else "value"
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(at)
            value = stack.pop()[0]
        else:
            if skip(at) != len(text):
                raise ValueError(at)
            return value


def parse(text: str) -> Any:
    """The value of a complete JSON text, numbers as they are written. NaN and infinities are no JSON; of repeated keys the last counts."""
    try:
        return _decode(text)
    except RecursionError:
        return _deep(text)


def readable_object(text: Any) -> dict | None:
    """The object that ``text`` holds: itself a complete JSON object, or a JSON string whose content is one.

    Null, empty, truncated and other texts give None; depth and length of numbers don't matter.
    """
    if not isinstance(text, str):
        return None
    try:
        value = parse(text)
        if isinstance(value, str) and not isinstance(value, Number):
            value = parse(value)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def plain(text: str | None) -> str | None:
    """``text`` with lone surrogates, which no UTF-8 column can hold, as replacement characters."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def kind_of(value: Any) -> str:
    """object, array, string, number, boolean or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return "number" if isinstance(value, (Number, int, float)) else "string"


def scalar_text(value: Any) -> str | None:
    """A leaf as text: strings and numbers as they are, booleans as in JSON; None for null, objects and arrays."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return plain(value) if isinstance(value, str) else json.dumps(value)
