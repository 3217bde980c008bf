"""Tolerant reading of JSON that language models write."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_object(text: str) -> str | None:
    """The first balanced ``{...}`` of a text; braces inside strings don't count."""
    start = text.find("{")
    if start < 0:
        return None
    depth, inside, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif c == "\\" and inside:
            skip = True
        elif c == '"':
            inside = not inside
        elif not inside and c == "{":
            depth += 1
        elif not inside and c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    last = text.rfind("}")
    return text[start : last + 1] if last > start else None


_NEXT = re.compile(r"\S")


def escape_inner_quotes(text: str) -> str:
    """Escape quotes that stand inside a string.

    The next character other than white space tells: a quote ends a key only before a colon, and a
    value only before a comma, a closing bracket or brace, or at the end.  One pass over the text.
    """
    out: list[str] = []
    boxes: list[str] = []
    inside = value = False
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if inside and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if not inside:
            if c in "{[":
                boxes.append(c)
                value = c == "["
            elif c in "}]" and boxes:
                boxes.pop()
            elif c == ":":
                value = True
            elif c == ",":
                value = bool(boxes) and boxes[-1] == "["
            inside = c == '"'
        elif c == '"':
            after = _NEXT.search(text, i + 1)
            if (after is None or after.group() in ",}]") if value else (after is not None and after.group() == ":"):
                inside = False
            else:
                out.append("\\")
        out.append(c)
        i += 1
    return "".join(out)


def close_braces(text: str) -> str | None:
    """A text that begins with a brace and closes too few of them, with those added."""
    missing = text.count("{") - text.count("}")
    return text + "}" * missing if missing > 0 and text.startswith("{") else None


def repair(text: str | None) -> str | None:
    """The object of a model's reply as compact JSON with sorted keys, or null."""
    if text is None:
        return None
    bare = text.strip()
    if bare.startswith("```"):
        bare = bare.split("\n", 1)[-1].rsplit("```", 1)[0]
    bare = bare.strip()
    found = outer_object(bare)
    ready = [bare, found, close_braces(bare)]
    for candidate in (*ready, *(escape_inner_quotes(c) for c in dict.fromkeys(ready) if c)):
        if candidate is None:
            continue
        try:
            value = json.loads(candidate, strict=False)
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return None


def tolerant_object(text: Column) -> Column:
    """Replies that are plain JSON objects are kept as they are; the repair sees nulls for them, which
    it hands back at once."""
    plain = F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{")

    @F.pandas_udf("string")
    def repaired(batch: pd.Series) -> pd.Series:
        return batch.map(repair, na_action="ignore")

    return F.when(plain, text).otherwise(repaired(F.when(~plain, text)))


REPLY_PATHS = ["$.choices[0].message.content", "$.choices[0].text", "$.message.content", "$.response", "$.output_text", "$.output[0].content[0].text", "$.content[0].text", "$.text"]


def reply_text(reply: Column) -> Column:
    """The text of a chat reply in any of the usual shapes."""
    return F.coalesce(*[F.nullif(F.get_json_object(reply, p), F.lit("")) for p in REPLY_PATHS])
