"""Nested records as JSON text: the object within a model's answer, merging with a skeleton, and paths of any depth."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import per_distinct


def balanced_object(text: Column) -> Column:
    """The first {...} whose brackets close, strings and escapes in it left alone; '' if there is none, null of null.

    The text after its first { is cut into escapes, quotes, brackets and what lies between; one pass over these keeps the
    depth and whether a string is open, and notes where the depth is 0 again. A quote before the { doesn't matter.
    """
    rest = F.substring(text, F.nullif(F.instr(text, "{"), F.lit(0)), F.length(text))
    parts = F.regexp_extract_all(rest, F.lit(r'(?s)\\.|["{}]|[^"\\{}]+|\\'), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, part: Column) -> Column:
        # an escape only counts in a string; elsewhere its second sign does
        sign = F.when(s["quoted"] & F.startswith(part, F.lit("\\")), "").otherwise(F.substring(part, -1, 1))
        depth = s["depth"] + F.when(s["quoted"], 0).when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        at = s["at"] + F.length(part)
        closed = (s["end"] == 0) & ~s["quoted"] & (depth == 0) & (sign == "}")
        return F.struct(depth.alias("depth"), (s["quoted"] != (sign == '"')).alias("quoted"), at.alias("at"), F.when(closed, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(parts, start, step)["end"]
    return F.when(text.isNotNull(), F.coalesce(F.substring(rest, F.lit(1), end), F.lit("")))


def model_json(answer: Column) -> Column:
    """The JSON of a model's answer as variant: without thoughts and code fences the whole, else its first balanced object; null if neither is JSON."""
    plain = F.btrim(F.regexp_replace(F.btrim(answer, F.lit(" \t\r\n")), r"(?s)<think>.*?</think>", ""), F.lit(" \t\r\n"))
    fenced = F.btrim(F.regexp_replace(F.regexp_replace(plain, r"^```\w*\n?", ""), r"\n?```$", ""), F.lit(" \t\r\n"))
    clean = F.when(F.startswith(plain, F.lit("```")), fenced).otherwise(plain)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(F.nullif(balanced_object(clean), F.lit(""))))


def _text(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _parsed(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def merge(skeleton: Any, data: Any) -> Any:
    if isinstance(skeleton, dict) and isinstance(data, dict):
        return {k: merge(v, data[k]) if k in data else v for k, v in skeleton.items()} | {k: v for k, v in data.items() if k not in skeleton}
    return skeleton if data is None else data


def strip_empty(value: Any) -> Any:
    """value without entries that are null, blank, empty or all empty, at any depth; items of arrays stay."""
    if isinstance(value, dict):
        kept = {k: strip_empty(v) for k, v in value.items()}
        return {k: v for k, v in kept.items() if not (v is None or v in ([], {}) or isinstance(v, str) and not v.strip())}
    return [strip_empty(v) for v in value] if isinstance(value, list) else value


def merged_with(record: Column, skeleton: Column) -> Column:
    """JSON text of the record with all that the skeleton has besides, to any depth; the skeleton's order of keys first.

    The record's values win unless they are null; arrays are taken whole. Null or broken JSON on either side: null.
    """

    def both(own: str, base: str) -> str | None:
        (a, data), (b, default) = _parsed(own), _parsed(base)
        return _text(merge(default, data)) if a and b else None

    return per_distinct(both, "string")(record, skeleton)


def stripped(record: Column) -> Column:
    """JSON text without empty entries, at any depth; null of broken JSON."""

    def strip(own: str) -> str | None:
        fine, data = _parsed(own)
        return _text(strip_empty(data)) if fine else None

    return per_distinct(strip, "string")(record)


def flat_paths(record: Column) -> Column:
    """array<struct<path, value>> of a JSON text, any depth, in order of path; null of broken JSON.

    A path joins keys by dots. Objects are opened; an array is its items' texts sorted and joined by |, an item that is
    an object or array with its keys sorted. Null, blank and empty values are left out.
    """

    def scalar(value: Any) -> str:
        if isinstance(value, (dict, list)):
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
        return "" if value is None else value if isinstance(value, str) else json.dumps(value)

    def flat(own: str) -> list[dict] | None:
        fine, data = _parsed(own)
        if not fine:
            return None
        out: dict[str, str] = {}

        def visit(value: Any, path: str) -> None:
            if isinstance(value, dict):
                for k, v in value.items():
                    visit(v, f"{path}.{k}" if path else k)
            else:
                out[path] = "|".join(sorted(map(scalar, value))) if isinstance(value, list) else scalar(value)

        visit(data, "")
        return [{"path": p, "value": v} for p, v in sorted(out.items()) if v.strip()]

    return per_distinct(flat, "array<struct<path: string, value: string>>")(record)
