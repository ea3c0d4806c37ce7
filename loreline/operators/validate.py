"""Documents against a JSON schema. Plain functions for the workers, and the operator that maps them over documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_JSON_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def is_type(value: object, name: str) -> bool:
    """Whether a parsed JSON value has a type of the schema language; true and false are no numbers."""
    return isinstance(value, _JSON_TYPES[name]) and (name == "boolean" or not isinstance(value, bool))


def _here(value: object, rules: dict) -> Iterator[str]:
    """What is wrong with a value by itself, but for its type."""
    if "const" in rules and value != rules["const"]:
        yield "differs from const"
    if "enum" in rules and value not in rules["enum"]:
        yield "not in enum"
    if isinstance(value, str):
        if len(value) < rules.get("minLength", 0):
            yield "too short"
        if "pattern" in rules and not re.search(rules["pattern"], value):
            yield "does not fit pattern"
    elif is_type(value, "number") and value < rules.get("minimum", value):
        yield "below minimum"
    elif isinstance(value, list):
        if len(value) < rules.get("minItems", 0):
            yield "too few items"
        if rules.get("uniqueItems") and len(set(map(_canonical, value))) < len(value):
            yield "items repeat"


def _canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True)


def _inside(value: object, rules: dict) -> Iterator[tuple[str, object, dict | None]]:
    """(step, part, its rules) of the parts of a value; rules are None for a part that may not be there."""
    if isinstance(value, dict):
        known, open_ = rules.get("properties", {}), rules.get("additionalProperties") is not False
        for name, part in value.items():
            yield f".{name}", part, known.get(name, {} if open_ else None)
    elif isinstance(value, list):
        for n, part in enumerate(value):
            yield f"[{n}]", part, rules.get("items", {})


def problems(value: object, schema: dict) -> list[tuple[str, str]]:
    """(path, problem) of all that is wrong, in document order; a value of a wrong type is not looked into.

    Keywords: $ref within the schema, type, const, enum, minLength, pattern, minimum, required, properties,
    additionalProperties (true or false), minItems, uniqueItems, items. Others are not checked.
    """
    found: list[tuple[str, str]] = []
    todo: list[tuple[str, object, dict | None]] = [("$", value, schema)]
    while todo:
        path, here, rules = todo.pop()
        if rules is None:
            found.append((path, "unexpected"))
            continue
        while "$ref" in rules:
            target = schema
            for step in rules["$ref"].removeprefix("#").split("/")[1:]:
                target = target[step]
            rules = target
        allowed = rules.get("type", [])
        allowed = [allowed] if isinstance(allowed, str) else allowed
        if allowed and not any(is_type(here, t) for t in allowed):
            found.append((path, f"not {' or '.join(allowed)}"))
            continue
        found += [(path, p) for p in _here(here, rules)]
        if isinstance(here, dict):
            found += [(path, f"{name} is missing") for name in rules.get("required", []) if name not in here]
        todo += reversed([(path + step, part, sub) for step, part, sub in _inside(here, rules)])
    return found


def schema_errors(documents: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """key, path and problem of documents whose column text holds JSON; text that is no JSON, or null, is one problem at $."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text], strict=True):
                try:
                    wrong = problems(json.loads(t), schema)
                except (ValueError, TypeError):
                    wrong = [("$", "no JSON")]
                rows += [(k, *w) for w in wrong]
            yield pd.DataFrame(rows, columns=[key, "path", "problem"])

    return documents.select(key, text).mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, path string, problem string")


def sound(documents: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """The gate at the end of a pipeline: documents without a problem; key must be unique."""
    wrong = schema_errors(documents, key, text, schema).select(key).distinct()
    return documents.join(wrong, key, "left_anti").select(documents.columns)
