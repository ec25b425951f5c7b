"""Frontmatter: split, YAML to JSON, typed access to the VARIANT column."""

from __future__ import annotations

import datetime
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_note(raw: Column) -> tuple[Column, Column]:
    """(frontmatter block or NULL, body) of a raw note; string search only."""
    closing = F.locate("\n---", raw, 4)
    has_block = F.startswith(raw, F.lit("---\n")) & (closing > 0)
    block = F.when(has_block, F.substr(raw, F.lit(5), F.greatest(closing - 5, F.lit(0))))
    rest = F.substr(raw, closing + 4)
    body = F.when(has_block, F.regexp_replace(rest, r"\A\n", "")).otherwise(raw)
    return block, body


def yaml_to_json(block: Column) -> Column:
    """YAML mapping as JSON text; NULL where the block does not parse.

    The helpers are local, so the function travels to executors by value and
    they need PyYAML only.
    """

    def plain(value):
        if isinstance(value, dict):
            return {str(k): plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple, set)):
            return [plain(v) for v in value]
        if isinstance(value, (datetime.date, datetime.datetime)):
            return value.isoformat()
        if isinstance(value, bytes):
            return value.decode("utf-8", "replace")
        if isinstance(value, float) and not math.isfinite(value):
            return None
        return value

    def convert_batch(blocks: pd.Series) -> pd.Series:
        import yaml

        base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        bool_tag = "tag:yaml.org,2002:bool"
        # Only true and false are booleans; yes, no, on and off stay text.
        resolvers = {
            first: [(tag, rx) for tag, rx in pairs if tag != bool_tag or first in "tTfF"]
            for first, pairs in base.yaml_implicit_resolvers.items()
        }
        loader = type("NoteLoader", (base,), {"yaml_implicit_resolvers": resolvers})
        # Most blocks are flat lines of plain values, which need no YAML parser.
        item = r'"[ !#-\[\]-~\u00a1-\u024f]*"|[A-Za-z](?:[A-Za-z0-9 _./-]*[A-Za-z0-9])?|[0-9]+-[A-Za-z](?:[A-Za-z -]*[A-Za-z])?'
        number = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,6})?"
        line_of = re.compile(
            rf"([A-Za-z_][A-Za-z0-9_-]*): (?:({number})|(true|false)|({item})|\[((?:{item})(?:, (?:{item}))*)\])"
        )
        item_of = re.compile(item)
        reserved = {"null", "Null", "NULL", "true", "True", "TRUE", "false", "False", "FALSE"}

        def flat(text):
            out = {}
            for line in text.split("\n"):
                m = line_of.fullmatch(line)
                if m is None or m[1] in reserved:
                    return None
                key, num, flag, word, many = m.groups()
                if num is not None:
                    out[key] = float(num) if "." in num else int(num)
                elif flag is not None:
                    out[key] = flag == "true"
                else:
                    words = [word] if many is None else item_of.findall(many)
                    if not reserved.isdisjoint(words):
                        return None
                    words = [w[1:-1] if w[0] == '"' else w for w in words]
                    out[key] = words[0] if many is None else words
            return out

        def convert(text):
            if text is None:
                return None
            simple = flat(text)
            if simple is not None:
                return json.dumps(simple)
            try:
                value = yaml.load(text, Loader=loader)
                return json.dumps(plain(value)) if isinstance(value, dict) else "{}"
            except (yaml.YAMLError, ValueError, RecursionError):
                return None

        return blocks.map(convert)

    # Marked so that a filter on the result is not moved below it, which would call it a second time.
    return F.pandas_udf(convert_batch, T.StringType()).asNondeterministic()(block)


def key_path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def value(fm: Column, key: str) -> Column:
    """The variant below ``key``, NULL where the key is absent."""
    return F.try_variant_get(fm, key_path(key), "variant")


def kind(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def string_only(variant: Column) -> Column:
    """The text of a variant that holds a string, else NULL."""
    return F.when(kind(variant) == "STRING", F.try_variant_get(variant, "$", "string"))


def text(fm: Column, key: str) -> Column:
    """A frontmatter value when, and only when, it is a string."""
    return string_only(value(fm, key))


def scalar_text(fm: Column, key: str) -> Column:
    """Any scalar frontmatter value as text."""
    return F.try_variant_get(fm, key_path(key), "string")


def is_array(variant: Column) -> Column:
    return F.startswith(kind(variant), F.lit("ARRAY"))


def strings(fm: Column, key: str) -> Column:
    """The string elements of an array value; NULL when it is no array."""
    items = F.try_variant_get(fm, key_path(key), "array<variant>")
    return F.filter(F.transform(items, string_only), lambda s: s.isNotNull())


def first_text(fm: Column, *keys: str) -> Column:
    """The first of several key spellings that holds a string."""
    return F.coalesce(*[text(fm, k) for k in keys])
