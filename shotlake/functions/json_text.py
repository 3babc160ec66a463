"""Keys at any depth of JSON text."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _spelt(character: str) -> str:
    """A pattern for a character as it is or as an escape."""
    code = "".join(f"[{d}{d.upper()}]" if d.isalpha() else d for d in f"{ord(character):04x}")
    return rf"(?:{re.escape(character)}|\\u{code})" if ord(character) < 0x10000 else re.escape(character)


def has_key(text: Column, key: str) -> Column:
    """Whether a key occurs at any depth, however it is spelt; the same characters inside a string value do not count."""
    return F.coalesce(text.rlike(rf'(?<!\\)"{"".join(map(_spelt, key))}"\s*:'), F.lit(False))


def _without(value: Any, key: str) -> Any:
    if isinstance(value, dict):
        return {k: _without(v, key) for k, v in value.items() if k != key}
    return [_without(v, key) for v in value] if isinstance(value, list) else value


def strip_key(text: Column, key: str) -> Column:
    """JSON text without a key, at any depth. Only rows that hold the key are parsed."""

    @F.pandas_udf("string")
    def strip(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else json.dumps(_without(json.loads(x), key), ensure_ascii=False, separators=(",", ":")))

    held = F.when(has_key(text, key), text)
    return F.coalesce(strip(held), text)
