"""Canonical JSON, in plain Python and as pandas UDFs.

``canonical_json`` follows RFC 8785: keys in UTF-16 order, ECMAScript numbers, lone surrogates refused. ``snapshot_json`` sorts keys by code point,
and sets by their text; it is what fingerprints hash. Spark's ``to_json`` is neither: it keeps field order and writes 3.333333333333333E8.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class CanonicalError(ValueError):
    pass


def number_text(x: int | float) -> str:
    """As ECMAScript writes it: shortest digits, exponent from 1e21 and below 1e-6."""
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        raise CanonicalError("non-finite number")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    stripped = digits.rstrip("0")
    exponent += len(digits) - len(stripped)
    digits, n = stripped, len(stripped) + exponent  # 0.digits * 10^n
    if len(digits) <= n <= 21:
        text = digits + "0" * (n - len(digits))
    elif 0 < n <= 21:
        text = f"{digits[:n]}.{digits[n:]}"
    elif -6 < n <= 0:
        text = "0." + "0" * -n + digits
    else:
        e = n - 1
        text = digits[0] + (f".{digits[1:]}" if len(digits) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return ("-" if sign else "") + text


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


_ESCAPED = re.compile('["\\\\\x00-\x1f\ud800-\udfff]')


def string_text(s: str) -> str:
    if not _ESCAPED.search(s):
        return f'"{s}"'
    out = []
    for c in s:
        if c in _ESCAPES:
            out.append(_ESCAPES[c])
        elif ord(c) < 0x20 or 0xD800 <= ord(c) <= 0xDFFF:
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def utf16_key(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


_SURROGATE = re.compile("[\ud800-\udfff]")


def well_formed(s: str) -> bool:
    return not _SURROGATE.search(s)


def parse_json(text: str) -> object:
    """Strict JSON: no NaN or Infinity; escaped surrogate pairs are one character; of repeated keys the last counts."""

    def bad(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, parse_constant=bad)


def _write(value: object, order) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        if order is utf16_key and not well_formed(value):
            raise CanonicalError("lone surrogate")
        return string_text(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, dict):
        if order is utf16_key and not all(map(well_formed, value)):
            raise CanonicalError("lone surrogate")
        return "{" + ",".join(f"{string_text(k)}:{_write(value[k], order)}" for k in sorted(value, key=order)) + "}"
    if isinstance(value, (set, frozenset)):
        return "[" + ",".join(sorted(_write(v, order) for v in value)) + "]"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_write(v, order) for v in value) + "]"
    raise CanonicalError(f"unsupported value {type(value).__name__}")


def canonical_json(value: object) -> str:
    return _write(value, utf16_key)


def event_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def snapshot_json(value: object) -> str:
    return _write(value, str)


def fingerprint(value: object) -> str:
    return hashlib.sha256(snapshot_json(value).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(StringType())
def canonical_json_udf(raw: pd.Series) -> pd.Series:
    """Canonical form of each JSON text; null if it is not JSON or has none."""

    def one(text):
        try:
            return None if text is None else canonical_json(parse_json(text))
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


@F.pandas_udf(StringType())
def snapshot_json_udf(raw: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else snapshot_json(parse_json(text))
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def fingerprint_column(raw: Column) -> Column:
    return F.sha2(snapshot_json_udf(raw).cast("binary"), 256)
