"""The one text that a JSON value has in files whose bytes are compared or hashed.

Fixed by the format: keys in the order of their UTF-16 units, two blanks of indent a level, lists of
at most eight plain values on one line, and numbers as a browser writes them.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INLINE = 8


def number(x: int | float) -> str:
    """Whole numbers under 1e21 without a point; others by their shortest digits, with an exponent below 1e-6 and from 1e21 on."""
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    sign, digits, e = Decimal(repr(float(x))).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + e
    if d == "0":
        return "0"
    if -6 < point <= 0:
        out = "0." + "0" * -point + d
    elif 0 < point <= 21:
        out = d + "0" * (point - len(d)) if point >= len(d) else f"{d[:point]}.{d[point:]}"
    else:
        out = d[0] + ("." + d[1:] if d[1:] else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def _plain(v) -> str:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return number(v)
    return json.dumps(v, ensure_ascii=False)


def canonical(value, level: int = 1) -> str:
    inner = []
    if isinstance(value, dict):
        ends = "{}"
        inner = [f"{_plain(k)}: {canonical(value[k], level + 1)}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))]
    elif isinstance(value, list):
        ends = "[]"
        if len(value) <= INLINE and not any(isinstance(v, (dict, list)) for v in value):
            return "[" + ", ".join(map(_plain, value)) + "]"
        inner = [canonical(v, level + 1) for v in value]
    else:
        return _plain(value)
    pad = "\n" + "  " * level
    return ends if not inner else ends[0] + pad + f",{pad}".join(inner) + pad[:-2] + ends[1]


def _texts(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: canonical(json.loads(s)), na_action="ignore")


def canonical_json(raw: Column | str) -> Column:
    """The canonical text of JSON text; null stays null."""
    return F.pandas_udf(_texts, StringType())(raw)


def _sums(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: xxhash.xxh3_64_hexdigest(canonical(json.loads(s)).encode()), na_action="ignore")


def json_hash(raw: Column | str) -> Column:
    """XXH3-64 of the canonical text of JSON text, as 16 hex digits; null stays null."""
    return F.pandas_udf(_sums, StringType())(raw)
