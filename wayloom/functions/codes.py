"""Route codes and Polish and English plural forms."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the code format: limits, and the letters of the options. Its prefix is an argument.
MAX_LENGTH, MAX_POINTS = 64_000, 200
ALGORITHMS = {"dijkstra": "d", "astar": "a"}
DIRECTION_MODES = {"cardinal": "k", "vertical": "p", "all": "w"}
TRANSPORT_MODES = {"off": "p", "normal": "n", "aggressive": "g"}


def _digests(text: pd.Series) -> pd.Series:
    return text.map(lambda s: xxhash.xxh3_64_hexdigest(s.encode()), na_action="ignore")


def xxh3_hex(text: Column | str) -> Column:
    """XXH3-64 (seed 0) of UTF-8 text as 16 hex digits; null stays null."""
    return F.pandas_udf(_digests, StringType())(text)


def _letter(value: Column, letters: dict[str, str], default: str) -> Column:
    out = F.lit(letters[default])
    for name, letter in letters.items():
        out = F.when(value == name, letter).otherwise(out)
    return out


def encode_route(points: Column, algorithm: Column, directions: Column, transports: Column, prefix: str) -> Column:
    """The code of a list of room ids, nulls left out; '' for under 2, over 200 or ids under 1."""
    ids = F.filter(points, lambda p: p.isNotNull())
    core = F.concat(F.lit(f"{prefix}:"), _letter(algorithm, ALGORITHMS, "dijkstra"), _letter(directions, DIRECTION_MODES, "all"), _letter(transports, TRANSPORT_MODES, "off"), F.lit(":"), F.array_join(ids.cast("array<string>"), ","))
    good = F.size(ids).between(2, MAX_POINTS) & F.forall(ids, lambda p: p > 0)
    return F.when(good, F.concat(core, F.lit(":"), F.substring(xxh3_hex(core), 1, 8))).otherwise("")


def decode_route(code: Column, prefix: str) -> Column:
    """struct(error, ids, algorithm, directions, transports): error is null, 'crc' or 'too-many'; null for no code."""
    low = F.lower(F.trim(code))
    shape = rf"^{prefix}:([da])([kpw])([png]):([1-9][0-9]*(?:,[1-9][0-9]*)*):([0-9a-f]{{8}})$"
    part = lambda i: F.regexp_extract(low, shape, i)
    name = lambda i, letters: F.element_at(F.create_map(*(F.lit(x) for k, v in letters.items() for x in (v, k))), part(i))
    ids = F.split(part(4), ",").cast("array<long>")
    core = F.substring_index(low, ":", 3)
    error = F.when(F.substring(xxh3_hex(core), 1, 8) != part(5), "crc").when(F.size(ids) > MAX_POINTS, "too-many")
    ok = (F.length(code) <= MAX_LENGTH) & low.rlike(shape)
    return F.when(ok, F.struct(error.alias("error"), ids.alias("ids"), name(1, ALGORITHMS).alias("algorithm"), name(2, DIRECTION_MODES).alias("directions"), name(3, TRANSPORT_MODES).alias("transports")))


def plural_form(n: Column, language: str) -> Column:
    """one, few or many: the form of a word after the number n."""
    if language == "pl":
        return F.when(n == 1, "one").when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), "few").otherwise("many")
    return F.when(n == 1, "one").otherwise("many")


def hex_to_rgb(color: Column) -> Column:
    """The three bytes of #rrggbb."""
    part = lambda k: F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("int")
    return F.array(*map(part, range(3)))


def rgb_to_hex(rgb: Column) -> Column:
    """#rrggbb of the first three parts, each held within a byte."""
    byte = lambda c: F.lower(F.lpad(F.hex(F.greatest(F.least(c, F.lit(255)), F.lit(0)).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), F.array_join(F.transform(F.slice(rgb, 1, 3), byte), ""))
