"""JSON texts, name-based identifiers, decimals cut."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value) -> str:
    """JSON with keys in order and numbers written out, in as few digits as tell them apart."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(str(k))}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a finite number")
        if value == 0 and math.copysign(1, value) < 0:
            return "-0.0"
        text = format(Decimal(repr(value)), "f")
        return text.removesuffix(".0")
    return json.dumps(value, ensure_ascii=False)


def canonical_json(c: Column) -> Column:
    """The canonical form of a JSON text; a text that is none raises."""

    @F.arrow_udf("string")
    def rewritten(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical(json.loads(t)) for t in texts.to_pylist()], pa.string())

    return rewritten(c)


#: Fixed value: the namespace of URLs (RFC 4122).
URLS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = URLS) -> Column:
    """The version 5 UUID of a name, natively."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def round_down(c: Column, places: int) -> Column:
    """A decimal cut towards zero."""
    return F.when(c >= 0, F.floor(c, F.lit(places))).otherwise(F.ceil(c, F.lit(places)))


def leaves(c: Column) -> Column:
    """name, value of every leaf of a JSON object: names joined by dots, values as text (lists as canonical JSON)."""

    def walk(path: str, v):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(f"{path}.{k}" if path else k, x)
        else:
            yield {"name": path, "value": v if isinstance(v, str) else canonical(v)}

    @F.arrow_udf("array<struct<name:string,value:string>>")
    def listed(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        return pa.array([list(walk("", json.loads(t or "{}"))) for t in texts.to_pylist()], kind)

    return listed(c)
