"""Hashes, vectors, numbers and arrays as column expressions."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a struct as JSON with its fields in alphabetical order and nulls written out."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def line_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a unit separator."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\u0000"), text), 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def build_identity(fields: dict[str, object]) -> str:
    return hashlib.sha256(canonical_json(fields).encode()).hexdigest()


@F.arrow_udf(StringType())
def point_id(values: pa.Array) -> pa.Array:
    """Version-5 UUID of each key in the URL name space."""
    return pa.array([None if v is None else str(uuid.uuid5(uuid.NAMESPACE_URL, v)) for v in values.to_pylist()])


def child_list(metadata: Column, *, strict: bool = False) -> Column:
    """The trimmed child ids of a JSON object's child_skus; empty, or an error if strict, where there are none to read."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    found = F.from_json(metadata, "child_skus array<string>", mode)["child_skus"]
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")


def child_names(evidence: Column) -> Column:
    """(child_sku, name) of each evidence record that has both, the first of each child."""
    records = F.from_json(evidence, "array<struct<child_sku:string,raw:map<string,string>>>")
    named = F.transform(F.coalesce(records, F.array().cast("array<struct<child_sku:string,raw:map<string,string>>>")), lambda r: F.struct(F.trim(r["child_sku"]).alias("child_sku"), F.trim(F.try_element_at(r["raw"], F.lit("商品名称"))).alias("name")))
    return F.filter(named, lambda r: (r["child_sku"] != "") & (r["name"] != ""))


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles, cast before multiplying."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit_score(cos: Column) -> Column:
    """(cos + 1) / 2, held within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def valid_vector(v: Column, dimension: int, *, allow_zero: bool = True) -> Column:
    fine = v.isNotNull() & (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return fine if allow_zero else fine & F.exists(v, lambda x: x != 0)


def probability(c: Column) -> Column:
    """Null for what is no probability."""
    return F.when(~F.isnan(c) & c.between(0, 1), c)


def count_or_amount(c: Column, *, integer: bool = False) -> Column:
    """A finite number of at least 0, whole if asked for; else null."""
    value = c.try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value != float("inf"))
    return F.when(fine & (value == F.floor(value)) if integer else fine, value)


def percent_change(before: Column, now: Column) -> Column:
    return F.when(before != 0, (now - before) * 100.0 / before)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_iso_utc(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c).isNotNull() & (c.endswith("Z") | c.endswith("+00:00")), F.lit(False))


def every_nth(a: Column, most: int) -> Column:
    """At most `most` elements, evenly spread from the first on."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(a, (F.floor(i * F.size(a) / most) + 1).cast("int")))
    return F.when(F.size(a) <= most, a).otherwise(picked)


def batch_number(position: Column, size: int) -> Column:
    """Which batch of `size` a position from 1 falls in, from 0."""
    return F.floor((position - 1) / size)
