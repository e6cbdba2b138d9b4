"""Schema-on-read access to JSON message values, as Column builders. No UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("eq", "ne", "gt", "ge", "lt", "le")


def text(value: Column) -> Column:
    return F.decode(value, "UTF-8")


def is_object(value: Column) -> Column:
    """A value is an object only if its very first byte opens one."""
    return F.coalesce(value.startswith("{"), F.lit(False))


def _path(name: str) -> str:
    """A name is one key, whatever characters it has; quotes can't be told in a path."""
    if "'" in name:
        raise ValueError(f"no field can be named {name!r}")
    return f"$['{name}']"


def _scalar(value: Column, name: str, raw: Column) -> Column:
    """A field's text; null if it is nested. Only what begins like a nested value is looked at twice: a string may begin so."""
    whole = F.try_variant_get(F.try_parse_json(value), _path(name), "variant")
    is_text = F.schema_of_variant(whole) == "STRING"
    return F.when(raw.startswith("{") | raw.startswith("["), F.when(is_text, raw)).otherwise(raw)


def field(value: Column, name: str) -> Column:
    """A top-level scalar as text; null where it is missing, null or nested."""
    return _scalar(value, name, F.get_json_object(value, _path(name)))


def with_fields(rows: DataFrame, value: str, names: dict[str, str]) -> DataFrame:
    """Rows with the fields of a JSON column, as ``column: field``, from one reading of each value."""
    if not names:
        return rows
    raw = [f"_raw{i}" for i in range(len(names))]
    read = rows.select("*", F.json_tuple(value, *names.values()).alias(*raw))
    return read.withColumns({c: _scalar(F.col(value), n, F.col(r)) for (c, n), r in zip(names.items(), raw, strict=True)}).drop(*raw)


def with_first_fields(rows: DataFrame, value: str, names: dict[str, str]) -> DataFrame:
    """with_fields, where of a repeated name the first counts, as in ``field``. Fields go through a row of an array, so that
    Spark doesn't copy their reading into each expression and filter over them."""
    if not names:
        return rows
    raw = [f"_raw{i}" for i in range(len(names))]
    read = rows.select("*", F.inline(F.array(F.struct(*[F.get_json_object(value, _path(n)).alias(r) for n, r in zip(names.values(), raw, strict=True)]))))
    return read.withColumns({c: _scalar(F.col(value), n, F.col(r)) for (c, n), r in zip(names.items(), raw, strict=True)}).drop(*raw)


def number(x: Column) -> Column:
    return x.try_cast("double")


def canonical(x: Column) -> Column:
    """Text in which equal numbers are equal: 1, 1.0 and "1" agree."""
    n = number(x)
    whole = n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(whole, n.cast("bigint").cast("string")).otherwise(x)


def compare(x: Column, op: str, literal: object) -> Column:
    """A predicate that is never null: a missing operand fails every operator, ``ne`` too."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}; one of {OPERATORS}")
    told = str(literal).lower() if isinstance(literal, bool) else str(literal)
    n, m = number(x), number(F.lit(told))
    if op in ("eq", "ne"):
        same = F.when(n.isNotNull() & m.isNotNull(), n == m).otherwise(x == F.lit(told))
        return F.coalesce(same if op == "eq" else ~same, F.lit(False))
    tests = {"gt": n > m, "ge": n >= m, "lt": n < m, "le": n <= m}
    return F.coalesce(tests[op], F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def key_text(columns: dict[str, Column]) -> Column:
    """``a=x|b=y``, with the word null for what is missing."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("null"))) for name, c in columns.items()])


def with_default(x: Column, default: object) -> Column:
    return F.coalesce(x, F.lit(default))


def alias_of(value: Column, *names: str) -> Column:
    """The first of several spellings of a field that is there."""
    return F.coalesce(*[field(value, n) for n in names])


def percent_decoded(x: Column) -> Column:
    """URL decoding; a text with malformed escapes stays as it is."""
    return F.coalesce(F.try_url_decode(x), x)


def base64_text(data: Column) -> Column:
    """Base64 in one line; Spark may break it every 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def object_of(value: Column, names: list[str]) -> Column:
    """A JSON object of the named fields in this order; missing fields are left out."""
    return F.to_json(F.struct(*[field(value, n).alias(n) for n in names])) if names else F.lit("{}")


def _crc_table() -> list[int]:
    """Remainders of all bytes by the reversed Castagnoli polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


def crc32c(data: Column) -> Column:
    """CRC-32C (Castagnoli) of bytes, unsigned; null of null. A lookup a byte, without Python."""
    table = F.array(*[F.lit(x).cast("bigint") for x in _crc_table()])
    hexed = F.hex(data)
    byte_at = lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    step = lambda c, i: F.shiftrightunsigned(c, 8).bitwiseXOR(F.get(table, c.bitwiseXOR(byte_at(i)).bitwiseAND(255).cast("int")))
    return F.when(data.isNotNull(), F.aggregate(places, F.lit(0xFFFFFFFF).cast("bigint"), step).bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint")))
