"""Typed reads of field values, as columns of VALUE (kind, b, i, u, f, s, v) and as Python on (kind, value).

Lenient reads give a default where a value is missing or of another kind, and so never fail; strict ones give null for a missing value and fail on a
wrong kind or range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.values import cell_to_world

_RANGES = {"i8": (-(1 << 7), (1 << 7) - 1), "i16": (-(1 << 15), (1 << 15) - 1), "i32": (-(1 << 31), (1 << 31) - 1), "i64": (-(1 << 63), (1 << 63) - 1), "u8": (0, (1 << 8) - 1), "u16": (0, (1 << 16) - 1), "u32": (0, (1 << 32) - 1), "u64": (0, (1 << 64) - 1)}
_INTEGERS = ("i32", "i64", "u32", "u64")


def _dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(21,0)")


def integer(v: Column) -> Column:
    """Any of the integer kinds as decimal(21,0), else null."""
    return F.coalesce(v["i"].cast("decimal(21,0)"), v["u"].cast("decimal(21,0)"))


def _wrapped(v: Column, bits: int, signed: bool) -> Column:
    n = F.pmod(integer(v), _dec(1 << bits))
    return F.when(n >= _dec(1 << (bits - 1)), n - _dec(1 << bits)).otherwise(n) if signed else n


def get_i64(v: Column) -> Column:
    """Any integer; the largest unsigned ones wrap to negative; else 0."""
    return F.coalesce(_wrapped(v, 64, True).cast("bigint"), F.lit(0).cast("bigint"))


def get_u32(v: Column) -> Column:
    """The low 32 bits of any integer, else 0."""
    return F.coalesce(_wrapped(v, 32, False).cast("bigint"), F.lit(0).cast("bigint"))


def get_f32(v: Column) -> Column:
    return F.coalesce(v["f"], F.lit(0.0).cast("float"))


def get_bool(v: Column) -> Column:
    return F.coalesce(v["b"], F.lit(False))


def _zeros() -> Column:
    return F.array(*[F.lit(0.0).cast("float")] * 3)


def get_qangle(v: Column) -> Column:
    return F.when(v["kind"] == "qangle", v["v"]).otherwise(_zeros())


def get_vector3(v: Column) -> Column:
    """Three numbers, or the first three of a longer list; an angle is no vector."""
    return F.when(v["kind"] == "vector3", v["v"]).when((v["kind"] == "floats") & (F.size(v["v"]) >= 3), F.slice(v["v"], 1, 3)).otherwise(_zeros())


def get_handle(v: Column) -> Column:
    """The low 32 bits of any integer, else null."""
    return _wrapped(v, 32, False).cast("bigint")


def get_u64(v: Column) -> Column:
    """Any integer, negative ones as the largest; else null."""
    return _wrapped(v, 64, False).cast("decimal(20,0)")


def get_bytes(v: Column) -> Column:
    return v["s"]


def get_str(v: Column) -> Column:
    """Text where the bytes are valid UTF-8, else null."""
    return F.try_validate_utf8(v["s"].cast("string"))


def get_string(v: Column) -> Column:
    """Text; what is no UTF-8 becomes a mark."""
    return F.make_valid_utf8(v["s"].cast("string"))


def strict(v: Column, kind: str, owned: bool = True) -> Column:
    """A value as one of i8 to u64, f32, bool, bytes, vector2 to vector4 or three angles (vector3 of a qangle).

    Signed targets take signed kinds and unsigned ones unsigned kinds; with owned false, integers of any kind. Null stays null.
    """
    fails = lambda: F.raise_error(F.concat(F.lit(f"no {kind}: "), F.coalesce(v["kind"], F.lit("?"))))
    missing = v.isNull() | v["kind"].isNull()
    if kind in _RANGES:
        low, high = _RANGES[kind]
        kinds = _INTEGERS if not owned else ("i32", "i64") if kind[0] == "i" else ("u32", "u64")
        fits = v["kind"].isin(*kinds) & integer(v).between(_dec(low), _dec(high))
        target = "decimal(20,0)" if kind == "u64" else "bigint"
        return F.when(missing, None).when(fits, integer(v).cast(target)).otherwise(fails().cast(target))
    name, kinds = {"f32": ("f", ("f32",)), "bool": ("b", ("bool",)), "bytes": ("s", ("string",))}.get(kind, ("v", (kind, "qangle") if kind == "vector3" else (kind,)))
    return F.when(missing, None).when(v["kind"].isin(*kinds), v[name]).otherwise(fails().cast({"f": "float", "b": "boolean", "s": "binary", "v": "array<float>"}[name]))


def convert(value: tuple[str, object] | None, kind: str, owned: bool = True) -> object:
    """strict() in Python."""
    if value is None:
        return None
    own, x = value
    if kind in _RANGES:
        low, high = _RANGES[kind]
        kinds = _INTEGERS if not owned else ("i32", "i64") if kind[0] == "i" else ("u32", "u64")
        if own in kinds and low <= x <= high:
            return x
    elif own == {"bytes": "string"}.get(kind, kind) or kind == "vector3" and own == "qangle":
        return x
    raise ValueError(f"{own} is no {kind}")


def world_position(cells: tuple[Column, Column, Column], offsets: tuple[Column, Column, Column]) -> Column:
    """A position from the values of three cells and three offsets; missing ones count as 0."""
    low = lambda v: _wrapped(v, 32, True).cast("int")
    return F.array(*(cell_to_world(F.coalesce(low(c), F.lit(0)), get_f32(o)) for c, o in zip(cells, offsets)))


def latest_fields(deltas: DataFrame) -> DataFrame:
    """(demo_id, entity_index, incarnation, class_name, key, field_name, value): the last value of each key of each incarnation of a slot.

    Deltas as the replay gives them. A create begins an incarnation; its number is the tick and place of that row, so nothing is ordered over a
    demo: creates of a slot are collected by slot, and values meet the last of them before.
    """
    per = W.partitionBy("demo_id", "entity_index").orderBy("tick", "seq").rowsBetween(W.unboundedPreceding, 0)
    born = F.max(F.when((F.col("op") == "create") & F.col("key").isNull(), F.struct("tick", "seq"))).over(per)
    value = F.struct("kind", "b", "i", "u", "f", "s", "v")
    kept = deltas.withColumn("incarnation", born).filter("key is not null")
    keys = ["demo_id", "entity_index", "incarnation", "class_name", "key"]
    return kept.groupBy(*keys).agg(F.max_by(F.struct("field_name", value.alias("value")), F.struct("tick", "seq")).alias("__last")).select(*keys, "__last.field_name", "__last.value")


def shown(value: tuple[str, object]) -> str:
    """A value as text."""
    kind, x = value
    if kind == "string":
        return x.decode("utf-8", "replace")
    if kind == "bool":
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        inside = ", ".join(f"{float(y):g}" for y in x)
        return f"QAngle({inside})" if kind == "qangle" else f"[{inside}]"
    return f"{float(x):g}" if kind == "f32" else str(x)


def plain(value: tuple[str, object]) -> object:
    """A value as JSON has it: the kind is lost."""
    kind, x = value
    return x.decode("utf-8", "replace") if kind == "string" else [float(y) for y in x] if isinstance(x, (list, tuple)) else float(x) if kind == "f32" else x


def named(values: Mapping[int, tuple[str, object]], serializer) -> dict[str, object]:
    """An entity's values by dotted name, as JSON has them."""
    return {serializer.name_of(k): plain(v) for k, v in values.items()}
