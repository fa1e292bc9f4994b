"""Filters as columns: which operator fits which field, how operands are read, and what a filter means inside arrays."""

from __future__ import annotations

import datetime as dt
import ipaddress
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import Block, Field, Version
from docweave.errors import InvalidArgument

_EQUAL, _SET, _RANGE, _PART, _PRESENCE = ("eq", "neq"), ("in", "not_in"), ("gt", "gte", "lt", "lte"), ("prefix", "suffix", "contains"), ("exists", "not_exists")
#: The operators of each field family, in the order in which they are told.
OPERATORS = {
    "string": (*_EQUAL, *_SET, *_PART, *_PRESENCE),
    "numeric": (*_EQUAL, *_SET, *_RANGE, *_PRESENCE),
    "temporal": (*_EQUAL, *_SET, *_RANGE, *_PRESENCE),
    "boolean": (*_EQUAL, *_PRESENCE),
    "ip": (*_EQUAL, *_SET, *_RANGE, *_PRESENCE),
    "fulltext": (),
}
#: Operators that say what no value may be, and what they deny.
NEGATIONS = {"neq": "eq", "not_in": "in", "not_exists": "exists"}


@dataclass(frozen=True)
class Filter:
    field: str
    op: str = "eq"
    value: str = ""
    values: tuple[str, ...] = ()
    nested_path: str = ""


def operators(field: Field, reference: bool = False) -> tuple[str, ...]:
    """What a field can be filtered by; a referenced field takes no negation, which would be about some child only."""
    found = OPERATORS[field.family]
    return tuple(x for x in found if x not in NEGATIONS) if reference else found


def resolve(version: Version, path: str) -> tuple[Field, bool]:
    """The field a path names, and whether it is reached through a reference."""
    head, _, name = path.partition(".")
    if head == "fields" and version.field(name):
        return version.field(name), False
    relation = version.relation(head)
    if relation is not None and relation.field(name):
        return relation.field(name), relation.reference
    block = version.block(head)
    if block is not None:
        for f in block.fields:
            if f.name == name:
                return f, False
    raise InvalidArgument(f"unknown filter field {path!r}")


def check(version: Version, filters: list[Filter]) -> None:
    """Raises InvalidArgument at a filter that a request must not have; a filter without a field is ignored, here too."""
    for f in filters:
        if not f.field:
            continue
        field, reference = resolve(version, f.field)
        if f.op not in operators(field, reference):
            raise InvalidArgument(f"operator {f.op} can't be used on {f.field!r} of type {field.type}")
        single, several = f.value != "", len(f.values) > 0
        wanted = (False, True) if f.op in _SET else (False, False) if f.op in _PRESENCE else (True, False)
        if (single, several) != wanted:
            raise InvalidArgument(f"operator {f.op} on {f.field!r} takes {'values' if wanted[1] else 'one value' if wanted[0] else 'no value'}")


# operands


_UNITS = {"y": "years", "M": "months", "w": "weeks", "d": "days", "h": "hours", "H": "hours", "m": "minutes", "s": "seconds"}


def _add(at: dt.datetime, n: int, unit: str) -> dt.datetime:
    if unit in "yM":
        months = at.year * 12 + at.month - 1 + n * (12 if unit == "y" else 1)
        year, month = months // 12, months % 12 + 1
        last = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1]
        return at.replace(year=year, month=month, day=min(at.day, last))
    return at + dt.timedelta(**{_UNITS[unit]: n})


def _floor(at: dt.datetime, unit: str) -> dt.datetime:
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    return {
        "y": lambda: day.replace(month=1, day=1), "M": lambda: day.replace(day=1), "w": lambda: day - dt.timedelta(days=day.weekday()), "d": lambda: day,
        "h": lambda: at.replace(minute=0, second=0, microsecond=0), "H": lambda: at.replace(minute=0, second=0, microsecond=0),
        "m": lambda: at.replace(second=0, microsecond=0), "s": lambda: at.replace(microsecond=0),
    }[unit]()


def read_date(text: str, now: dt.datetime | None = None) -> dt.datetime:
    """ISO 8601, milliseconds since 1970, or date math: `now` or a date and `||`, then +1d, -2h, /d and the like. UTC."""
    now = now or dt.datetime.now(dt.timezone.utc)
    base, math_ = text, ""
    if text.startswith("now"):
        at, math_ = now, text[3:]
    else:
        base, _, math_ = text.partition("||")
        if re.fullmatch(r"-?\d{5,}", base):
            at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=int(base))
        else:
            padded = base if len(base) != 4 and len(base) != 7 else base + ("-01-01" if len(base) == 4 else "-01")
            at = dt.datetime.fromisoformat(padded.replace("Z", "+00:00"))
    at = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at.astimezone(dt.timezone.utc)
    steps = re.findall(r"([+-]\d*|/)([yMwdhHms])", math_)
    if "".join(a + b for a, b in steps) != math_:
        raise ValueError(text)
    for step, unit in steps:
        at = _floor(at, unit) if step == "/" else _add(at, int(step + "1" if step in "+-" else step), unit)
    return at


def ip_key(value: Column) -> Column:
    """An address as 32 hexadecimal digits, which order as addresses do; IPv4 as IPv6-mapped; null if it is neither."""
    four = F.split(value, r"\.")
    mapped = F.concat(F.lit("0" * 20 + "ffff"), *[F.lpad(F.lower(F.hex(four[i].try_cast("int"))), 2, "0") for i in range(4)])
    halves = F.split(F.lower(value), "::")
    words = lambda part: F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda w: w != "")
    left, right = words(halves[0]), words(F.when(F.size(halves) > 1, F.element_at(halves, 2)))
    gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    filled = F.concat(left, F.when(F.size(halves) > 1, F.array_repeat(F.lit("0"), gap)).otherwise(F.array().cast("array<string>")), right)
    long = F.array_join(F.transform(filled, lambda w: F.lpad(w, 4, "0")), "")
    is_four = value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(is_four, mapped).when(value.contains(":") & (F.length(long) == 32), long)


def operand(field: Field, text: str):
    """A literal of the field's type; InvalidArgument if the text isn't one."""
    try:
        family = field.family
        if field.type in ("long", "integer"):
            n = int(text)
            bits = 63 if field.type == "long" else 31
            if not -(1 << bits) <= n < 1 << bits:
                raise ValueError(text)
            return F.lit(n).cast("long" if field.type == "long" else "int")
        if family == "numeric":
            x = float(text)
            if not math.isfinite(x):
                raise ValueError(text)
            return F.lit(x).cast(field.type)
        if family == "temporal":
            return F.lit(read_date(text))
        if family == "boolean":
            if text not in ("true", "false"):
                raise ValueError(text)
            return F.lit(text == "true")
        if family == "ip":
            address = ipaddress.ip_address(text)
            whole = int(address) + (0xFFFF << 32 if address.version == 4 else 0)
            return F.lit(f"{whole:032x}")
    except (ValueError, OverflowError) as e:
        raise InvalidArgument(f"{text!r} is not a value of type {field.type}") from e
    return F.lit(text)


def _one(field: Field, op: str, texts: tuple[str, ...]) -> Callable[[Column], Column]:
    """The positive test of a single value."""
    values = [operand(field, t) for t in texts]
    key = ip_key if field.family == "ip" else lambda c: c
    if op == "eq":
        return lambda c: key(c) == values[0]
    if op == "in":
        return lambda c: key(c).isin(*values) if len(values) > 1 else key(c) == values[0]
    if op == "exists":
        return lambda c: c.isNotNull()
    return {
        "gt": lambda c: key(c) > values[0], "gte": lambda c: key(c) >= values[0], "lt": lambda c: key(c) < values[0], "lte": lambda c: key(c) <= values[0],
        "prefix": lambda c: c.startswith(values[0]), "suffix": lambda c: c.endswith(values[0]), "contains": lambda c: c.contains(values[0]),
    }[op]


def _test(field: Field, f: Filter, value: Column, kind: T.DataType) -> Column:
    """The filter's positive part on a field's value: any element's, if the field holds several."""
    test = _one(field, NEGATIONS.get(f.op, f.op), f.values or ((f.value,) if f.value != "" else ()))
    if isinstance(kind, T.ArrayType):
        return F.exists(value, test)
    return test(value)


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def predicate(f: Filter, version: Version, schema: T.StructType) -> Column:
    """A filter outside scoped blocks. A null value passes a negation; over an array of rows a negation says of no row.

    Rows are those of the field's relation, or of an explicit nested_path, which wins: it must name nested rows, and a field
    that isn't theirs is one that none of them has.
    """
    head, _, name = f.field.partition(".")
    field, _ = resolve(version, f.field)
    holder = schema[head].dataType
    negative = f.op in NEGATIONS
    if f.nested_path and f.nested_path != head:
        if f.nested_path not in schema.fieldNames() or not isinstance(schema[f.nested_path].dataType, T.ArrayType):
            raise InvalidArgument(f"there are no nested rows at {f.nested_path!r}")
        return F.lit(negative)
    if f.nested_path and not isinstance(holder, T.ArrayType):
        raise InvalidArgument(f"there are no nested rows at {f.nested_path!r}")
    if isinstance(holder, T.ArrayType):
        inner = holder.elementType[name].dataType
        test = F.exists(F.col(head), lambda row: _sure(_test(field, f, row[name], inner)))
    else:
        test = _test(field, f, F.col(head)[name], holder[name].dataType)
    return ~_sure(test) if negative else test


def scoped_predicate(block: Block, scope: str, filters: list[Filter], schema: T.StructType) -> Column:
    """One entry of the block belongs to the scope and passes every filter on the block; an empty scope matches nothing."""
    if not scope:
        return F.lit(False)
    entry = schema[block.name].dataType.elementType

    def passes(row: Column) -> Column:
        kind = entry[block.scope_key].dataType
        own = F.array_contains(row[block.scope_key], scope) if isinstance(kind, T.ArrayType) else row[block.scope_key] == scope
        parts = [own]
        for f in filters:
            name = f.field.partition(".")[2]
            field = next(x for x in block.fields if x.name == name)
            test = _test(field, f, row[name], entry[name].dataType)
            parts.append(~_sure(test) if f.op in NEGATIONS else test)
        return _sure(reduce(lambda a, b: a & b, parts))

    return F.exists(F.col(block.name), passes)


def all_of(filters: list[Filter], version: Version, schema: T.StructType, scope: str = "") -> list[Column]:
    """Columns that must all hold: every filter, and every scoped block of the version whether a filter names it or not."""
    named = [f for f in filters if f.field]
    blocks = {b.name: b for b in version.blocks}
    plain = [predicate(f, version, schema) for f in named if f.field.partition(".")[0] not in blocks]
    return plain + [scoped_predicate(b, scope, [f for f in named if f.field.partition(".")[0] == b.name], schema) for b in blocks.values()]
