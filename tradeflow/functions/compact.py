"""Columns side by side in one long, which takes less room on its way than they do, and back again, without loss."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Part:
    """A value, the whole number that stands for it (from 0; null where none does) in so many bits, and the way back."""

    value: Column
    code: Column
    bits: int
    back: Callable[[Column], Column]


def hundredths(v: Column, bits: int, of: Callable[[Column], Column] = lambda x: x) -> Part:
    """of(v) for a double v, by v's hundredths where they give back the very same double."""
    whole = F.rint(v * 100).try_cast("long")
    return Part(of(v), F.when(whole / F.lit(100.0) == v, whole), bits, lambda c: of(c / F.lit(100.0)))


def number(v: Column, bits: int, kind: str) -> Part:
    return Part(v, v.cast("long"), bits, lambda c: c.cast(kind))


def flag(v: Column) -> Part:
    return Part(v, v.cast("long"), 1, lambda c: c == 1)


def day(at: Column, kind: T.DataType, bits: int = 16) -> Part:
    """A time without a zone, by its date where nothing is left of the day; times of other kinds have no number."""
    start = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int")).cast("timestamp_ntz")
    if kind != T.TimestampNTZType():
        return Part(at, F.lit(None).cast("long"), bits, lambda c: F.lit(None).cast(kind))
    date = F.to_date(at)
    return Part(at, F.when(date.cast("timestamp_ntz") == at, F.unix_date(date).cast("long")), bits, start)


def pack(**parts: Part) -> dict[str, Column]:
    """word: the parts side by side, null where one of them is null or too large; odd: their values there, as a struct."""
    if sum(p.bits for p in parts.values()) > 63:
        raise ValueError("parts do not fit into a long")
    word, used = F.lit(0).cast("long"), 0
    for p in parts.values():
        word = word + F.shiftleft(F.when((p.code >= 0) & (p.code < 1 << p.bits), p.code), used)
        used += p.bits
    return {"word": word, "odd": F.when(word.isNull(), F.struct(*[p.value.alias(n) for n, p in parts.items()]))}


def unpack(parts: dict[str, Part], of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The values that went into `pack`, of a row or struct that has word and odd."""
    out, used = {}, 0
    for n, p in parts.items():
        code = F.shiftright(of("word"), used).bitwiseAND(F.lit((1 << p.bits) - 1).cast("long"))
        out[n] = F.coalesce(p.back(code), of("odd")[n])
        used += p.bits
    return out
