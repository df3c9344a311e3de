"""Decimal arithmetic, order-side prices and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Start of the id clock in epoch milliseconds, and bits of an id's parts.
ID_EPOCH_MS = 1711900800000
ORDER_BITS = {"unit_ms": 1000, "sequence": 9, "machine": 5}
ACCOUNT_BITS = {"unit_ms": 60_000, "sequence": 9, "machine": 6}


def add(*cols: Column) -> Column:
    """Sum that skips nulls; 0 of nothing."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0))
    return total


def subtract(first: Column, *rest: Column) -> Column:
    return F.coalesce(first, F.lit(0)) - add(*rest)


def multiply(*cols: Column) -> Column:
    """The real product (a variadic product that starts from zero would always be zero)."""
    total = F.lit(1)
    for c in cols:
        total = total * c
    return total


def divide(a: Column, b: Column, scale: int = 13) -> Column:
    """Quotient rounded half up to `scale` digits; operands have at most 18 digits, 6 of them decimals, so that the quotient keeps the digits."""
    return F.round(a.cast("decimal(18,6)") / b.cast("decimal(10,0)"), scale)


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def plain(c: Column) -> Column:
    """Decimal text without exponent or trailing zeros."""
    s = c.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


# Codes of order sides.
BUY_SIDES, SELL_SIDES = (0, 2, 4), (1, 3, 5)


def open_price(side: Column, bid: Column, ask: Column) -> Column:
    return F.when(side.isin(*BUY_SIDES), bid).when(side.isin(*SELL_SIDES), ask)


def close_price(side: Column, bid: Column, ask: Column) -> Column:
    return F.when(side.isin(*BUY_SIDES), ask).when(side.isin(*SELL_SIDES), bid)


def below_market(price: Column, offset: Column) -> Column:
    """A pending order's price below the market, at least 0."""
    return F.greatest(price - offset, F.lit(0).cast("double"))


def compose_id(at_ms: Column, machine: Column, sequence: Column, bits: dict = ORDER_BITS) -> Column:
    """A time-ordered id: units since the epoch, machine number, sequence number."""
    low = bits["sequence"] + bits["machine"]
    unit = F.floor((at_ms - F.lit(ID_EPOCH_MS)) / bits["unit_ms"]).cast("long")
    return F.shiftleft(unit, low).bitwiseOR(F.shiftleft(machine.cast("long"), bits["sequence"])).bitwiseOR(sequence.cast("long"))


def decode_id(c: Column, bits: dict = ORDER_BITS) -> Column:
    """at_ms (start of the unit), machine and sequence of an id."""
    low = bits["sequence"] + bits["machine"]
    at = F.shiftright(c, low) * bits["unit_ms"] + F.lit(ID_EPOCH_MS)
    machine = F.shiftright(c, bits["sequence"]).bitwiseAND((1 << bits["machine"]) - 1)
    return F.struct(at.alias("at_ms"), machine.alias("machine"), c.bitwiseAND((1 << bits["sequence"]) - 1).alias("sequence"))


def sequence_in_unit(at_ms: Column, *order: Column, bits: dict = ORDER_BITS) -> Column:
    """Running number of a row within its time unit, for id generation; units beyond the sequence's bits overflow."""
    unit = F.floor((at_ms - F.lit(ID_EPOCH_MS)) / bits["unit_ms"])
    return F.row_number().over(Window.partitionBy(unit).orderBy(*order)) - 1


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """A random whole number from low to high - 1; never the same twice unless seeded."""
    return (F.floor(F.rand(seed) * (high - low)) + low).cast("int")


def random_id(length: int = 32) -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, length)
