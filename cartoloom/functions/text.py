"""Scalar functions on texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Letters and numbers of any script; everything else separates. Case stays."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def token_list(text: Column) -> Column:
    joined = tokens(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def number_or_zero(text: Column) -> Column:
    """The number, or 0 where there is none or it can't be read."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


TEN_MILLION, SPLIT, LARGE = 1e7, float((1 << 27) + 1), 9e8


def _sevenths(value: Column) -> Column:
    """The size of a number below LARGE in ten-millionths, rounded from its exact binary value, halves to even.

    The number is split into two halves of 26 bits, whose products with ten million are exact; so the error of the rounded
    product is known, and with it on which side of a half the exact one lies.
    """
    size = F.abs(value)
    high = size * SPLIT - (size * SPLIT - size)
    product = size * TEN_MILLION
    error = (high * TEN_MILLION - product) + (size - high) * TEN_MILLION
    whole = F.floor(product)
    beyond = (product - whole - 0.5) + error
    return whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1).otherwise(0)


def seven_decimals(value: Column) -> Column:
    """The number to seven places as text, rounded from its exact binary value (the built-in formatter rounds its shortest
    decimal one); null for null and NaN. Of LARGE numbers the shortest decimal value is taken, infinite ones are null."""
    n = _sevenths(value)
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.floor(n / 10_000_000).cast("string"), F.lit("."), F.lpad((n % 10_000_000).cast("string"), 7, "0"))
    return F.when(F.isnan(value), None).when(F.abs(value) < LARGE, text).otherwise(value.try_cast("decimal(38,7)").cast("string"))


def round_coordinate(value: Column) -> Column:
    """The double nearest to the number at seven places; for numbers below LARGE."""
    return F.when(value < 0, -_sevenths(value)).otherwise(_sevenths(value)) / TEN_MILLION


def byte_length(text: Column) -> Column:
    """Bytes of the text and its closing NUL."""
    return F.octet_length(text) + 1


def nul_terminated(text: Column) -> Column:
    return F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00")))


def grid_key(x: Column) -> Column:
    """(whole part towards zero, millionths of the rest)."""
    whole = x.cast("int")
    return F.struct(whole.alias("whole"), ((x - whole) * 1_000_000).cast("int").alias("millionths"))


def scaled(lat: Column, lon: Column) -> Column:
    """Map units: minutes of arc, with x growing westwards."""
    return F.struct((lat * 60).alias("y"), (lon * -60).alias("x"))
