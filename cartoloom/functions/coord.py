"""Coordinates from {{coord|...}} templates, as column expressions.

Contract: comments and nowiki parts don't count; the first coord template of the text does, in any case of letters. Its
unnamed arguments are read from the left: two decimal numbers; or, for each of latitude and longitude, one to three numbers
(degrees, minutes, seconds) and a hemisphere N, S, E or W. Arguments with `=` or `:` are parameters and end the numbers.
A bad number, a missing hemisphere or a value out of range is an error, which names the arguments as they stand in the text;
no template is neither coordinate nor error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartoloom.functions.binding import let

_SKIP = r"(?is)<!--.*?-->|<nowiki>.*?</nowiki>|<nowiki\s*/>"
_TEMPLATE = r"(?is)\{\{\s*coord\s*\|([^{}]*)\}\}"


def arguments(text: Column) -> Column:
    """The unnamed arguments of the first template, in order; null if there is none."""

    def read(clean: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.regexp_extract(clean, _TEMPLATE, 1), r"\|"), lambda a: F.trim(a)), lambda a: ~a.rlike("[=:]") & (a != ""))
        return F.when(F.regexp_like(clean, F.lit(_TEMPLATE)), parts)

    return let(F.regexp_replace(text, _SKIP, ""), read)


def _angle(parts: Column, sign: Column) -> Column:
    """Degrees of one to three numbers; null if one of them isn't one or is negative after the first."""
    number = F.transform(parts, lambda p: p.try_cast("double"))
    value = lambda n, k: F.when(F.size(n) > k, F.get(n, F.lit(k))).otherwise(F.lit(0.0))
    sound = lambda n: F.size(n).between(1, 3) & (value(n, 0) >= 0) & value(n, 1).between(0, 60) & value(n, 2).between(0, 60)
    return let(number, lambda n: F.when(sound(n), value(n, 0) + value(n, 1) / 60 + value(n, 2) / 3600)) * sign


def parse(text: Column) -> Column:
    """struct<lat, lon, error>: all null if there is no template; error says why one could not be read."""

    def place(args: Column, *hemispheres: str) -> Column:
        return F.coalesce(F.least(*(F.nullif(F.array_position(args, h), F.lit(0)) for h in hemispheres)), F.lit(0)).cast("int").alias(hemispheres[0])

    def angles(x: Column) -> Column:
        args, ns, ew = x["args"], x["N"], x["E"]
        sign = lambda at, minus: F.when(F.get(args, at - 1) == minus, -1.0).otherwise(1.0)
        part = lambda start, end: F.slice(args, F.greatest(start, F.lit(1)), F.greatest(end - start, F.lit(0)))
        lettered, plain = (ns > 1) & (ew > ns + 1), (ns == 0) & (ew == 0)
        lat = F.when(lettered, _angle(part(F.lit(1), ns), sign(ns, "S"))).when(plain, F.get(args, F.lit(0)).try_cast("double"))
        lon = F.when(lettered, _angle(part(ns + 1, ew), sign(ew, "W"))).when(plain, F.get(args, F.lit(1)).try_cast("double"))
        return F.struct(x["given"].alias("given"), lat.alias("lat"), lon.alias("lon"))

    def checked(x: Column) -> Column:
        good = F.coalesce(x["lat"].between(-90, 90) & x["lon"].between(-180, 180), F.lit(False))
        error = F.when(x["given"].isNotNull() & ~good, F.concat(F.lit("bad coordinate: "), F.array_join(x["given"], "|")))
        return F.struct(F.when(good, x["lat"]).alias("lat"), F.when(good, x["lon"]).alias("lon"), error.alias("error"))

    def places(x: Column) -> Column:
        return F.struct(x["given"].alias("given"), x["args"].alias("args"), place(x["args"], "N", "S"), place(x["args"], "E", "W"))

    both = let(arguments(text), lambda given: F.struct(given.alias("given"), F.transform(given, lambda a: F.upper(a)).alias("args")))
    return let(let(let(both, places), angles), checked)
