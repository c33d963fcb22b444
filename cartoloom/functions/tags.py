"""Tag maps: conditions, trimming and building."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

def parse_conditions(text: str) -> list[list[tuple[str, str | None]]]:
    """Groups (any of which may hold) of conditions (all of which must): `a,b+c,k~v`. A value of None asks for the key alone.

    Equal groups merge. An empty text is an error, as is an empty condition.
    """
    if not text or not text.strip():
        raise ValueError("tag conditions are empty")
    groups: dict[str, list[tuple[str, str | None]]] = {}
    for group in text.split(","):
        parts = []
        for condition in group.split("+"):
            key, tilde, value = condition.strip().partition("~")
            if not key:
                raise ValueError(f"empty condition in {text!r}")
            parts.append((key, value if tilde else None))
        groups.setdefault(group, parts)
    return list(groups.values())


def matches(tags: Column, conditions: str | None) -> Column:
    """Whether the tags meet the conditions; None lets everything pass, null tags meet none."""
    if conditions is None:
        return F.lit(True)

    def one(key: str, value: str | None) -> Column:
        held = F.map_contains_key(tags, key) if value is None else tags[key] == value
        return F.coalesce(held, F.lit(False))

    return functools.reduce(operator.or_, (functools.reduce(operator.and_, (one(k, v) for k, v in group)) for group in parse_conditions(conditions)))


def has_tags(tags: Column) -> Column:
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")  # white space as Unicode has it


def trim(tags: Column) -> Column:
    """Keys and values without the white space around them; of keys that become equal the last wins. For output only."""
    return F.map_from_entries(F.transform(F.map_entries(tags), lambda e: F.struct(_trimmed(e["key"]), _trimmed(e["value"]))))


def from_pairs(pairs: Column, key: str = "_k", value: str = "_v") -> Column:
    """A map of an array of structs: without empty keys or values, the last of equal keys wins, {} for null."""
    kept = F.filter(pairs, lambda p: (p[key] != "") & (p[value] != ""))
    return F.coalesce(F.map_from_entries(F.transform(kept, lambda p: F.struct(p[key], p[value]))), F.create_map().cast("map<string,string>"))


def to_lists(tags: Column) -> Column:
    """The entries in order of their keys: map columns can't be compared or grouped, this can."""
    return F.array_sort(F.map_entries(tags))
