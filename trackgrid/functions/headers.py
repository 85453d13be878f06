"""Cleaning of column headers. Works on names, never on data."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

# What is turned into a blank, what is removed, and the name an
# empty header gets.
BLANKED = "!()*+,-./:;<=>?[]^_{|}~"
REMOVED = "'\"`"
EMPTY_NAME = "header"

_TRANSLATION = str.maketrans({**dict.fromkeys(BLANKED, " "), **dict.fromkeys(REMOVED, None)})

# A word starts where a run of capitals, of digits or of non-word characters
# starts, and at a capital followed by a small letter.
_WORD_START = re.compile(r"(?=[A-Z][a-z])|(?<![A-Z])(?=[A-Z])|(?<![0-9])(?=[0-9])|(?<!\W)(?=\W)")


def snake_case(name: str | None) -> str:
    """One header in snake case: ``location-long`` -> ``location_long``."""
    text = (name or EMPTY_NAME).translate(_TRANSLATION)
    return "_".join(_WORD_START.sub(" ", text).lower().split()) or EMPTY_NAME


def number_duplicates(names: Iterable[str]) -> list[str]:
    """Append ``_1``, ``_2`` ... to repeats, stepping over names already taken."""
    names = list(names)
    taken, used, out = set(names), {}, []
    for name in names:
        n = used.get(name, 0)
        new = name
        if n:
            while (new := f"{name}_{n}") in taken:
                n += 1
            taken.add(new)
        used[name] = n + 1
        out.append(new)
    return out


def clean_names(names: Iterable[str | None]) -> list[str]:
    return number_duplicates(snake_case(n) for n in names)


def clean_report(before: Iterable[str], after: Iterable[str]) -> dict:
    """How many headers changed, out of how many, and the percentage."""
    before, after = list(before), list(after)
    changed = sum(a != b for a, b in zip(after, before))
    percent = round(changed / len(before) * 100, 2) if before else 0.0
    return {"cleaned": changed, "columns": len(before), "percent": percent}


def clean_headers(df: DataFrame, report: bool = False):
    """Rename all columns of ``df`` to snake case.

    With ``report`` the result is ``(df, dict)``. Nothing is printed.
    """
    new = clean_names(df.columns)
    cleaned = df.toDF(*new)
    return (cleaned, clean_report(df.columns, new)) if report else cleaned
