"""The few scans that built-in functions cannot express, as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

MENTIONS = "array<struct<start:int,end:int,surface:string,name:string,type:string>>"
_LEFT = re.compile("[가-힣A-Za-z0-9]")
_RIGHT = re.compile(fixed.NAME_SUFFIX + fixed.NAME_PARTICLE + "(?![가-힣])")


def match_starts(pattern: str) -> Callable[[Column], Column]:
    """Start offsets of all matches of a pattern."""
    rx = re.compile(pattern)

    @F.pandas_udf("array<int>")
    def starts(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [m.start() for m in rx.finditer(t or "")])

    return starts


def mention_scan(surfaces: dict[str, tuple[str, str]]) -> Callable[[Column], Column]:
    """Mentions of a surface table (surface -> name, type): longest surface first, by the boundaries of names.

    The table goes to each worker with the function; callers check its size (``entities.surface_table``).
    """
    ordered = sorted(surfaces, key=lambda s: (-len(s), s))
    rx = re.compile("|".join(map(re.escape, ordered))) if ordered else None

    def found(text: str | None) -> list[dict]:
        out = []
        for m in rx.finditer(text or "") if rx else ():
            before = text[m.start() - 1] if m.start() else ""
            if not _LEFT.match(before) and _RIGHT.match(text, m.end()):
                name, kind = surfaces[m[0]]
                out.append({"start": m.start(), "end": m.end(), "surface": m[0], "name": name, "type": kind})
        return out

    @F.pandas_udf(MENTIONS)
    def scan(text: pd.Series) -> pd.Series:
        return text.map(found)

    return scan
