"""Spans of regular expressions as array columns, with built-in functions only.

A span is a struct (start, rank, end, kind, value) in code points, end exclusive; its natural order is by start, then rank.
Offsets come from two views of one text: the matches and the pieces between them. All steps over
the spans of a row are scans by doubling (``running``) or lookups, n log n for n spans: nothing grows an
array one by one. Texts are cut into BLOCK code points before pieces are taken from the middle.
Patterns must not match the empty string. They are written possessively where that
does not change what they match, so that very long texts need no deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
_BLOCK_BITS = 9
BLOCK = 1 << _BLOCK_BITS
_POWERS = tuple(1 << k for k in range(31))


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body or a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of a bound array by doubling; combine(before, own) is associative and given null where nothing is before."""
    steps = F.filter(F.array(*(F.lit(p) for p in _POWERS)), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda state, s: F.transform(state, lambda x, i: combine(F.get(state, i - s), x)))


def _sum(before: Column, own: Column) -> Column:
    return own + F.coalesce(before, F.lit(0))


def scanned(values: Column, combine: Callable[[Column, Column], Column], body: Callable[[Column], Column]) -> Column:
    """body(the running totals of values), both evaluated once."""
    return bound(values, lambda own: bound(running(own, combine), body))


def _span(start: Column, rank: Column, end: Column, kind: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), kind.alias("kind"), value.alias("value"))


def spans(text: Column, pattern: str | Column, kind: str | Column, rank: int | Column, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of a Java pattern; value is the given group, start and end are the whole match's."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind_of = F.lit(kind) if isinstance(kind, str) else kind
    rank_of = F.lit(rank) if isinstance(rank, int) else rank
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    between = F.split(text, pattern if isinstance(pattern, str) else regex, -1)
    columns = [between.alias("gap"), whole.alias("whole")]
    if group:
        columns.append(F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))

    def placed(steps: Column) -> Column:
        lengths = F.transform(steps, lambda s: F.length(s["gap"]) + F.coalesce(F.length(s["whole"]), F.lit(0)))
        # The last gap has no match after it.
        matches = F.slice(steps, 1, F.size(steps) - 1)
        return scanned(lengths, _sum, lambda ends: F.transform(matches, lambda s, i: _span(F.get(ends, i) - F.length(s["whole"]), rank_of.cast("int"), F.get(ends, i), kind_of, s["value" if group else "whole"])))

    return bound(F.arrays_zip(*columns), placed)


def ordered(*arrays: Column) -> Column:
    """The spans of several arrays by start, then rank."""
    return F.array_sort(F.concat(*arrays))


def rendered(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def apart(found: Column, base: Column) -> Column:
    """The spans of found that overlap none of base, sorted: in the order of starts, none before may reach into a span, and none begin in it."""
    mark = lambda own: lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("span"))

    def kept(events: Column) -> Column:
        ends = F.transform(events, lambda e: F.when(e["own"] == 0, e["span"]["end"]))
        starts = F.reverse(F.transform(events, lambda e: F.when(e["own"] == 0, e["start"])))
        free = lambda far, near: F.transform(events, lambda e, i: F.when(
            (e["own"] == 1) & (F.coalesce(F.get(far, i), F.lit(0)) <= e["start"]) & (F.coalesce(F.get(near, F.size(events) - 1 - i), e["span"]["end"]) >= e["span"]["end"]), e["span"]))
        return F.filter(scanned(ends, F.greatest, lambda far: scanned(starts, F.least, lambda near: free(far, near))), lambda s: s.isNotNull())

    events = lambda found, base: F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(found, mark(1))))
    either = lambda found, base: F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(bound(events(found, base), kept))
    return bound(found, lambda own: bound(base, lambda others: either(own, others)))


def merged(found: Column) -> Column:
    """Sorted spans with overlapping ones joined under the first's kind."""

    def joined(own: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i)["start"] >= F.get(reach, i - 1)))

        def one(heads: Column) -> Column:
            def cut(i: Column, k: Column) -> Column:
                s = F.get(own, i)
                return _span(s["start"], s["rank"], F.coalesce(F.get(reach, F.get(heads, k + 1) - 1), F.get(reach, F.size(own) - 1)), s["kind"], s["value"])

            return F.transform(heads, cut)

        return bound(heads, one)

    whole = lambda own: scanned(F.transform(own, lambda s: s["end"]), F.greatest, lambda reach: joined(own, reach))
    return bound(found, lambda own: F.when(F.size(own) < 2, own).otherwise(whole(own)))


def blocks(text: Column) -> Column:
    """A text in stretches of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text cut by ``blocks``; the cost is that of two blocks and of what is taken."""
    first, last = F.shiftright(start, _BLOCK_BITS), F.shiftright(end, _BLOCK_BITS)
    at = lambda block: F.coalesce(F.get(cut, block), F.lit(""))
    skipped = start - F.shiftleft(first, _BLOCK_BITS) + 1
    across = F.concat(F.substring(at(first), skipped, F.lit(BLOCK)), F.array_join(F.slice(cut, first + 2, last - first - 1), ""), F.substring(at(last), F.lit(1), end - F.shiftleft(last, _BLOCK_BITS)))
    return F.when(end <= start, "").when(first == last, F.substring(at(first), skipped, end - start)).otherwise(across)


def replaced(text: Column, found: Column, label: Callable[[Column, Column], Column]) -> Column:
    """text with each of its disjoint sorted spans replaced by label(span, the covered text)."""

    def put(own: Column, cut: Column) -> Column:
        before = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        pieces = F.transform(own, lambda s, i: F.concat(piece(cut, before(i), s["start"]), label(s, piece(cut, s["start"], s["end"]))))
        return F.concat(F.array_join(pieces, ""), piece(cut, before(F.size(own)), F.length(text)))

    return bound(found, lambda own: F.when(F.size(own) == 0, text).otherwise(bound(blocks(text), lambda cut: put(own, cut))))
