"""A remote wiki as a data source: batches of titles are partitions, answers are merged by title.

There is no network here: ``fetch`` is a parameter, any function from a list of titles to rows, and tests give one.
``client`` makes one from ``get``, a function from the parameters of a call to its JSON; ``http`` is such a function.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import batches
from .stage import written

COLUMNS = ("title", "alias", "categories", "links", "redirects", "extract", "missing")
PAGE = "title string, alias string, categories array<string>, links array<string>, redirects array<string>, extract string, missing boolean"
MERGED = "title string, aliases array<string>, categories array<string>, links array<string>, redirects array<string>, extract string, missing boolean"
#: What can be asked of a page, by the column that it fills; the parameters are those of the public API.
PROPERTIES = {
    "missing": {"prop": "info", "redirects": "1"},
    "links": {"prop": "links", "plnamespace": "0", "pllimit": "max", "redirects": "1"},
    "categories": {"prop": "categories", "cllimit": "max", "clshow": "!hidden", "redirects": "1"},
    "redirects": {"prop": "redirects", "rdlimit": "max", "rdnamespace": "0"},
    "extract": {"prop": "extracts", "explaintext": "1", "exsectionformat": "plain", "redirects": "1"},
}
BUSY = (429, 500, 502, 503, 504)
Get = Callable[[dict], dict]
Fetch = Callable[[list[str]], list[dict]]


class Busy(OSError):
    """The service asks to come back after so many seconds."""

    def __init__(self, after: float = 0.0) -> None:
        super().__init__(f"busy for {after} s")
        self.after = after

    def __reduce__(self) -> tuple:
        return Busy, (self.after,)


def http(api: str, agent: str, limit: float = 60.0) -> Get:
    """Calls over HTTP."""

    def get(params: dict) -> dict:
        try:
            with urlopen(Request(f"{api}?{urlencode(params)}", headers={"User-Agent": agent}), timeout=limit) as answer:
                return json.load(answer)
        except HTTPError as error:
            if error.code not in BUSY:
                raise
            told = error.headers.get("Retry-After") or ""
            raise Busy(float(told) if told.isdigit() else 0.0) from error

    return get


def paced(get: Get, interval: float = 0.0, longest: float = 8.0) -> Get:
    """get with a pause between calls, which doubles when the service is busy and shrinks by a tenth with each answer."""
    pause = interval

    def slow(params: dict) -> dict:
        nonlocal pause
        time.sleep(pause)
        try:
            answer = get(params)
        except OSError:
            pause = min(max(2 * pause, interval), longest)
            raise
        pause = max(interval, 0.9 * pause)
        return answer

    return slow


def with_retry(fetch: Callable, attempts: int = 6, wait: float = 1.0) -> Callable:
    """fetch, repeated with longer waits, and no sooner than the service asks for; after the last failure the batch gives nothing."""

    def patient(asked: list[str] | dict) -> list[dict] | dict:
        for attempt in range(attempts):
            try:
                return fetch(asked)
            except (OSError, ValueError) as error:
                if attempt + 1 < attempts:
                    time.sleep(max(wait * 2**attempt, getattr(error, "after", 0.0)))
        return type(asked)()

    return patient


def paged(get: Get, params: dict, most: int = 60) -> Iterator[dict]:
    """The parts of an answer, which go on until none says how to continue."""
    more: dict = {}
    for _ in range(most):
        answer = get({"action": "query", "format": "json", "formatversion": "2"} | params | more)
        yield answer.get("query", {})
        more = {k: str(v) for k, v in answer.get("continue", {}).items()}
        if not more:
            return


def _names(entries: list[dict]) -> list[str]:
    return [e["title"] for e in entries if e.get("title")]


def client(get: Get, *wanted: str) -> Fetch:
    """A fetch that asks for the wanted columns of ``PROPERTIES`` (all of them by default), every part of each answer a row.

    Extracts come one title a call, which is what the API allows. Categories lose the name of their namespace.
    """

    def one(column: str, page: dict) -> dict:
        row = {"title": page["title"], "missing": bool(page.get("missing"))}
        if column == "extract":
            row["extract"] = (page.get("extract") or "").strip()
        elif column == "categories":
            row["categories"] = [n.split(":", 1)[-1] for n in _names(page.get("categories", []))]
        elif column != "missing":
            row[column] = _names(page.get(column, []))
        return row

    def fetch(titles: list[str]) -> list[dict]:
        rows: list[dict] = []
        for column in wanted or PROPERTIES:
            for asked in [[t] for t in titles] if column == "extract" else [titles]:
                for part in paged(get, PROPERTIES[column] | {"titles": "|".join(asked)}):
                    rows += [one(column, page) for page in part.get("pages", []) if page.get("title")]
                    rows += [{"title": m["to"], "alias": m["from"]} for kind in ("normalized", "redirects") for m in part.get(kind, [])]
        return rows

    return fetch


def pages(titles: DataFrame, fetch: Fetch, size: int = 20) -> DataFrame:
    """Pages of the titles: one call for each batch, the parts of a page that came in several answers joined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[r.get(c) for c in COLUMNS] for members in frame["members"] for r in fetch(list(members))]
            yield pd.DataFrame(rows, columns=list(COLUMNS), dtype=object)

    parts = batches(titles, "title", size).select("members").mapInPandas(run, PAGE)
    joined = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda x: x != ""))).alias(c)
    return parts.groupBy("title").agg(F.collect_set("alias").alias("aliases"), joined("categories"), joined("links"), joined("redirects"), F.max("extract").alias("extract"), F.coalesce(F.bool_or("missing"), F.lit(False)).alias("missing"))


def failed(titles: DataFrame, got: DataFrame) -> DataFrame:
    """The titles for which no answer came, neither under their own name nor under one that they redirect to."""
    there = got.select("title").unionByName(got.select(F.explode("aliases").alias("title")))
    return titles.select("title").distinct().join(there, "title", "left_anti")


def recovered(wanted: DataFrame, known: DataFrame, fetch: Fetch, size: int = 20) -> DataFrame:
    """Pages of the wanted titles that are not known yet."""
    return pages(wanted.join(known.select("title"), "title", "left_anti"), fetch, size)


def stored(wanted: DataFrame, path: str, fetch: Fetch, size: int = 20) -> DataFrame:
    """Pages of the wanted titles by way of a table of answers at path: only titles without one are asked for, and appended.

    Titles for which nothing came are not stored, so that the next run asks for them again. fetch must give all of a batch
    or nothing, as ``with_retry(client(get))`` does.
    """
    spark = wanted.sparkSession
    try:
        known = spark.read.schema(MERGED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], MERGED)
    names = known.select("title").unionByName(known.select(F.explode("aliases").alias("title")))
    # Written first: what is appended and what is returned must come from the same calls.
    fresh = written(recovered(wanted.select("title").distinct(), names, fetch, size).join(known.select("title"), "title", "left_anti"), "pages")
    own = wanted.select(F.col("title").alias("asked")).distinct()
    every = written(known.unionByName(fresh), "known").withColumn("asked", F.explode(F.array_distinct(F.concat(F.array("title"), "aliases"))))
    found = every.join(own, "asked", "left_semi").drop("asked").dropDuplicates(["title"])
    fresh.write.mode("append").parquet(path)
    return found
