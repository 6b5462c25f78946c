"""What ties episode records together: places, parents and what they derive from."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.paths import resolve_path

AT = r"^(.*)#\s*(-?\d+)\s*$"  # <path>#<episode_index>
LINKS = "struct<parents:array<string>,derived:array<string>>"


def _text(value) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return text.strip() or None


def _walk(value, parents: list, derived: list) -> None:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                text = _text(v)
                if k == "parent_id" and text:
                    parents.append(text)
                elif k == "derived_from" and text:
                    derived.append(text)
                stack.append(v)
        elif isinstance(x, list):
            stack.extend(x)


def links_of(text: str | None) -> tuple[list, list]:
    parents: list = []
    derived: list = []
    if text and ("parent_id" in text or "derived_from" in text or "\\u" in text):
        try:
            _walk(json.loads(text, parse_int=str, parse_float=str), parents, derived)
        except (ValueError, RecursionError):
            pass
    return parents, derived


def _links(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        found = [links_of(x) for x in s]
        yield pd.DataFrame({"parents": [p for p, _ in found], "derived": [d for _, d in found]})


def keys(episodes: DataFrame) -> DataFrame:
    """(record_id, key) of every record: its place, its parents, the places it derives from.

    A place is a resolved path with an episode index (or none); text that is no
    JSON, null and blank parents, and paths that lead nowhere give no key.
    """
    links = F.pandas_udf(_links, LINKS)
    named = F.when(F.col("extra_json").rlike(r"parent_id|derived_from|\\u"), F.col("extra_json"))
    rows = episodes.filter("record_id is not null").select("record_id", "path", "dataset_name", "episode_index", links(named).alias("links"))
    place = lambda path, ep: F.concat(F.lit("P|"), resolve_path(path, F.col("dataset_name")), F.lit("|"), F.coalesce(ep, F.lit("-")))

    def origin(d: Column) -> Column:
        index = F.regexp_extract(d, AT, 2)
        told = place(F.regexp_extract(d, AT, 1), index.cast("long").cast("string"))
        return F.when(index != "", told).otherwise(place(F.regexp_replace(d, "#[^#]*$", ""), F.lit(None).cast("string")))

    own = F.array(place(F.col("path"), F.col("episode_index").cast("string")))
    parents = F.transform("links.parents", lambda p: F.concat(F.lit("Q|"), p))
    none = F.array().cast("array<string>")
    found = F.concat(own, F.coalesce(parents, none), F.coalesce(F.transform("links.derived", origin), none))
    return rows.select("record_id", F.explode(F.array_distinct(found)).alias("key")).filter("key is not null")
