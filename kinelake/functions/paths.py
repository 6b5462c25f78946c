"""Where a path leads: one spelling for every file, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "/lake/datasets"


def dataset_key(name: Column) -> Column:
    """The last part of a dataset name given as name or folder; blank is null."""
    tail = F.regexp_extract(F.regexp_replace(F.trim(name), r"[\\/]+$", ""), r"([^\\/]*)$", 1)
    return F.nullif(F.trim(tail), F.lit(""))


def _dots(parts: Column) -> Column:
    """Drop empty parts and ``.``, and let ``..`` take back the part before it."""
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(p))),
    )


def resolve_path(path: Column, dataset: Column | None = None, root: str = ROOT) -> Column:
    """The absolute path that ``path`` leads to.

    Space around the text is dropped; a ``file:`` URI loses scheme and host and
    is percent-decoded (a plain path is not); backslashes are separators and a
    drive letter is dropped; a relative path starts at ``root``/``dataset``;
    ``.``, ``..`` and repeated slashes are resolved. Null for null and blank
    paths and for relative ones without a dataset.
    """
    text = F.trim(F.regexp_replace(path, r"^[\s ]+|[\s ]+$", ""))
    is_uri = F.lower(F.substring(text, 1, 5)) == "file:"
    rest = F.substring(text, 6, 2**30)
    body = F.when(rest.startswith("//"), F.regexp_replace(rest, r"^//[^/\\]*", "")).otherwise(rest)
    # url_decode would turn + into a space
    decoded = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    plain = F.when(is_uri, F.coalesce(decoded, body)).otherwise(text)
    slashed = F.regexp_replace(F.replace(plain, F.lit("\\"), F.lit("/")), r"^/?[A-Za-z]:/", "/")
    base = F.lit(None).cast("string") if dataset is None else F.concat(F.lit(root + "/"), dataset_key(dataset), F.lit("/"))
    absolute = F.when(slashed == "", None).when(slashed.startswith("/"), slashed).otherwise(F.concat(base, slashed))
    # most paths have no "..": two passes of a regular expression do for them
    short = F.regexp_replace(F.regexp_replace(absolute, "/(\\.?/)+", "/"), "(?<=.)/\\.?$", "")
    whole = F.concat(F.lit("/"), F.array_join(_dots(F.split(short, "/")), "/"))
    return F.when(short.rlike("/\\.\\.?(/|$)"), whole).otherwise(short)


def camera_key(video_key: Column) -> Column:
    """A camera's name without ``observation.images.``, ``image.`` or ``images.``; blank is null."""
    return F.nullif(F.regexp_replace(F.trim(video_key), r"^(observation\.images\.|images?\.)", ""), F.lit(""))
