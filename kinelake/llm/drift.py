"""Schemas that drift between files: what changed, and one table of all rows.

Each file is held against the file before it of the same source. Both schemas
are graphs: a field points to its type, shape, namespace, element names and
values. Similarity flooding starts from what the names of two fields, two types,
two namespaces, two bodies of values say for themselves and lets pairs of fields
and pairs of what they point to pass similarity to each other up to the
fixpoint, which alone decides: consistent correspondences are taken from it,
best first, as far as they reach a share of a field's similarity with itself.

Defined results: a file repeated under its id counts once; ties of time go by
id; a file without time comes first; unreadable info declares the fields that
its rows have; unreadable rows have no values; null values tell nothing about
types; cameras, order and element names are no changes; empty tables give no
rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.session import cut, discard, written

CAMERA_TYPES = ("video", "image")
NEST = 0.7  # weight of namespaces
EMPTY = (None, (), "")  # attributes that tell nothing
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def fields_of(info: str | None, rows: str | None) -> tuple[dict[str, dict], list[dict]]:
    """Declared fields without cameras, and the raw rows."""
    try:
        raw = json.loads(rows) if rows else []
    except ValueError:
        raw = []
    raw = [r for r in raw if isinstance(r, dict)] if isinstance(raw, list) else []
    try:
        told = (json.loads(info) or {}).get("features") if info else None
    except (ValueError, AttributeError):
        told = None
    if isinstance(told, list):
        told = {str(f["key"]): f for f in told if isinstance(f, dict) and f.get("key") is not None}
    if not isinstance(told, dict):
        told = {k: {} for r in raw for k in r}
    told = {k: f if isinstance(f, dict) else {} for k, f in told.items()}
    return {k: f for k, f in told.items() if f.get("dtype") not in CAMERA_TYPES}, raw


def json_kind(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, list):
        kinds = {json_kind(x) for x in value} - {None}
        return f"list of {'/'.join(sorted(kinds))}" if kinds else None
    return "object"


def _numbers(value) -> list[float] | None:
    """What a value says as numbers, however it is written; None if it says something else."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return [float(value)]
    if isinstance(value, str):
        text = value.strip().strip("[]")
        try:
            return [float(x) for x in re.split(r"[,;\s]+", text) if x]
        except ValueError:
            return None
    if isinstance(value, list):
        out = []
        for x in value:
            n = _numbers(x)
            out.append(n[0] if n else np.nan)
        return out
    return None


class Field:
    """A field with what its name, declaration and values say."""

    def __init__(self, key: str, told: dict, rows: list[dict]):
        self.key = key
        self.dtype = told.get("dtype")
        shape = told.get("shape")
        self.shape = tuple(shape) if isinstance(shape, list) else shape
        names = told.get("names")
        self.names = tuple(map(str, names)) if isinstance(names, list) else None
        values = [r.get(key) for r in rows]
        self.kinds = {json_kind(v) for v in values} - {None}
        self.words = words = [w.lower() for w in WORDS.findall(key)]
        self.space = tuple(re.split(r"[./]", key)[:-1])
        known = [v for v in values if v is not None]
        self.truth = bool(known) and all(isinstance(v, bool) or (isinstance(v, str) and v.strip().lower() in ("true", "false")) for v in known)
        numbers = [n for n in map(_numbers, known) if n] if not self.truth else []
        self.vector = None
        if numbers and len(numbers) == len(known):
            width = min(map(len, numbers))
            with np.errstate(all="ignore"):
                self.vector = np.array([x[:width] for x in numbers], float)
        texts = [v for v in known if isinstance(v, str)] if self.vector is None and not self.truth else []
        self.stems = {re.sub(r"[\W\d_]+", "", t).lower() for t in texts} - {""}

    @property
    def family(self) -> str:
        d = str(self.dtype or "").lower()
        return "text" if d.startswith(("str", "utf", "text")) else "bool" if d.startswith("bool") else "int" if d.startswith(("int", "uint")) else "float" if d.startswith(("float", "double")) else d


def name_likeness(a: Field, b: Field) -> float:
    x, y = "".join(a.words), "".join(b.words)
    if x == y:
        return 1.0
    if x and y and (x.startswith(y) or y.startswith(x) or x.endswith(y) or y.endswith(x)):
        return 0.9
    p, q = set(a.words), set(b.words)
    shared = p & q
    jaccard = len(shared) / max(1, len(p | q))
    last = a.words[-1:] == b.words[-1:]
    return max(jaccard, 0.6 if last else 0.0)


def value_likeness(a: Field, b: Field) -> tuple[float, float]:
    """(likeness, weight of the edge) of the values of two fields; weight 0 where they tell nothing."""
    if a.vector is not None and b.vector is not None:
        u, v = np.nanmean(a.vector, 0) if a.vector.size else a.vector, np.nanmean(b.vector, 0) if b.vector.size else b.vector
        n = min(len(u), len(v))
        if abs(len(u) - len(v)) > 1:  # a quantity gains or loses a part, it does not turn into another length
            return 0.0, 2.0
        d = np.abs(u[:n] - v[:n])
        d = d[np.isfinite(d)]
        if not len(d):
            return 0.0, 0.0
        scale = 0.05 if a.family != "int" and b.family != "int" else 0.5
        score = float(np.mean(np.exp(-((d / scale) ** 2) / 2)))
        whole = np.all(u[:n] == np.round(u[:n])) and np.all(v[:n] == np.round(v[:n]))
        return score, (4.0 if n >= 2 else 1.0 if whole else 2.0)
    if a.truth and b.truth:
        return 0.5, 0.2
    if a.stems and b.stems:
        return float(bool(a.stems & b.stems)), 2.0
    known = lambda f: f.vector is not None or f.truth or bool(f.stems)
    return (0.0, 3.0) if known(a) and known(b) else (0.0, 0.0)


class Arc:
    """One label of the pairwise connectivity graph: field pairs point to pairs of attribute nodes.

    ``like`` is what the attribute nodes say for themselves, ``weight`` the
    share of the label in what a field pair takes in, ``give`` the share of what
    attribute nodes take from field pairs in what they hold.
    """

    def __init__(self, left: list, right: list, like, weight, give: float = 0.25):
        self.give = give
        xs, ys = list(dict.fromkeys(left)), list(dict.fromkeys(right))
        self.rows, self.cols = np.array([xs.index(x) for x in left]), np.array([ys.index(y) for y in right])
        self.like = np.array([[like(x, y) for y in ys] for x in xs])
        told = np.array([[x not in EMPTY and y not in EMPTY for y in right] for x in left], float)
        self.weight = told * weight
        self.a, self.b = (self.rows[None, :] == np.arange(len(xs))[:, None]).astype(float), (self.cols[None, :] == np.arange(len(ys))[:, None]).astype(float)
        self.size = self.a.sum(1)[:, None] + self.b.sum(1)[None, :]
        self.single = len(xs) == len(left) and len(ys) == len(right)

    def flow(self, score: np.ndarray) -> np.ndarray:
        """What each field pair takes in: the similarity of the nodes it points to, once these took theirs from all field pairs that point to them.

        A node pair takes the mean, over the fields of both nodes, of the best
        that each finds among the other's: as in a comparison of two sets.
        """
        give = self.give
        if self.single:
            return ((1 - give) * self.like + give * score[np.argsort(self.rows)][:, np.argsort(self.cols)])[self.rows][:, self.cols]
        from_left = np.stack([np.where(c > 0, score, 0).max(1) for c in self.b], 1)  # left fields x right nodes
        from_right = np.stack([np.where(r[:, None] > 0, score, 0).max(0) for r in self.a], 0)  # left nodes x right fields
        taken = (self.a @ from_left + from_right @ self.b.T) / self.size
        node = (1 - give) * self.like + give * taken
        return node[self.rows][:, self.cols]


def connectivity(left: list[Field], right: list[Field], open_: np.ndarray) -> list[Arc]:
    """The labels along which similarity flows between two schema graphs: types, shapes, namespaces, element names, values.

    What namespaces are called tells little: they are alike as far as their fields are.
    """

    def types(x: str, y: str) -> float:
        return 1.0 if x == y else 0.5 if {x, y} <= {"int", "float"} else 0.0

    def parts(x: tuple, y: tuple) -> float:
        return len(set(x) & set(y)) / max(len(set(x)), len(set(y)), 1)

    both = [[value_likeness(f, g) if open_[i, j] else (0.0, 0.0) for j, g in enumerate(right)] for i, f in enumerate(left)]
    value = np.array(both, float).reshape(len(left), len(right), 2)
    return [
        Arc([f.family for f in left], [f.family for f in right], types, 1.0),
        Arc([f.shape for f in left], [f.shape for f in right], lambda x, y: 1.0 if x == y else 0.3, 0.7),
        Arc([f.names or () for f in left], [f.names or () for f in right], parts, 1.5),
        Arc([f.space for f in left], [f.space for f in right], lambda x, y: float(x == y), NEST, 0.9),
        Arc(list(range(len(left))), list(range(len(right))), lambda i, j: value[i, j, 0], value[..., 1]),
    ]


def flood(own: np.ndarray, arcs: list[Arc], open_: np.ndarray, keep: float = 0.25) -> np.ndarray:
    """Similarities of all field pairs at the fixpoint.

    A pair keeps ``keep`` of what names say and takes the rest from the nodes it
    points to; node pairs take their ``give`` from the field pairs that point to
    them. Pairs that are not ``open_`` (equal keys, and what they exclude) stay.
    Both steps are averages and maxima, so a round brings any two states nearer
    by a factor of (1 - keep) * give at least: there is one fixpoint, and rounds
    go on until nothing moves.
    """
    total = sum(arc.weight for arc in arcs)
    score = own
    while True:
        taken = sum(arc.weight * arc.flow(score) for arc in arcs) / np.maximum(total, 1e-12)
        new = np.where(open_, np.where(total > 0, keep * own + (1 - keep) * taken, own), own)
        if np.abs(new - score).max() < 1e-6:
            return new
        score = new


def correspond(left: list[Field], right: list[Field], least: float = 0.57) -> list[tuple[Field, Field]]:
    """Fields of ``left`` that go on under another key in ``right``.

    Equal keys hold; of the other pairs those are taken, best first, so that no
    two fields prefer each other to what they got, whose flooded similarity
    reaches ``least`` of that of a field with itself, which the fixpoint makes 1.
    """
    kept = {f.key for f in left} & {f.key for f in right}
    rows, cols = [i for i, f in enumerate(left) if f.key not in kept], [j for j, f in enumerate(right) if f.key not in kept]
    if not rows or not cols:
        return []
    own, open_ = np.array([[float(a.key == b.key) for b in right] for a in left]), np.zeros((len(left), len(right)), bool)
    for i in rows:
        for j in cols:
            own[i, j], open_[i, j] = name_likeness(left[i], right[j]), True
    score = flood(own, connectivity(left, right, open_), open_)
    order = sorted((-score[i, j], left[i].key, right[j].key, i, j) for i in rows for j in cols if score[i, j] >= least)
    used_i, used_j, pairs = set(), set(), []
    for *_, i, j in order:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            pairs.append((left[i], right[j]))
    return pairs


def _retyped(a: Field, b: Field) -> bool:
    if a.dtype is not None and b.dtype is not None and a.dtype != b.dtype:
        return True
    if a.shape is not None and b.shape is not None and a.shape != b.shape:
        return True
    return bool(a.kinds and b.kinds and a.kinds != b.kinds)


def compare(before: tuple[str | None, str | None], after: tuple[str | None, str | None]) -> list[tuple[str, str, str | None]]:
    """(column_name, change_kind, old key of a renamed one) of each change between two files."""
    (told_a, rows_a), (told_b, rows_b) = fields_of(*before), fields_of(*after)
    left, right = [Field(k, f, rows_a) for k, f in told_a.items()], [Field(k, f, rows_b) for k, f in told_b.items()]
    renamed = correspond(left, right)
    old, new = {a.key for a, _ in renamed}, {b.key for _, b in renamed}
    by = {f.key: f for f in right}
    changes: list[tuple[str, str, str | None]] = [(b.key, "renamed", a.key) for a, b in renamed]
    changes += [(f.key, "removed", None) for f in left if f.key not in by and f.key not in old]
    have = {f.key for f in left}
    changes += [(f.key, "added", None) for f in right if f.key not in have and f.key not in new]
    same = [(f, by[f.key]) for f in left if f.key in by]
    changes += [(b.key, "retyped", None) for a, b in [*same, *renamed] if _retyped(a, b)]
    return changes


def with_previous(files: DataFrame) -> DataFrame:
    """Each file with info and rows of the one before it of its source.

    Files are ordered within days; a day's first file takes the last file of the
    source's day before, from a table of one row per source and day.
    """
    once = files.filter("file_id is not null").select("file_id", "repo_index", "written_at", "info", "rows_json").dropDuplicates(["file_id"])
    at = F.coalesce(F.col("written_at").cast("timestamp_ntz"), F.lit("1900-01-01").cast("timestamp_ntz"))
    day = once.withColumn("at", at).withColumn("day", F.to_date("at"))
    last = day.groupBy("repo_index", "day").agg(F.max(F.struct("at", "file_id", "info", "rows_json")).alias("last"))
    carried = last.withColumn("carry", F.lag("last").over(W.partitionBy("repo_index").orderBy("day"))).select(F.col("repo_index").alias("_r"), F.col("day").alias("_d"), "carry")
    inner = W.partitionBy("repo_index", "day").orderBy("at", "file_id")
    own = day.withColumn("prev", F.lag(F.struct("at", "file_id", "info", "rows_json")).over(inner))
    joined = own.join(carried, F.col("repo_index").eqNullSafe(F.col("_r")) & (F.col("day") == F.col("_d")), "left")
    return joined.withColumn("prev", F.coalesce("prev", "carry")).select("file_id", "repo_index", "at", "info", "rows_json", "prev")


CHANGES = "file_id long, repo_index long, at timestamp_ntz, column_name string, change_kind string, old_name string"


def changes(files: DataFrame) -> DataFrame:
    """(file_id, repo_index, at, column_name, change_kind, old_name) of each change against the previous file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                out += [(r.file_id, r.repo_index, r.at, *c) for c in compare((r.info_a, r.rows_a), (r.info, r.rows_json))]
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"at": "datetime64[us]"})

    pairs = with_previous(files).filter("prev is not null")
    pairs = pairs.select("file_id", "repo_index", "at", "info", "rows_json", F.col("prev.info").alias("info_a"), F.col("prev.rows_json").alias("rows_a"))
    return pairs.repartition("file_id").mapInPandas(run, CHANGES)


def field_names(files: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_index, file_id, key, column): the first key that each field of a file had in its source.

    A field's life under one key begins where it is added, renamed or first
    seen; a renamed one points to the life of its old key, and roots are found
    by pointer jumping, in rounds that grow with the logarithm of the chain.
    """
    keyed = F.pandas_udf(_keys, "array<string>")
    seen = files.filter("file_id is not null").dropDuplicates(["file_id"]).withColumn("at", F.coalesce(F.col("written_at").cast("timestamp_ntz"), F.lit("1900-01-01").cast("timestamp_ntz")))
    seen = seen.select("repo_index", "file_id", "at", F.explode(keyed("info", "rows_json")).alias("key"))
    began = found.filter("change_kind in ('added', 'renamed')").select("repo_index", "file_id", F.col("column_name").alias("key"), "old_name", F.lit(True).alias("begins"))
    order = W.partitionBy("repo_index", "key").orderBy("at", "file_id")
    lives = seen.join(began, ["repo_index", "file_id", "key"], "left").withColumn("life", F.last(F.when(F.col("begins"), F.struct("at", "file_id")), True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    zero = F.struct(F.lit("1800-01-01").cast("timestamp_ntz").alias("at"), F.lit(-1).cast("long").alias("file_id"))
    lives = cut(lives.withColumn("life", F.coalesce("life", zero)))
    # the old key's life: the one that ran when the new one began
    start = lives.filter("begins and old_name is not null").select("repo_index", "key", "life", F.col("old_name").alias("okey"))
    ends = lives.groupBy("repo_index", F.col("key").alias("okey"), F.col("life").alias("olife")).agg(F.max(F.struct("at", "file_id")).alias("until"))
    parent = start.join(ends, ["repo_index", "okey"]).filter("until < life").groupBy("repo_index", "key", "life").agg(F.max(F.struct("until", "okey", "olife")).alias("p"))
    held = written(parent.select("repo_index", "key", "life", F.col("p.okey").alias("okey"), F.col("p.olife").alias("olife")))
    jump = held
    while True:
        up = jump.select("repo_index", F.col("key").alias("okey"), F.col("life").alias("olife"), F.col("okey").alias("k2"), F.col("olife").alias("l2"))
        step = written(jump.join(up, ["repo_index", "okey", "olife"], "left"))
        discard(held)
        held = step
        jump = step.select("repo_index", "key", "life", F.coalesce("k2", "okey").alias("okey"), F.coalesce("l2", "olife").alias("olife"))
        if step.filter("k2 is not null").isEmpty():
            break
    return lives.join(jump, ["repo_index", "key", "life"], "left").select("repo_index", "file_id", "key", F.coalesce("okey", "key").alias("column"))


def _keys(info: pd.Series, rows: pd.Series) -> pd.Series:
    return pd.Series([list(fields_of(a, b)[0]) for a, b in zip(info, rows)])


VALUE = "struct<numbers:array<double>,text:string>"


def _whole(value) -> list[float | None] | None:
    """All numbers of a value in order, those of nested lists too; None if any of it is something else."""
    if isinstance(value, list):
        out: list[float | None] = []
        for x in value:
            n = [None] if x is None else _whole(x)
            if n is None:
                return None
            out += n
        return out
    if isinstance(value, str) and not value.strip():
        return None
    return _numbers(value)


def _values(rows: pd.Series) -> pd.Series:
    """Values of all raw rows; each row begins with an entry without key, so that one without values is there too."""
    out = []
    for text in rows:
        try:
            raw = json.loads(text) if text else []
        except ValueError:
            raw = []
        for_file = []
        for i, r in enumerate(raw if isinstance(raw, list) else []):
            if isinstance(r, dict):
                for_file.append({"row": i, "key": None, "numbers": None, "text": None})
                for k, v in r.items():
                    if v is not None:
                        for_file.append({"row": i, "key": k, "numbers": _whole(v), "text": v if isinstance(v, str) else json.dumps(v)})
        out.append(for_file)
    return pd.Series(out)


def _long(files: DataFrame) -> DataFrame:
    """(repo_index, file_id, row, key, column, numbers, text) of all values under the first key of their field."""
    found = cut(changes(files))
    names = field_names(files, found).select("file_id", "key", "column")
    values = F.pandas_udf(_values, "array<struct<row:int,key:string,numbers:array<double>,text:string>>")
    once = files.filter("file_id is not null").dropDuplicates(["file_id"])
    long = once.select("repo_index", "file_id", F.explode(values("rows_json")).alias("v")).select("repo_index", "file_id", "v.*")
    return cut(long.join(names, ["file_id", "key"], "left").withColumn("column", F.coalesce("column", "key")))


def table_of(files: DataFrame) -> DataFrame:
    """All raw rows, a row per value: (repo_index, file_id, row, column, numbers, text).

    ``column`` is the first key that the field had in its source; a key that
    its file does not declare is its own column. A column whose values are all
    numbers has them as a list however they were written (nested lists one
    after another), any other column has all its values as text; null values
    are left out.
    """
    long = _long(files).filter("key is not null")
    # one type per column: text as soon as one of its values is no number
    mixed = long.filter("numbers is null").select(F.col("repo_index").alias("_r"), F.col("column").alias("_c"), F.lit(True).alias("as_text")).distinct()
    typed = long.join(mixed, F.col("repo_index").eqNullSafe(F.col("_r")) & (F.col("column") == F.col("_c")), "left")
    return typed.select("repo_index", "file_id", "row", "column", F.when(F.col("as_text").isNull(), F.col("numbers")).alias("numbers"), F.when(F.col("as_text"), F.col("text")).alias("text"))


def rows_of(files: DataFrame) -> DataFrame:
    """One table of all raw rows with typed columns: (repo_index, file_id, row, then a column per field).

    Fields of all sources are united by the first key they had, letter case
    aside; of two fields of one row that meet so, the second in order of keys
    goes to ``<name>#2`` and so on. A column is double if all its values are
    single numbers, array<double> if they are numbers or lists of them, boolean
    if they are true or false, else string. A row without values is a row of nulls. Only the column names and
    types come to the driver, as the schema of any table does.
    """
    long = _long(files)
    same = W.partitionBy("file_id", "row", F.lower("column")).orderBy("column", "key")
    long = long.withColumn("_n", F.row_number().over(same)).withColumn("name", F.lower("column"))
    long = long.withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("name")))
    kinds = long.filter("key is not null").groupBy("name").agg(F.bool_and(F.col("numbers").isNotNull()).alias("plain"), F.max(F.size("numbers")).alias("most"), F.min(F.size("numbers")).alias("least"), F.bool_and(F.lower(F.trim("text")).isin("true", "false")).alias("truth")).orderBy("name").collect()
    row = long.groupBy("repo_index", "file_id", "row").agg(F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("name", F.struct("numbers", "text").alias("v"))))).alias("m"))

    def column(k) -> object:
        v = F.try_element_at("m", F.lit(k.name))
        if not k.plain:
            return F.trim(v["text"]).cast("boolean") if k.truth else v["text"]
        return v["numbers"][0] if k.most == k.least == 1 else v["numbers"]

    taken = {"repo_index", "file_id", "row"}
    return row.select("repo_index", "file_id", "row", *[column(k).alias(f"{k.name}#value" if k.name in taken else k.name) for k in kinds])
