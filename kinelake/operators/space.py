"""Packed vectors as JVM array expressions: packing, masks, relative and delta actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinelake.spec import Space


def zeros(n: int, kind: str = "float") -> Column:
    return F.array_repeat(F.lit(0).cast(kind), n)


def fit_dim(a: Column, dim: int, kind: str = "float") -> Column:
    """The vector cut or filled with zeros to ``dim``; null stays null."""
    return F.slice(F.concat(a, zeros(dim, kind)), 1, dim)


def pack(columns: list[Column], scalars: set[int], dim: int, kind: str = "float") -> Column:
    """One vector of several columns, in order.

    One column is cut or filled to ``dim``; several must make up exactly ``dim``,
    else it raises. ``scalars``: numbers of the columns that are no lists.
    """
    parts = [(F.array(c) if i in scalars else c).cast(f"array<{kind}>") for i, c in enumerate(columns)]
    if len(parts) == 1:
        return fit_dim(parts[0], dim, kind)
    whole = F.concat(*parts)
    wrong = F.raise_error(F.concat(F.lit("columns make up "), F.size(whole).cast("string"), F.lit(f" dims, not {dim}")))
    return F.when(F.size(whole) == dim, whole).when(whole.isNull(), None).otherwise(wrong.cast(f"array<{kind}>"))


def part(a: Column, start: int, end: int) -> Column:
    return F.slice(a, start + 1, max(0, end - start))


def splice(a: Column, pieces: list[tuple[int, int, Column]], dim: int) -> Column:
    """``a`` with the spans of ``pieces`` replaced; pieces may be of another width and must not overlap."""
    out, at = [], 0
    for start, end, piece in sorted(pieces, key=lambda p: p[0]):
        if start < at:
            raise ValueError("spans overlap")
        out += [part(a, at, start), piece]
        at = end
    return F.concat(*out, part(a, at, dim))


def scaled(space: Space, dim: int, field: str = "action") -> list[bool]:
    """Which dims are normalized: not those of slices without norm, nor the rotation of rot6d and quat poses."""
    mask = [True] * dim
    for s in space:
        start, end = (s.start, s.end) if field == "action" else s.state_span
        if end <= start:
            continue
        for i in range(start, min(end, dim)):
            if s.norm == "none" or (s.kind == "eef" and s.format in ("xyz_quat", "xyz_rot6d") and i - start >= 3):
                mask[i] = False
    return mask


def reference(state: Column, space: Space, dim: int, kind: str = "double") -> Column:
    """The state laid out like the action: what each convertible slice is held against, zero elsewhere."""
    cells = [F.lit(0).cast(kind)] * dim
    for s in space:
        if s.convertible:
            a, b = s.state_span
            for i in range(s.width):
                if a + i < b:
                    cells[s.start + i] = F.coalesce(F.get(state, F.lit(a + i)).cast(kind), F.lit(0).cast(kind))
    return F.array(*cells)


def _kinds(space: Space, dim: int) -> Column:
    """0: as it is, 1: relative, 2: delta; per dim."""
    cells = [0] * dim
    for s in space:
        if s.convertible and s.kind != "eef":
            for i in range(s.start, min(s.end, dim)):
                cells[i] = {"rel": 1, "delta": 2}[s.rep]
    return F.array(*[F.lit(c) for c in cells])


def to_train(chunk: Column, state: Column, space: Space, dim: int) -> Column:
    """A chunk of absolute actions relative to the state (rel) or to the step before (delta; the first to the state).

    Joint slices only; poses go through ``geometry``.
    """
    ref, kinds = reference(state, space, dim), _kinds(space, dim)

    def step(a: Column, k: Column) -> Column:
        before = F.when(k > 0, F.element_at(chunk, F.greatest(k, F.lit(1)))).otherwise(ref)
        return F.transform(
            F.arrays_zip(a.alias("a"), before.alias("b"), ref.alias("r"), kinds.alias("m")),
            lambda x: F.when(x["m"] == 1, x["a"] - x["r"]).when(x["m"] == 2, x["a"] - x["b"]).otherwise(x["a"]),
        )

    return F.transform(chunk, lambda a, k: step(a, k))


def from_train(chunk: Column, state: Column, space: Space, dim: int) -> Column:
    """The inverse of :func:`to_train`: running sums for delta, one sum for rel."""
    ref, kinds = reference(state, space, dim), _kinds(space, dim)

    def fold(acc: Column, a: Column) -> Column:
        nxt = F.transform(
            F.arrays_zip(a.alias("a"), acc["last"].alias("b"), ref.alias("r"), kinds.alias("m")),
            lambda x: F.when(x["m"] == 1, x["a"] + x["r"]).when(x["m"] == 2, x["a"] + x["b"]).otherwise(x["a"]),
        )
        return F.struct(nxt.alias("last"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    start = F.struct(ref.alias("last"), F.array().cast("array<array<double>>").alias("out"))
    return F.aggregate(chunk.cast("array<array<double>>"), start, fold, lambda acc: acc["out"])


def last_step(a: Column) -> Column:
    """The current vector of a (time, dim) history."""
    return F.try_element_at(a, F.lit(-1))


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) from the keys, the same in every engine: the first 13 hex digits of their MD5."""
    text = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def masked_state(state: Column, p: float, *keys: Column | str) -> Column:
    """The state, or zeros with probability ``p`` by the keys."""
    return F.when(uniform(*keys) < F.lit(p), F.transform(state, lambda x: x * 0)).otherwise(state)
