"""Arrays on the wire: JSON with base64, in both directions, and a request pipeline."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators.flow import with_prefix
from kinelake.operators.geometry import eef_chunks
from kinelake.operators.space import from_train, scaled, to_train
from kinelake.operators.stats import EPS


def array_to_json(a: np.ndarray) -> dict:
    """``dtype``, ``shape`` and base64 ``data`` of an array; the keys are the wire's format."""
    whole = np.asarray(a, order="C")
    return {"dtype": whole.dtype.str, "shape": [*whole.shape], "data": base64.b64encode(memoryview(whole).cast("B") if whole.size else b"").decode("ascii")}


def array_from_json(told: dict) -> np.ndarray:
    """The array of such a mapping; without ``dtype`` float32, without ``shape`` flat."""
    flat = np.frombuffer(base64.b64decode(told["data"]), told.get("dtype", "float32"))
    return flat.reshape(told.get("shape", flat.shape))


def encode(value):
    """A nested value with its arrays encoded."""
    if isinstance(value, np.ndarray):
        return {"__array__": array_to_json(value)}
    if isinstance(value, dict):
        return {k: encode(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [encode(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def decode(value):
    if isinstance(value, dict):
        return array_from_json(value["__array__"]) if set(value) == {"__array__"} else {k: decode(v) for k, v in value.items()}
    return [decode(v) for v in value] if isinstance(value, list) else value


def _pack(v: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else json.dumps(array_to_json(np.asarray(x, np.float32))) for x in v])


def _unpack(v: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else array_from_json(json.loads(x)).ravel().tolist() for x in v])


def to_wire(column):
    return F.pandas_udf(_pack, "string")(column)


def from_wire(column):
    return F.pandas_udf(_unpack, "array<double>")(column)


def answered(requests: DataFrame, model: Callable[[np.ndarray], np.ndarray], state: str, lo: list[float], hi: list[float], mask: list[bool] | None = None) -> DataFrame:
    """``action``: the model's answer to each normalized state, brought back to its scale.

    The model is a function on batches (n, D) and a slot: any library may be
    behind it. Dimensions that ``mask`` leaves out are neither scaled nor
    brought back.
    """
    low, high = np.array(lo, float), np.array(hi, float)
    on = np.ones(len(low), bool) if mask is None else np.array(mask, bool)
    span = high - low + 1e-6

    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        raw = np.array(v.tolist(), float)
        y = model(np.where(on, (raw - low) / span * 2 - 1, raw))
        return pd.Series(list(np.where(on, (y + 1) / 2 * span + low, y)))

    return requests.withColumn("action", F.pandas_udf(run, "array<double>")(state))


def answered_chunks(requests: DataFrame, model: Callable[..., np.ndarray], state: str, space, norm: dict[str, tuple[list[float], list[float]]], horizon: int, prefix: str | None = None, steps: str | None = None) -> DataFrame:
    """``action``: a chunk of absolute actions per request (state array), by the model's answer in the training space.

    The model takes normalized states (n, D) and, with ``prefix``, the
    normalized prefix chunks and how many of their steps hold, and answers
    (n, ``horizon``, dims) on the training scale. ``norm``: (lo, hi) of "state" and
    "action"; what the space does not scale stays. The chunk is brought back to
    its scale, its relative and delta slices to absolute ones from the request's
    state, and its first steps are the prefix itself.
    """
    dim = max(s.end for s in space)
    (slo, shi), (alo, ahi) = (tuple(np.array(x, float) for x in norm[k]) for k in ("state", "action"))
    son, aon = (np.array(m, bool) for m in (scaled(space, len(slo), "state"), scaled(space, dim)))

    def run(v: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        raw = np.array(v.tolist(), float)
        x = np.where(son, (raw - slo) / (shi - slo + EPS) * 2 - 1, raw)
        more = ()
        if prefix is not None:
            held = np.zeros((len(v), horizon, dim))
            for i, chunk in enumerate(p):
                for k, a in enumerate(chunk if chunk is not None else ()):
                    if k < horizon:
                        held[i, k] = np.array(list(a), float)
            more = (np.where(aon, (held - alo) / (ahi - alo + EPS) * 2 - 1, held), n.fillna(0).to_numpy(int))
        y = np.asarray(model(x, *more), float)
        return pd.Series([a.tolist() for a in np.where(aon, (y + 1) / 2 * (ahi - alo + EPS) + alo, y)])

    none = F.lit(None)
    # a prefix is told in the training space, as the model sees it
    told = to_train(F.col(prefix), F.col(state), space, dim) if prefix is not None else none.cast("array<array<double>>")
    requests = eef_chunks(requests.withColumn("_told", told), "_told", state, space)
    count = F.col(steps).cast("int") if steps is not None else none.cast("int")
    raw = F.pandas_udf(run, "array<array<double>>")(state, F.col("_told"), count)
    out = requests.withColumn("_y", raw).withColumn("action", from_train(F.col("_y"), F.col(state), space, dim)).drop("_y", "_told")
    out = eef_chunks(out, "action", state, space, invert=True)
    return out.withColumn("action", with_prefix(F.col("action"), F.col(prefix), count)) if prefix is not None else out
