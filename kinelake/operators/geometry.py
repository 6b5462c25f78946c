"""Poses and arms: rotations, rigid transforms, forward kinematics.

Plain numpy over stacks of vectors, in float64, and Arrow-batched UDFs over
array columns; what closed forms can say (quaternion and rot6d matrices,
inverse transforms) is also given as JVM expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.spec import POSE_WIDTHS, Space


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 2, 1], out[..., 0, 2], out[..., 1, 0] = v[..., 0], v[..., 1], v[..., 2]
    return out - np.swapaxes(out, -1, -2)


def rotvec_matrix(v: np.ndarray) -> np.ndarray:
    """Rodrigues, with series where the angle is small."""
    v = np.asarray(v, float)
    t2 = (v * v).sum(-1)[..., None, None]
    t = np.sqrt(t2)
    small = t < 1e-6
    safe = np.where(small, 1.0, t)
    a = np.where(small, 1 - t2 / 6, np.sin(safe) / safe)
    b = np.where(small, 0.5 - t2 / 24, (1 - np.cos(safe)) / safe**2)
    k = skew(v)
    return np.eye(3) + a * k + b * (k @ k)


def matrix_quat(r: np.ndarray) -> np.ndarray:
    """Quaternion x, y, z, w with w >= 0: the eigenvector of the largest of four candidates."""
    r = np.asarray(r, float)
    m = lambda i, j: r[..., i, j]
    trace = m(0, 0) + m(1, 1) + m(2, 2)
    # four rows, each exact up to scale; the longest is the stable one
    rows = np.stack(
        [
            np.stack([1 + 2 * m(0, 0) - trace, m(0, 1) + m(1, 0), m(0, 2) + m(2, 0), m(2, 1) - m(1, 2)], -1),
            np.stack([m(0, 1) + m(1, 0), 1 + 2 * m(1, 1) - trace, m(1, 2) + m(2, 1), m(0, 2) - m(2, 0)], -1),
            np.stack([m(0, 2) + m(2, 0), m(1, 2) + m(2, 1), 1 + 2 * m(2, 2) - trace, m(1, 0) - m(0, 1)], -1),
            np.stack([m(2, 1) - m(1, 2), m(0, 2) - m(2, 0), m(1, 0) - m(0, 1), 1 + trace], -1),
        ],
        -2,
    )
    size = np.linalg.norm(rows, axis=-1)
    q = np.take_along_axis(rows, size.argmax(-1)[..., None, None], -2)[..., 0, :]
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    return np.where(q[..., 3:] < 0, -q, q)


def quat_matrix(q: np.ndarray) -> np.ndarray:
    q = np.asarray(q, float)
    n = np.linalg.norm(q, axis=-1, keepdims=True)
    q = np.where(n < 1e-12, np.array([0.0, 0, 0, 1]), q / np.maximum(n, 1e-12))
    v, w = q[..., :3], q[..., 3, None, None]
    k = skew(v)
    return np.eye(3) + 2 * (w * k + k @ k)


def matrix_rotvec(r: np.ndarray) -> np.ndarray:
    """By the quaternion: stable for all angles up to pi."""
    q = matrix_quat(r)
    s = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    angle = 2 * np.arctan2(s, q[..., 3:])
    return q[..., :3] * np.where(s < 1e-9, 2.0, angle / np.maximum(s, 1e-12))


def rot6d_matrix(d: np.ndarray) -> np.ndarray:
    """Gram-Schmidt of the first two rows."""
    d = np.asarray(d, float)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    a = unit(d[..., :3])
    b = unit(d[..., 3:6] - (a * d[..., 3:6]).sum(-1, keepdims=True) * a)
    return np.stack([a, b, np.cross(a, b)], -2)


def matrix_rot6d(r: np.ndarray) -> np.ndarray:
    return np.concatenate([r[..., 0, :], r[..., 1, :]], -1)


ROTATION = {"xyz_rotvec": (rotvec_matrix, matrix_rotvec), "xyz_quat": (quat_matrix, matrix_quat), "xyz_rot6d": (rot6d_matrix, matrix_rot6d)}


def transform(xyz: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros((*r.shape[:-2], 4, 4))
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = r, xyz, 1
    return out


def inverse(t: np.ndarray) -> np.ndarray:
    rt = np.swapaxes(t[..., :3, :3], -1, -2)
    return transform(-(rt @ t[..., :3, 3:])[..., 0], rt)


def pose_matrix(pose: np.ndarray, fmt: str) -> np.ndarray:
    pose = np.asarray(pose, float)
    if pose.shape[-1] != POSE_WIDTHS[fmt]:
        raise ValueError(f"a pose {fmt} has {POSE_WIDTHS[fmt]} dims, not {pose.shape[-1]}")
    return transform(pose[..., :3], ROTATION[fmt][0](pose[..., 3:]))


def matrix_pose(t: np.ndarray, fmt: str) -> np.ndarray:
    return np.concatenate([t[..., :3, 3], ROTATION[fmt][1](t[..., :3, :3])], -1)


def convert_pose(pose: np.ndarray, src: str, dst: str) -> np.ndarray:
    return np.asarray(pose, float) if src == dst else matrix_pose(pose_matrix(pose, src), dst)


def relative_pose(pose: np.ndarray, ref: np.ndarray, fmt: str) -> np.ndarray:
    """``inv(T_ref) @ T``."""
    return matrix_pose(inverse(pose_matrix(ref, fmt)) @ pose_matrix(pose, fmt), fmt)


def absolute_pose(delta: np.ndarray, ref: np.ndarray, fmt: str) -> np.ndarray:
    """``T_ref @ T_delta``."""
    return matrix_pose(pose_matrix(ref, fmt) @ pose_matrix(delta, fmt), fmt)


# arms


@dataclass(frozen=True)
class ScrewArm:
    """Product of exponentials: space-frame screws (angular, linear) and the home pose."""

    screws: tuple[tuple[float, ...], ...]
    home: tuple[tuple[float, ...], ...]

    def fk(self, q: np.ndarray) -> np.ndarray:
        t = np.broadcast_to(np.eye(4), (*q.shape[:-1], 4, 4))
        for i, s in enumerate(np.array(self.screws)):
            w, v, a = s[:3], s[3:], q[..., i, None, None]
            k = skew(w)
            g = np.eye(3) * a + (1 - np.cos(a)) * k + (a - np.sin(a)) * (k @ k)
            t = t @ transform((g @ v[:, None])[..., 0], rotvec_matrix(q[..., i, None] * w))
        return t @ np.array(self.home)


@dataclass(frozen=True)
class DhArm:
    """Links (a, d, alpha), classic or modified, and a flange along z."""

    links: tuple[tuple[float, float, float], ...]
    flange: float = 0.0
    modified: bool = True

    def fk(self, q: np.ndarray) -> np.ndarray:
        t = np.broadcast_to(np.eye(4), (*q.shape[:-1], 4, 4))
        along = lambda x, z: transform(np.array([x, 0.0, z]), np.eye(3))
        for i, (a, d, alpha) in enumerate(self.links):
            turn_z = transform(np.zeros(3), rotvec_matrix(q[..., i, None] * np.array([0.0, 0, 1])))
            turn_x = transform(np.zeros(3), rotvec_matrix(np.array([alpha, 0.0, 0])))
            t = t @ turn_x @ along(a, 0) @ turn_z @ along(0, d) if self.modified else t @ turn_z @ along(0, d) @ along(a, 0) @ turn_x
        return t @ along(0, self.flange)


@dataclass(frozen=True)
class SerialArm:
    """Joints (xyz, rpy, axis), each a fixed frame and a turn, and the tool frame."""

    joints: tuple[tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]], ...]
    tool: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0))

    @staticmethod
    def _frame(xyz, rpy) -> np.ndarray:
        x, y, z = (rotvec_matrix(a * np.eye(3)[i]) for i, a in enumerate(rpy))
        return transform(np.array(xyz), z @ y @ x)

    def fk(self, q: np.ndarray) -> np.ndarray:
        t = np.broadcast_to(np.eye(4), (*q.shape[:-1], 4, 4))
        for i, (xyz, rpy, axis) in enumerate(self.joints):
            t = t @ self._frame(xyz, rpy) @ transform(np.zeros(3), rotvec_matrix(q[..., i, None] * np.array(axis)))
        return t @ self._frame(*self.tool)


PI2 = np.pi / 2

# The arms' kinematic constants (metres, radians).
VX300S = ScrewArm(
    screws=(
        (0.0, 0.0, 1.0, 0.0, 0.0, 0.0),
        (0.0, 1.0, 0.0, -0.12705, 0.0, 0.0),
        (0.0, 1.0, 0.0, -0.42705, 0.0, 0.05955),
        (1.0, 0.0, 0.0, 0.0, 0.42705, 0.0),
        (0.0, 1.0, 0.0, -0.42705, 0.0, 0.35955),
        (1.0, 0.0, 0.0, 0.0, 0.42705, 0.0),
    ),
    home=((1.0, 0.0, 0.0, 0.536494), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.42705), (0.0, 0.0, 0.0, 1.0)),
)
YAM = ScrewArm(
    screws=(
        (0.0, 0.0, 1.0, 0.0, 0.0, 0.0),
        (0.0, 1.0, 0.0, -0.1135, 0.0, 0.02),
        (0.0, -1.0, 0.0, 0.1135, 0.0, 0.244),
        (0.0, -1.0, 0.0, 0.173501, 0.0, -0.000998),
        (0.0, 0.0, -1.0, 0.0, 0.074998, 0.0),
        (1.0, 0.0, 0.0, 0.0, 0.173501, 0.0),
    ),
    home=((0.0, 0.0, -1.0, 0.110597), (0.0, -1.0, 0.0, 0.0), (-1.0, 0.0, 0.0, 0.173502), (0.0, 0.0, 0.0, 1.0)),
)
FRANKA = DhArm(
    links=(
        (0.0, 0.333, 0.0),
        (0.0, 0.0, -PI2),
        (0.0, 0.316, PI2),
        (0.0825, 0.0, PI2),
        (-0.0825, 0.384, -PI2),
        (0.0, 0.0, PI2),
        (0.088, 0.0, PI2),
    ),
    flange=0.107,
)
A1 = SerialArm(
    joints=(
        ((-0.0011147, 0.0, 0.0446), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),
        ((0.0, 0.0, 0.1061), (PI2, 0.0, 0.0), (0.0, 0.0, -1.0)),
        ((-0.34928, 0.019998, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, -1.0)),
        ((0.02735, 0.069767, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)),
        ((0.2463, -0.00049894, 0.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)),
        ((0.058249, 0.00050025, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)),
    ),
    tool=((0.1039, 0.0, 0.0), (-PI2, 0.0, 0.0)),
)
GENIE_LEFT = SerialArm(
    joints=(
        ((0.0, 0.0, 0.1859), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),
        ((0.0, 0.0, 0.0), (-PI2, 0.0, PI2), (0.0, 0.0, 1.0)),
        ((0.0, -0.305, 0.0), (-PI2, PI2, np.pi), (0.0, 0.0, 1.0)),
        ((0.0, 0.0, 0.0), (-PI2, 0.0, np.pi), (0.0, 0.0, 1.0)),
        ((0.0, -0.1975, 0.0), (-PI2, 0.0, -np.pi), (0.0, 0.0, 1.0)),
        ((0.0, 0.0, 0.0), (-PI2, 0.0, 0.0), (0.0, 0.0, 1.0)),
        ((0.0, -0.1805, 0.0), (PI2, 0.0, 0.0), (0.0, 0.0, 1.0)),
    )
)
# the right arm is recorded with its second joint the other way round
GENIE_RIGHT = SerialArm(joints=(GENIE_LEFT.joints[0], (*GENIE_LEFT.joints[1][:2], (0.0, 0.0, -1.0)), *GENIE_LEFT.joints[2:]))

Arm = ScrewArm | DhArm | SerialArm
# The arms by embodiment and number of joints.
ARMS: dict[tuple[str, int], dict[str, Arm]] = {
    ("aloha", 6): {"": VX300S},
    ("abc", 6): {"": YAM},
    ("yam", 6): {"": YAM},
    ("galaxea", 6): {"": A1},
    ("oxe_droid", 7): {"": FRANKA},
    ("franka", 7): {"": FRANKA},
    ("agibot_genie1", 7): {"left": GENIE_LEFT, "right": GENIE_RIGHT},
    ("agibot", 7): {"left": GENIE_LEFT, "right": GENIE_RIGHT},
}


def arm_of(embodiment: str, joints: int, side: str = "") -> Arm:
    sides = ARMS.get((embodiment, joints))
    if sides is None:
        raise ValueError(f"no arm of {embodiment!r} with {joints} joints; known: {sorted(f'{e}/{n}' for e, n in ARMS)}")
    return sides.get(side.lower() or "left") or sides.get("") or sides["left"]


def joints_pose(q: np.ndarray, embodiment: str, side: str = "", fmt: str = "xyz_rotvec") -> np.ndarray:
    q = np.asarray(q, float)
    return matrix_pose(arm_of(embodiment, q.shape[-1], side).fk(q), fmt)


def _side(name: str) -> str:
    return next((s for s in ("left", "right") if name.lower().startswith(s)), "")


def to_poses(space: Space, embodiment: str, fmt: str) -> Space:
    """The space with each arm's joints relabelled as a pose; later spans move along."""
    width = POSE_WIDTHS[fmt]
    arms = [s for s in space if s.kind == "joint" and (embodiment, s.width) in ARMS]
    if not arms:
        raise ValueError(f"no joints of {embodiment!r} have a known arm")

    def moved(at: int, spans: list[tuple[int, int]]) -> int:
        return at + sum(width - (b - a) for a, b in spans if b <= at)

    actions, states = [(s.start, s.end) for s in arms], [s.state_span for s in arms]
    out = []
    for s in space:
        a, b = s.state_span
        state = (moved(a, states), moved(b, states)) if b > a else (a, b)
        out.append(replace(s, start=moved(s.start, actions), end=moved(s.end, actions), state=state, kind="eef" if s in arms else s.kind, format=fmt if s in arms else s.format))
    return tuple(out)


def apply_arms(vec: np.ndarray, space: Space, embodiment: str, fmt: str, field: str = "action") -> np.ndarray:
    """Packed vectors with the joints of each known arm replaced by its pose."""
    out, at = [], 0
    spans = sorted(((s.start, s.end) if field == "action" else s.state_span, s) for s in space if s.kind == "joint" and (embodiment, s.width) in ARMS)
    for (a, b), s in spans:
        out += [vec[..., at:a], joints_pose(vec[..., a:b], embodiment, _side(s.name), fmt)]
        at = b
    return np.concatenate([*out, vec[..., at:]], -1)


# columns


def _stack(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), float)


def _nulls(fn, *series: pd.Series) -> pd.Series:
    """``fn`` of stacked vectors where none is null."""
    ok = np.logical_and.reduce([s.notna() for s in series])
    got = iter(fn(*[_stack(s[ok]) for s in series]) if ok.any() else ())
    return pd.Series([next(got) if x else None for x in ok], dtype=object)


def pose_udf(kind: str, src: str, dst: str = ""):
    """UDFs over array<double>: ``convert`` (pose), ``relative`` and ``absolute`` (pose, reference)."""
    if kind == "convert":

        def one(v: pd.Series) -> pd.Series:
            return _nulls(lambda x: convert_pose(x, src, dst), v)

        return F.pandas_udf(one, "array<double>")
    step = {"relative": relative_pose, "absolute": absolute_pose}[kind]

    def two(v: pd.Series, ref: pd.Series) -> pd.Series:
        return _nulls(lambda x, y: step(x, y, src), v, ref)

    return F.pandas_udf(two, "array<double>")


def fk_udf(embodiment: str, side: str = "", fmt: str = "xyz_rotvec"):
    def run(q: pd.Series) -> pd.Series:
        return _nulls(lambda x: joints_pose(x, embodiment, side, fmt), q)

    return F.pandas_udf(run, "array<double>")


def eef_chunk_udf(fmt: str, mode: str, invert: bool = False):
    """UDF (chunk, state pose) over array<array<double>>: poses relative to the state or to the step before, or back."""

    def run(chunk: pd.Series, state: pd.Series) -> pd.Series:
        ok = np.flatnonzero(chunk.notna() & state.notna())
        sizes = np.array([len(chunk.iloc[i]) for i in ok], np.int64)
        out: list = [None] * len(chunk)
        if not sizes.sum():
            for i in ok:
                out[i] = []
            return pd.Series(out, dtype=object)
        # all steps of all chunks in one stack; only what is added up goes step by step, over all chunks at once
        steps, own = np.array([a for i in ok for a in chunk.iloc[i]], float), np.array([state.iloc[i] for i in ok], float)
        begin = np.cumsum(sizes) - sizes
        if mode == "delta" and invert:
            got, ref = np.empty_like(steps), own
            for t in range(int(sizes.max())):
                on = np.flatnonzero(sizes > t)
                ref[on] = got[begin[on] + t] = absolute_pose(steps[begin[on] + t], ref[on], fmt)
        else:
            ref = np.repeat(own, sizes, axis=0)
            if mode == "delta":
                inner = np.setdiff1d(np.arange(len(steps)), begin)
                ref[inner] = steps[inner - 1]
            got = (absolute_pose if invert else relative_pose)(steps, ref, fmt)
        for i, a, n in zip(ok, begin, sizes):
            out[i] = got[a : a + n].tolist()
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<array<double>>")


def eef_chunks(rows: DataFrame, chunk: str, state: str, space, invert: bool = False) -> DataFrame:
    """Chunks (array<array<double>>) with the poses of a space's convertible end effectors relative to the state or the step before, or back."""
    for s in space:
        a, b = s.state_span
        if not s.convertible or s.kind != "eef" or s.format not in ROTATION or b - a != s.width:
            continue
        poses = F.transform(chunk, _between(s.start, s.end))
        part = eef_chunk_udf(s.format, s.rep, invert)(poses, F.slice(F.col(state).cast("array<double>"), a + 1, s.width))
        rows = rows.withColumn("_poses", part).withColumn(chunk, F.zip_with(chunk, "_poses", _spliced(s.start, s.end))).drop("_poses")
    return rows


def _between(start: int, end: int):
    return lambda v: F.slice(v, start + 1, end - start)


def _spliced(start: int, end: int):
    return lambda v, p: F.concat(F.slice(v, F.lit(1), F.lit(start)), p, F.slice(v, F.lit(end + 1), F.greatest(F.size(v) - end, F.lit(0))))


def quat_matrix_columns(q: Column) -> Column:
    """Nine cells, row by row, of an (x, y, z, w) column, in the JVM."""
    n = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x))
    x, y, z, w = (F.get(q, F.lit(i)) / n for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def rot6d_matrix_columns(d: Column) -> Column:
    """Nine cells, row by row, of a rot6d column, in the JVM."""
    u = [F.get(d, F.lit(i)) for i in range(6)]
    n = F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
    a = [x / n for x in u[:3]]
    dot = a[0] * u[3] + a[1] * u[4] + a[2] * u[5]
    r = [u[3 + i] - dot * a[i] for i in range(3)]
    m = F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2])
    b = [x / m for x in r]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return F.array(*a, *b, *c)


def inverse_columns(r: Column, t: Column) -> Column:
    """Twelve cells, row by row, of the inverse of a rigid transform (nine of r, three of t)."""
    cell, move = lambda i, j: F.get(r, F.lit(3 * i + j)), lambda i: F.get(t, F.lit(i))
    rows = []
    for i in range(3):
        rows += [cell(j, i) for j in range(3)]
        rows.append(-(cell(0, i) * move(0) + cell(1, i) * move(1) + cell(2, i) * move(2)))
    return F.array(*rows)
