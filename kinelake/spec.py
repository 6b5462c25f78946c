"""Declared robot dumps, their packed vectors, and the registry of sources.

Everything here is metadata of the driver: small, immutable and checked when it
is made, so that plans built from it can be purely declarative.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Ids of embodiments; the first is the id of all others.
EMBODIMENT_IDS = {
    "new_embodiment": 31,
    "aloha": 7,
    "ur5": 8,
    "arx5": 9,
    "dos-w1": 10,
    "galaxea": 11,
    "egoverse": 12,
    "das_gripper": 13,
    "hy_lance": 14,
    "hifi_umi": 16,
    "oxe_droid": 17,
    "oxe_bridge": 18,
    "oxe_rt1": 19,
    "abc": 20,
    "gr1": 24,
    "franka": 25,
    "agibot_genie1": 26,
}
UNKNOWN_EMBODIMENT = 31
EMBODIMENTS = 32

# Accepted spellings of representation, kind, normalization and pose format.
REPS = {"abs": "abs", "absolute": "abs", "rel": "rel", "relative": "rel", "delta": "delta"}
KINDS = {"joint": "joint", "eef": "eef", "ee": "eef", "gripper": "gripper", "grip": "gripper"}
NORMS = {"quantile": "quantile", "q01": "quantile", "mean_std": "mean_std", "meanstd": "mean_std", "none": "none", "off": "none", "identity": "none"}
FORMATS = {
    "default": "default",
    "": "default",
    "xyz_rotvec": "xyz_rotvec",
    "xyz+rotvec": "xyz_rotvec",
    "rotvec": "xyz_rotvec",
    "xyz_quat": "xyz_quat",
    "xyz+quat": "xyz_quat",
    "quat": "xyz_quat",
    "xyz_rot6d": "xyz_rot6d",
    "xyz+rot6d": "xyz_rot6d",
    "rot6d": "xyz_rot6d",
}
POSE_WIDTHS = {"xyz_rotvec": 6, "xyz_quat": 7, "xyz_rot6d": 9}


def named(table: dict[str, str], text: Any, what: str) -> str:
    """The canonical name of an accepted spelling."""
    found = table.get(str(text).strip().lower())
    if found is None:
        raise ValueError(f"{what} {text!r} is none of {sorted(set(table.values()))}")
    return found


def embodiment_id(tag: str | None) -> int:
    return EMBODIMENT_IDS.get(tag or "", UNKNOWN_EMBODIMENT)


@dataclass(frozen=True)
class ActionSlice:
    """A span of the packed action with its span of the packed state.

    ``stored``: already incremental on disk, so never converted. An empty state
    span has no counterpart in the state.
    """

    name: str
    start: int
    end: int
    rep: str = "delta"
    kind: str = "joint"
    norm: str = "quantile"
    state: tuple[int, int] | None = None
    stored: bool = False
    format: str = ""

    def __post_init__(self) -> None:
        if not 0 <= self.start <= self.end:
            raise ValueError(f"{self.name}: span {self.start}:{self.end}")
        for key, table in (("rep", REPS), ("kind", KINDS), ("norm", NORMS)):
            object.__setattr__(self, key, named(table, getattr(self, key), key))
        by_width = {w: f for f, w in POSE_WIDTHS.items()}
        told = named(FORMATS, self.format, "format")
        if told == "default" and self.kind == "eef":
            told = by_width.get(self.width, "default")
        object.__setattr__(self, "format", told)

    @property
    def width(self) -> int:
        return self.end - self.start

    @property
    def state_span(self) -> tuple[int, int]:
        return self.state if self.state is not None else (self.start, self.end)

    @property
    def convertible(self) -> bool:
        return not self.stored and self.kind != "gripper" and self.rep != "abs"


Space = tuple[ActionSlice, ...]


def chain(*parts: tuple[str, int, dict]) -> Space:
    """Slices one after the other from (name, width, options)."""
    out, at = [], 0
    for name, width, options in parts:
        out.append(ActionSlice(name, at, at + width, **options))
        at += width
    return tuple(out)


GRIP = {"rep": "abs", "kind": "gripper"}


def one_arm(arm: int = 7, grip: int = 1, rep: str = "delta") -> Space:
    return chain(("arm", arm, {"rep": rep}), ("gripper", grip, GRIP))


def two_arms(arm: int = 6, grip: int = 1, rep: str = "delta") -> Space:
    return chain(*(p for side in ("left", "right") for p in ((f"{side}_arm", arm, {"rep": rep}), (f"{side}_gripper", grip, GRIP))))


def two_poses(pose: int = 7, grip: int = 1, rep: str = "delta", sides: tuple[str, ...] = ("left", "right"), format: str = "") -> Space:
    return chain(*(p for side in sides for p in ((f"{side}_eef", pose, {"rep": rep, "kind": "eef", "format": format}), (f"{side}_gripper", grip, GRIP))))


def stored_pose(pose: int = 6, grip: int = 1, state_grip: int = 7, format: str = "") -> Space:
    return (
        ActionSlice("eef", 0, pose, "delta", "eef", state=(0, pose), stored=True, format=format),
        ActionSlice("gripper", pose, pose + grip, "abs", "gripper", state=(state_grip, state_grip + grip)),
    )


def widths(space: Space, action_dim: int = 0, state_dim: int = 0) -> tuple[int, int]:
    """Packed widths of action and state that a space needs."""
    if not space:
        return action_dim, state_dim
    return max(s.end for s in space), max(s.state_span[1] for s in space)


def any_stored(space: Space) -> bool:
    return any(s.stored for s in space)


def any_in(space: Space, rep: str) -> bool:
    return any(s.rep == rep and not s.stored for s in space)


def reformat(space: Space, format: str) -> Space:
    """The space with its poses in another format; later spans move along."""
    to = named(FORMATS, format, "format")
    if to == "default":
        return space
    new = POSE_WIDTHS[to]
    change = [s for s in space if s.kind == "eef" and s.format != to and s.width != new]

    def moved(at: int, spans: Iterable[tuple[int, int]]) -> int:
        return at + sum(new - (b - a) for a, b in spans if b <= at)

    actions = [(s.start, s.end) for s in change]
    states = [s.state_span for s in change if s.state_span[1] > s.state_span[0]]
    out = []
    for s in space:
        a, b = s.state_span
        state = (moved(a, states), moved(b, states)) if b > a else (a, b)
        out.append(replace(s, start=moved(s.start, actions), end=moved(s.end, actions), state=state, format=to if s.kind == "eef" else s.format))
    return tuple(out)


@dataclass(frozen=True)
class DumpSpec:
    """What a dump holds: cameras, packed vectors, rate, embodiment and columns."""

    name: str
    cameras: tuple[str, ...]
    state_dim: int
    action_dim: int
    fps: float
    embodiment: str = "new_embodiment"
    embodiment_id: int = -1
    state_columns: tuple[str, ...] = ("observation.state",)
    action_columns: tuple[str, ...] = ("action",)
    language_column: str = "task"
    image_size: int = 224
    kind: str = "auto"
    revision: int = 1
    space: Space = ()

    def __post_init__(self) -> None:
        if self.embodiment_id < 0:
            object.__setattr__(self, "embodiment_id", embodiment_id(self.embodiment))
        if not self.name or self.embodiment_id >= EMBODIMENTS or self.fps <= 0:
            raise ValueError(f"{self.name!r}: name, fps and an embodiment id below {EMBODIMENTS} are needed")

    def resolved(self, mode: str, kind: str | None = None, format: str | None = None) -> Space:
        """The action space in a mode; grippers and stored slices keep theirs."""
        rep = named(REPS, mode, "action mode")
        if not self.space and self.action_dim <= 0:
            raise ValueError(f"{self.name}: neither action space nor action_dim")
        space = self.space or (ActionSlice("actions", 0, self.action_dim, rep),)
        space = tuple(s if s.stored or s.kind == "gripper" else replace(s, rep=rep) for s in space)
        if kind and named(KINDS, kind, "kind") == "eef":
            from kinelake.operators.geometry import to_poses

            told = named(FORMATS, format or "", "format")
            return to_poses(space, self.embodiment, "xyz_rotvec" if told == "default" else told)
        return reformat(space, format or "")

    def policy_io(self, chunk: int) -> dict[str, Any]:
        return {
            "camera_keys": self.cameras,
            "video_keys": tuple(f"video.{c}" for c in self.cameras),
            "action_dim": self.action_dim,
            "state_dim": self.state_dim,
            "chunk_length": chunk,
            "embodiment_id": self.embodiment_id,
        }


def merged_io(ios: list[dict[str, Any]]) -> dict[str, Any]:
    """Cameras in first-seen order and the largest dims of several sources."""
    if not ios:
        raise ValueError("no sources")
    cameras = tuple(dict.fromkeys(c for io in ios for c in io["camera_keys"]))
    out = {k: max(io[k] for io in ios) for k in ("action_dim", "state_dim", "chunk_length")}
    return {"camera_keys": cameras, "video_keys": tuple(f"video.{c}" for c in cameras), **out, "embodiment_id": ios[0]["embodiment_id"]}


WRISTS = ("cam_high", "cam_left_wrist", "cam_right_wrist")
HANDS = ("top_head", "hand_left", "hand_right")

# The known dumps.
SPECS = (
    DumpSpec("abc", WRISTS, 14, 14, 10.0, "abc", kind="mcap", space=two_arms()),
    DumpSpec(
        "agibot", HANDS, 20, 22, 30.0, "agibot_genie1", 26, kind="agibot", revision=2,
        space=chain(("left_arm", 7, {}), ("right_arm", 7, {}), ("left_gripper", 1, GRIP), ("right_gripper", 1, GRIP), ("head", 2, {}), ("waist", 2, {}), ("base", 2, {"rep": "abs", "state": (0, 0)})),
    ),
    DumpSpec("das_gripper", WRISTS, 16, 16, 30.0, "das_gripper", 13, kind="das", space=two_poses(format="xyz_quat")),
    DumpSpec("droid", ("exterior_1_left", "exterior_2_left", "wrist_left"), 8, 8, 15.0, "oxe_droid", kind="lerobot", space=one_arm()),
    DumpSpec("egoverse", WRISTS, 16, 16, 30.0, "egoverse", 12, kind="zarr", space=two_poses(format="xyz_quat")),
    DumpSpec(
        "galaxea", ("head_rgb", "left_wrist_rgb", "right_wrist_rgb"), 32, 14, 15.0, "galaxea", 11, kind="lerobot", revision=2,
        state_columns=tuple(f"observation.state.{c}" for c in ("left_ee_pose", "right_ee_pose", "left_gripper", "right_gripper", "left_arm", "right_arm", "torso")),
        action_columns=tuple(f"action.{c}" for c in ("left_arm", "right_arm", "left_gripper", "right_gripper")),
        space=chain(("left_arm", 6, {"state": (16, 22)}), ("right_arm", 6, {"state": (23, 29)}), ("left_gripper", 1, GRIP | {"state": (14, 15)}), ("right_gripper", 1, GRIP | {"state": (15, 16)})),
    ),
    DumpSpec("hifi_umi", ("head_main", "left_hand_up", "right_hand_up"), 20, 20, 25.0, "hifi_umi", 16, kind="lerobot_v3", space=two_poses(9, sides=("right", "left"), format="xyz_rot6d")),
    DumpSpec("hy_lance", WRISTS, 16, 16, 30.0, "hy_lance", 14, kind="lance", space=two_poses(format="xyz_quat")),
    DumpSpec("kai0", HANDS, 14, 14, 30.0, "aloha", 7, kind="lerobot", space=two_arms()),
    DumpSpec("libero", ("image", "wrist_image"), 8, 7, 10.0, "franka", kind="lerobot", state_columns=("state",), action_columns=("actions",), space=stored_pose(format="xyz_rotvec")),
    DumpSpec("rmbench", WRISTS, 14, 14, 10.0, "aloha", kind="lerobot", space=two_arms()),
    DumpSpec("robotwin", WRISTS, 14, 14, 30.0, "aloha", kind="lerobot", space=two_arms()),
)

# Names that stand for all dumps.
ALL_ALIASES = ("all", "all_custom", "all_data", "custom_all")


@dataclass
class Source:
    """A registered reader: ``episodes(spark, root)`` and ``frames(spark, root)`` DataFrames of a spec."""

    spec: DumpSpec
    episodes: Callable[[SparkSession, str], DataFrame] | None = None
    frames: Callable[[SparkSession, str], DataFrame] | None = None
    subtasks: Callable[[SparkSession, str], DataFrame] | None = None
    decode: Callable[..., Any] | None = None


@dataclass
class Registry:
    """Sources by name, and mixes of (folder, weight, name) rows."""

    sources: dict[str, Source] = field(default_factory=dict)
    recipes: dict[str, tuple[tuple[str, float, str], ...]] = field(default_factory=dict)

    def add(self, source: Source) -> Source:
        name = source.spec.name
        if name in self.sources or name in self.recipes or name in ALL_ALIASES:
            raise ValueError(f"{name!r} is registered already")
        for part in ("episodes", "frames", "subtasks", "decode"):
            if getattr(source, part) is not None and not callable(getattr(source, part)):
                raise TypeError(f"{name}: {part} is no function")
        self.sources[name] = source
        return source

    def mix(self, alias: str, rows: Iterable[tuple[str, float, str]]) -> None:
        rows = tuple(rows)
        if alias in self.sources or alias in self.recipes or alias in ALL_ALIASES:
            raise ValueError(f"{alias!r} is registered already")
        for folder, weight, name in rows:
            if name not in self.sources or not folder or not 0 < weight < float("inf"):
                raise ValueError(f"{alias}: {(folder, weight, name)}")
        self.recipes[alias] = rows

    def names(self) -> tuple[str, ...]:
        return tuple(sorted(self.sources))

    def get(self, name: str) -> Source:
        if name not in self.sources:
            raise KeyError(f"{name!r} is none of {', '.join(self.names())}")
        return self.sources[name]

    def rows(self, name: str) -> tuple[tuple[str, float, str], ...]:
        """(folder, weight, source) of a mix, an alias of all, or one source."""
        if name in ALL_ALIASES:
            return tuple((n, 1.0, n) for n in self.names())
        return self.recipes.get(name) or ((self.get(name).spec.name, 1.0, name),)

    def select(self, text: str = "", default: tuple[str, ...] | None = None) -> tuple[str, ...]:
        """Names of a comma list; the default or all for an empty one; unknown names raise."""
        picked = tuple(dict.fromkeys(t.strip() for t in text.split(",") if t.strip()))
        unknown = [n for n in picked if n not in self.sources]
        if unknown:
            raise ValueError(f"unknown dumps: {', '.join(unknown)}")
        return picked or (default if default is not None else self.names())

    def knows(self, name: str) -> bool:
        return name in self.sources or name in self.recipes or name in ALL_ALIASES

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(s.spec.name, list(s.spec.cameras), s.spec.state_dim, s.spec.action_dim, s.spec.fps, s.spec.embodiment, s.spec.embodiment_id, s.spec.kind, s.spec.revision) for _, s in sorted(self.sources.items())]
        return spark.createDataFrame(rows, "name string, cameras array<string>, state_dim int, action_dim int, fps double, embodiment string, embodiment_id int, kind string, revision int")


REGISTRY = Registry()
for _spec in SPECS:
    REGISTRY.add(Source(_spec))


def datasets_root() -> str:
    return os.environ.get("KINELAKE_DATASETS", "datasets")


def dataset_path(name: str, root: str | None = None) -> str:
    """A path as given, else a folder of the datasets' root."""
    if "/" in name or os.path.isdir(name):
        return name
    return os.path.join(root or datasets_root(), name)
