"""Dumps that are no LeRobot repos. Libraries that are not installed are stood in for by readers of NumPy archives."""

import json
import struct
import textwrap

import numpy as np
import pytest
import zstandard

from kinelake import api
from kinelake.sources import adapters, mcap
from kinelake.spec import REGISTRY

FAKES = {
    "h5py": """
        import numpy as np
        class File:
            def __init__(self, path, mode="r"): self.a = np.load(path, allow_pickle=False)
            def __enter__(self): return self
            def __exit__(self, *x): return False
            def __contains__(self, k): return k.replace("/", "|") in self.a.files
            def __getitem__(self, k): return self.a[k.replace("/", "|")]
    """,
    "zarr": """
        import numpy as np, os
        def open(path, mode="r"):
            return {f[:-4]: np.load(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".npy")}
    """,
    "lance": """
        import pyarrow.parquet as pq
        def dataset(path):
            class D:
                def take(self, rows, columns): return pq.read_table(path + "/data.parquet", columns=columns).take(rows)
            return D()
    """,
}


@pytest.fixture(scope="module")
def libraries(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fakes")
    for name, code in FAKES.items():
        (folder / f"{name}.py").write_text(textwrap.dedent(code))
        spark.sparkContext.addPyFile(str(folder / f"{name}.py"))


def h5(path, arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        np.savez(f, **{k.replace("/", "|"): v for k, v in arrays.items()})


def test_agibot(spark, libraries, tmp_path):
    t = 5
    base = tmp_path / "beta"
    full = {k: np.full((t, w), i, np.float32) for i, (k, w) in enumerate([*adapters.AGIBOT_STATE, *adapters.AGIBOT_ACTION])}
    h5(base / "proprio_stats" / "327" / "1" / "proprio_stats.h5", full)
    h5(base / "proprio_stats" / "327" / "2" / "x.h5", {adapters.AGIBOT_JOINTS: np.ones((3, 14), np.float32)})
    h5(base / "proprio_stats" / "327" / "3" / "x.h5", {"other": np.ones(3)})
    h5(base / "proprio_stats" / ".cache" / "8" / "x.h5", full)
    (base / "task_info").mkdir()
    (base / "task_info" / "task_327.json").write_text(json.dumps([{"episode_id": 1, "english": " pick ", "task": "no"}, {"episode_id": 2, "english": "", "task_name": "place"}]))
    got = {r.episode_id: r for r in REGISTRY.get("agibot").episodes(spark, str(tmp_path)).collect()}
    assert {k: (r.n_frames, r.lang) for k, r in got.items()} == {"1": (5, "pick"), "2": (3, "place")}
    assert got["1"].parent_id == "agibot:327:1" and got["1"].video_dir.endswith("/beta/observations/327/1/videos")
    rows = api.dataset(spark, "agibot", str(tmp_path)).frames if False else REGISTRY.get("agibot").frames(spark, str(tmp_path))
    one = rows.filter("n = 5 and frame = 2").first()
    assert one.state == [0] * 14 + [1] * 2 + [2] * 2 + [3] * 2 and one.action == [4] * 14 + [5] * 2 + [6] * 2 + [7] * 2 + [8] * 2
    short = rows.filter("n = 3").first()
    assert short.state == [1] * 14 + [0] * 6 and short.action == [0] * 22
    (base / "task_info" / "task_327.json").write_text(json.dumps([{"english": "whose"}]))
    with pytest.raises(Exception, match="episode_id"):
        REGISTRY.get("agibot").episodes(spark, str(tmp_path)).collect()


def test_das(spark, libraries, tmp_path):
    def episode(folder, left=True):
        h5(folder / "episode.hdf5", {"observations/left_eef_pose": np.ones((4, 7)), "observations/right_eef_pose": np.full((4, 7), 2.0), "observations/mag_left": np.full(4, 0.1), "observations/mag_right": np.arange(4.0)})
        if left:
            (folder / "cam_left_wrist.mp4").write_bytes(b"x")

    episode(tmp_path / "fold_it" / "001" / "01")
    episode(tmp_path / "fold_it" / "001" / "02", left=False)
    episode(tmp_path / "fold_it" / "001" / "03")
    (tmp_path / "fold_it" / "001" / "01" / "cam_right_wrist.mp4").write_bytes(b"x")
    (tmp_path / "fold_it" / adapters.DAS_META).write_text(json.dumps({"episodes": ["001/01/episode.hdf5", "001\\02\\episode.hdf5", "../x/episode.hdf5", "001/09/episode.hdf5"]}))
    got = adapters.das_episodes(spark, str(tmp_path)).collect()
    assert [(r.n_frames, r.lang, set(r.videos)) for r in got] == [(4, "fold it", {"cam_left_wrist", "cam_right_wrist"})]
    rows = adapters.das_frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert np.allclose(rows[3].state, [1] * 7 + [0.1] + [2] * 7 + [3]) and rows[3].action is None and len(rows) == 4
    (tmp_path / "fold_it" / adapters.DAS_META).unlink()
    assert adapters.das_episodes(spark, str(tmp_path)).count() == 2
    whole = api.dataset(spark, "das_gripper", str(tmp_path)).complete() if (tmp_path / "das_gripper").exists() else api.Dataset(REGISTRY.get("das_gripper").spec, adapters.das_frames(spark, str(tmp_path))).complete()
    last = whole.frames.filter("frame = 3").first()
    assert np.allclose(last.action, last.state)


def test_egoverse(spark, libraries, tmp_path):
    for name, head in (("a", {"attributes": {"total_frames": 3, "task_name": "pour"}}), ("b", {}), ("c", None)):
        store = tmp_path / "aria" / f"{name}.zarr"
        store.mkdir(parents=True)
        if head is not None:
            (store / "zarr.json").write_text(json.dumps(head))
        if name != "c":
            np.save(store / "left.obs_ee_pose.npy", np.zeros((3 if name == "a" else 5, 7), np.float32))
            np.save(store / "right.obs_ee_pose.npy", np.ones((3 if name == "a" else 5, 7), np.float32))
        else:
            np.save(store / "other.npy", np.zeros(3))
    got = {r.path[-6:]: (r.n_frames, r.lang) for r in adapters.ego_episodes(spark, str(tmp_path)).collect()}
    assert got == {"a.zarr": (3, "pour"), "b.zarr": (5, "")}
    rows = adapters.ego_frames(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and all(r.state == [0] * 7 + [0.5] + [1] * 7 + [0.5] for r in rows)


def test_hy_lance(spark, libraries, tmp_path):
    import pandas as pd

    def table(name, n, width=2):
        folder = tmp_path / name / f"{name}.lance"
        folder.mkdir(parents=True)
        pd.DataFrame({"observation_state": [np.full(16, i, np.float32) for i in range(n)], "action": [np.full(width, 0.25 * (i + 1), np.float32) for i in range(n)]}).to_parquet(folder / "data.parquet")
        (tmp_path / name / "meta").mkdir()

    table("table_000", 6)
    (tmp_path / "table_000" / "meta" / "hy_episodes.jsonl").write_text(json.dumps({"episodes": [[0, 0, 2], [1, 2, 4, 1]]}) + "\n")
    pd.DataFrame({"task_index": [0, 1], "task_en": ["wipe", "stack"]}).to_parquet(tmp_path / "table_000" / "meta" / "tasks.parquet")
    table("table_001", 4, 16)
    (tmp_path / "table_001" / "meta" / "episodes" / "chunk-000").mkdir(parents=True)
    pd.DataFrame([{"episode_index": 0, "dataset_from_index": 1, "dataset_to_index": 4}, {"episode_index": 1, "dataset_from_index": 4, "dataset_to_index": 4}]).to_parquet(tmp_path / "table_001" / "meta" / "episodes" / "chunk-000" / "file-000.parquet")
    got = {(r.path[-15:-6], r.episode_index): (r.start, r.n_frames, r.lang) for r in adapters.hy_episodes(spark, str(tmp_path)).collect()}
    assert got == {("table_000", 0): (0, 2, "wipe"), ("table_000", 1): (2, 4, "stack"), ("table_001", 0): (1, 3, "")}
    rows = {(r.repo[-15:-6], r.episode_index, r.frame): r for r in adapters.hy_frames(spark, str(tmp_path)).collect()}
    assert len(rows) == 9
    first = rows["table_000", 1, 0]
    assert first.state == [2] * 16 and np.allclose(first.action, [3] * 7 + [0.75] + [3] * 7 + [0.75])
    assert np.allclose(rows["table_000", 0, 1].action, [1] * 7 + [0.5] + [1] * 7 + [0.5])  # the last state repeats, within its episode
    assert np.allclose(rows["table_001", 0, 0].action, [0.5] * 16)


# recordings


def record(kind, raw):
    return struct.pack("<BQ", kind, len(raw)) + raw


def text(s):
    s = s if isinstance(s, bytes) else s.encode()
    return struct.pack("<I", len(s)) + s


def field(number, wire, raw):
    return bytes([number << 3 | wire]) + (bytes([len(raw)]) if wire == 2 else b"") + raw


def schema(name, fields):
    made = b"".join(field(2, 2, field(1, 2, n.encode()) + field(3, 0, bytes([i])) + field(5, 0, bytes([kind]))) for n, i, kind in fields)
    return field(1, 2, field(2, 2, b"pkg") + field(4, 2, field(1, 2, name.encode()) + made))


def write(path, messages, per_chunk=8, compression="zstd"):
    """A recording of (topic, time, position or packet) messages in the order given."""
    schemas = {1: ("pkg.Joints", schema("Joints", [("name", 1, 9), ("position", 2, 1)])), 2: ("pkg.Video", schema("Video", [("data", 1, 12), ("format", 2, 9)]))}
    topics = {t: i for i, t in enumerate(dict.fromkeys(m[0] for m in messages), 1)}
    body, chunks = bytearray(mcap.MAGIC), []
    for a in range(0, len(messages), per_chunk):
        part = messages[a : a + per_chunk]
        inner, index = bytearray(), {}
        for topic, at, value in part:
            index.setdefault(topics[topic], []).append((at, len(inner)))
            raw = field(1, 2, value) + field(2, 2, b"H264") if isinstance(value, bytes) else field(1, 2, b"j") + field(2, 2, struct.pack(f"<{len(value)}d", *value))
            inner += record(mcap.MESSAGE, struct.pack("<HIQQ", topics[topic], 0, at, at) + raw)
        packed = zstandard.ZstdCompressor().compress(bytes(inner)) if compression else bytes(inner)
        begin, times = len(body), [m[1] for m in part]
        body += record(mcap.CHUNK, struct.pack("<QQQI", min(times), max(times), len(inner), 0) + text(compression) + struct.pack("<Q", len(packed)) + packed)
        size, places, at = len(body) - begin, {}, len(body)
        for n, rows in index.items():
            places[n] = len(body)
            body += record(mcap.MESSAGE_INDEX, struct.pack("<HI", n, 16 * len(rows)) + b"".join(struct.pack("<QQ", *r) for r in rows))
        listed = b"".join(struct.pack("<HQ", *x) for x in places.items())
        chunks.append(struct.pack("<QQQQ", min(times), max(times), begin, size) + struct.pack("<I", len(listed)) + listed + struct.pack("<Q", len(body) - at) + text(compression) + struct.pack("<QQ", len(packed), len(inner)))
    summary = len(body)
    for n, (name, raw) in schemas.items():
        body += record(mcap.SCHEMA, struct.pack("<H", n) + text(name) + text("protobuf") + text(raw))
    for topic, n in topics.items():
        body += record(mcap.CHANNEL, struct.pack("<HH", n, 2 if "camera" in topic else 1) + text(topic) + text("protobuf") + struct.pack("<I", 0))
    for c in chunks:
        body += record(mcap.CHUNK_INDEX, c)
    body += record(mcap.FOOTER, struct.pack("<QQI", summary, 0, 0)) + mcap.MAGIC
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(bytes(body))


SCALARS = [*adapters.ABC_STATE, *adapters.ABC_ACTION]


def scalars(t0, t1, step):
    return [(topic, at, [float(i + at / 1e9)] * w) for at in range(t0, t1 + 1, step) for i, (topic, w) in enumerate(SCALARS)]


@pytest.mark.parametrize("compression", ["zstd", ""])
def test_spans_come_from_message_indexes(tmp_path, compression):
    path = tmp_path / "e.mcap"
    camera = [("/top-left-camera", t, b"p") for t in (0, 9_000_000_000)]
    write(path, [camera[0], *scalars(2_000_000_000, 3_000_000_000, 500_000_000), camera[1]], compression=compression)
    names = [t for t, _ in SCALARS]
    assert mcap.overlap(str(path), names) == (2_000_000_000, 3_000_000_000)
    raw = bytearray(path.read_bytes())
    for c in mcap.Recording(str(path)).chunks:  # payloads are not looked at
        raw[c["at"] + 60 : c["at"] + c["size"]] = bytes(c["size"] - 60)
    path.write_bytes(bytes(raw))
    assert mcap.overlap(str(path), names) == (2_000_000_000, 3_000_000_000)
    with pytest.raises(ValueError):
        mcap.overlap(str(path), ["/none"])
    with pytest.raises(ValueError):
        mcap.Recording(str(tmp_path / "no.mcap")) if (tmp_path / "no.mcap").write_bytes(b"no") else None


def test_abc(spark, tmp_path):
    root = tmp_path / "data" / "train"
    packets = [("/top-right-camera", t, bytes([t // 100_000_000])) for t in range(1_950_000_000, 3_200_000_000, 50_000_000)]
    write(root / "pick_up_the_cup" / "e0" / "episode.mcap", sorted([*scalars(2_000_000_000, 3_000_000_000, 70_000_000), *packets], key=lambda m: m[1]))
    write(root / "fold_the_towel" / "e1" / "episode.mcap", scalars(0, 50_000_000, 50_000_000))
    write(tmp_path / "meta" / "x" / "y" / "episode.mcap", scalars(0, 10**10, 10**9))
    (tmp_path / "data" / ".cache").mkdir()
    episodes = adapters.abc_episodes(spark, str(tmp_path))
    assert [(r.n_frames, r.lang) for r in episodes.collect()] == [(10, "pick up the cup")]  # the last scalar is at 2.98 s
    rows = adapters.abc_frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert len(rows) == 10 and all(len(r.state) == 14 == len(r.action) for r in rows)
    for r in rows:
        at = 2.0 + (r.frame * 0.1 // 0.07 * 0.07 if r.frame else 0)
        assert np.allclose(r.state, [at] * 6 + [1 + at] + [2 + at] * 6 + [3 + at], atol=0.0701) and np.allclose(np.subtract(r.action, r.state), 4)
    images = adapters.abc_images(episodes, "cam_high").orderBy("frame").collect()
    assert [r.frame for r in images] == list(range(10)) and images[0].packet == bytes([19]) and images[0].format == "h264"
    assert [r.ts_ns for r in images[1:]] == [1_950_000_000 + k * 100_000_000 - 50_000_000 for k in range(1, 10)]
    assert adapters.abc_images(episodes, "cam_left_wrist").count() == 0


def test_convert(spark, libraries, tmp_path, capsys):
    """A dump becomes a repo that reads back the same, actions derived where it has none; a second run leaves it."""
    from kinelake.__main__ import main
    from kinelake.sources import lerobot

    for i, n in enumerate((4, 6)):
        folder = tmp_path / "in" / "das_gripper" / "fold_it" / "001" / f"0{i}"
        h5(folder / "episode.hdf5", {"observations/left_eef_pose": np.full((n, 7), i), "observations/right_eef_pose": np.arange(n * 7.0).reshape(n, 7), "observations/mag_left": np.ones(n), "observations/mag_right": np.ones(n)})
        (folder / "cam_left_wrist.mp4").write_bytes(b"x")
    args = ["--root", str(tmp_path / "in"), "--dataset", "das_gripper", "convert", "--out", str(tmp_path / "out")]
    main(args)
    spec = REGISTRY.get("das_gripper").spec
    records = lerobot.scan(spark, str(tmp_path / "out"), spec)
    assert [(r.episode_index, r.n_frames, r.lang) for r in records.orderBy("episode_index").collect()] == [(0, 4, "fold it"), (1, 6, "fold it")]
    got = lerobot.read_frames(spark, records, spec, str(tmp_path / "out")).orderBy("episode_index", "frame").collect()
    assert got[0].action == got[1].state and got[9].action == got[9].state and len(got) == 10
    info = tmp_path / "out" / "das_gripper" / "meta" / "info.json"
    before = info.stat().st_mtime_ns
    main(args)
    assert info.stat().st_mtime_ns == before and '"repo"' in capsys.readouterr().out
