import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinelake import api
from kinelake.sources import formats, lerobot, npz, writers
from kinelake.spec import REGISTRY, DumpSpec

SPEC = DumpSpec("tiny", ("top",), 3, 2, 10.0)


def frames(spark, lengths=(5, 3, 7)):
    rows = [(e, t, [float(e), float(t), 0.5], [t * 1.0, -1.0], f"task {e % 2}") for e, n in enumerate(lengths) for t in range(n)]
    return spark.createDataFrame(rows, "episode long, frame long, state array<float>, action array<float>, task string")


def test_repo_round_trip(spark, tmp_path):
    root = tmp_path / "lake" / "d" / "repo"
    writers.write_repo(frames(spark), str(root), SPEC)
    (tmp_path / "lake" / ".hidden" / "meta").mkdir(parents=True)
    (tmp_path / "lake" / ".hidden" / "meta" / "info.json").write_text("{}")
    got = lerobot.scan(spark, str(tmp_path / "lake"), SPEC).orderBy("episode_index").collect()
    assert [(r.episode_index, r.n_frames, r.lang, r.version) for r in got] == [(0, 5, "task 0", "v2"), (1, 3, "task 1", "v2"), (2, 7, "task 0", "v2")]
    rows = lerobot.read_frames(spark, lerobot.scan(spark, str(tmp_path / "lake")), SPEC, str(tmp_path)).orderBy("episode_index", "frame").collect()
    assert len(rows) == 15 and rows[6].state == [1.0, 1.0, 0.5] and rows[6].action == [1.0, -1.0]
    index = pq.read_table(root / "data/chunk-000/episode_000002.parquet").column("index").to_pylist()
    assert index == list(range(8, 15))
    assert lerobot.scan(spark, str(tmp_path / "lake"), max_episodes=2).count() == 2
    # without the list of episodes they are counted in the files
    os.unlink(root / "meta" / "episodes.jsonl")
    again = lerobot.scan(spark, str(tmp_path / "lake")).orderBy("episode_index").collect()
    assert [(r.episode_index, r.n_frames, r.lang) for r in again] == [(0, 5, "task 0"), (1, 3, "task 0"), (2, 7, "task 0")]


def test_index_of_a_moved_dump(spark, tmp_path):
    root, index = tmp_path / "lake", str(tmp_path / "index")
    writers.write_repo(frames(spark), str(root / "r"), SPEC)
    writers.save_index(lerobot.scan(spark, str(root)), index, SPEC, str(root))
    assert writers.load_index(spark, index, SPEC, str(root)).count() == 3
    os.unlink(root / "r" / "data/chunk-000/episode_000002.parquet")
    with pytest.raises(ValueError, match="gone since the scan"):
        writers.load_index(spark, index, SPEC, str(root))


def test_only_wanted_files_are_read(spark, tmp_path):
    """Other episodes' files may be broken; lengths that are told are not counted."""
    root = tmp_path / "r"
    writers.write_repo(frames(spark), str(root), SPEC)
    (root / "data/chunk-000/episode_000002.parquet").write_bytes(b"broken")
    records = lerobot.scan(spark, str(root))
    assert records.count() == 3
    one = records.filter("episode_index = 1")
    rows = lerobot.read_frames(spark, one, SPEC, str(root))
    assert rows.count() == 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(episode_index,1)" in plan


def test_tasks_of_a_parquet(spark, tmp_path):
    """v3: an episode's task number finds its text, which may be the table's index."""
    import pandas as pd

    v3_repo(tmp_path / "r")
    meta = tmp_path / "r" / "meta"
    pd.DataFrame({"task_index": [4, 2]}, index=pd.Index(["four", "two"], name="task")).to_parquet(meta / "tasks.parquet")
    file = next(meta.rglob("episodes/**/*.parquet"))
    t = pq.read_table(file)
    t = t.drop_columns(["tasks"]) if "tasks" in t.column_names else t
    pq.write_table(t.append_column("task_index", pa.array([4, None, 9][: t.num_rows] + [None] * max(0, t.num_rows - 3), pa.int64())), file)
    assert {r.task_index: r.task for r in lerobot.tasks(spark, str(tmp_path)).collect()} == {4: "four", 2: "two"}
    got = [r.lang for r in lerobot.scan(spark, str(tmp_path)).orderBy("episode_index").collect()]
    assert got == (["four"] + ["two"] * 9)[: len(got)]


def test_lengths_from_files_and_columns(spark, tmp_path):
    root = tmp_path / "r"
    writers.write_repo(frames(spark), str(root), SPEC)
    lines = [json.loads(x) for x in (root / "meta/episodes.jsonl").read_text().splitlines()]
    lines[1]["length"] = 0
    lines.append({"episode_index": 9, "tasks": [], "length": 0})
    (root / "meta/episodes.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r.episode_index: r.n_frames for r in lerobot.scan(spark, str(root)).collect()}
    assert got == {0: 5, 1: 3, 2: 7}
    with pytest.raises(ValueError, match="observation.state"):
        lerobot.read_frames(spark, lerobot.scan(spark, str(root)), DumpSpec("x", (), 1, 1, 1.0, state_columns=("nope",)), str(root))
    wide = DumpSpec("x", (), 9, 2, 10.0, state_columns=("observation.state", "frame_index"))
    with pytest.raises(PySparkException):
        lerobot.read_frames(spark, lerobot.scan(spark, str(root)), wide, str(root)).collect()


def v3_repo(root, with_meta=True):
    (root / "meta/episodes/chunk-000").mkdir(parents=True)
    (root / "data/chunk-000").mkdir(parents=True)
    (root / "meta/info.json").write_text(json.dumps({"codebase_version": "v3.0", "fps": "25"}))
    if with_meta:
        pq.write_table(pa.table({"episode_index": [0, 1], "length": [2, 3], "tasks": [["go"], ["stop"]], "data/chunk_index": [0, 0], "data/file_index": [0, 0], "videos/cam.top/chunk_index": [0, 0], "videos/cam.top/file_index": [0, 0], "videos/cam.top/from_timestamp": [0.0, 0.1]}), root / "meta/episodes/chunk-000/file-000.parquet")
    else:
        (root / "meta/episodes/chunk-000").rmdir()
        (root / "meta/episodes").rmdir()
    pq.write_table(pa.table({"episode_index": [0, 0, 1, 1, 1], "frame_index": [0, 1, 0, 1, 2], "observation.state": [[1.0]] * 5, "action": [[2.0]] * 5}), root / "data/chunk-000/file-000.parquet")


@pytest.mark.parametrize("with_meta", [True, False])
def test_v3(spark, tmp_path, with_meta):
    v3_repo(tmp_path / "r", with_meta)
    got = lerobot.scan(spark, str(tmp_path)).orderBy("episode_index").collect()
    assert [(r.episode_index, r.n_frames, r.fps) for r in got] == [(0, 2, 25.0), (1, 3, 25.0)]
    if with_meta:
        assert got[1].cameras["cam.top"].from_timestamp == 0.1 and got[1].lang == "stop"
    spec = DumpSpec("x", (), 1, 1, 25.0)
    assert lerobot.read_frames(spark, lerobot.scan(spark, str(tmp_path)), spec, str(tmp_path)).filter("episode_index = 1").count() == 3


def test_bad_version_raises(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/info.json").write_text('{"codebase_version": "v9", "fps": 1}')
    with pytest.raises(PySparkException):
        lerobot.repos(spark, str(tmp_path)).collect()


def test_nested_repos(spark, tmp_path):
    for p in ("a", "a/b", "c/d/e/f/g/h"):
        (tmp_path / p / "meta").mkdir(parents=True)
        (tmp_path / p / "meta/info.json").write_text('{"codebase_version": "v2.1", "fps": 1}')
    assert [r.repo for r in lerobot.repos(spark, str(tmp_path)).collect()] == [str(tmp_path / "a")]


def test_index(spark, tmp_path):
    root, index = tmp_path / "r", str(tmp_path / "index")
    writers.write_repo(frames(spark), str(root), SPEC)
    assert writers.load_index(spark, index, SPEC, str(root)) is None
    assert writers.scanned(spark, str(root), SPEC, lerobot.scan, index, max_episodes=1).count() == 1 and not os.path.exists(index)
    assert writers.scanned(spark, str(root), SPEC, lerobot.scan, index).count() == 3
    assert writers.scanned(spark, str(root), SPEC, None, index).count() == 3
    with pytest.raises(ValueError, match="revision"):
        writers.load_index(spark, index, DumpSpec("tiny", (), 3, 2, 10.0, revision=2), str(root))
    os.unlink(os.path.join(index, "manifest.json"))
    with pytest.raises(ValueError, match="incomplete"):
        writers.load_index(spark, index, SPEC, str(root))
    with pytest.raises(ValueError):
        writers.save_index(lerobot.scan(spark, str(root)).limit(0), index, SPEC, str(root))


def test_npz(spark, tmp_path):
    spark.dataSource.register(npz.NpzSource)
    rows = [("e1", i, 3, [float(i), 1.0], None, "pick") for i in range(3)] + [("e2", i, 2, [float(i), 2.0], [9.0], "place") for i in range(2)]
    df = spark.createDataFrame(rows, npz.SCHEMA)
    df.repartition("path").write.format("npz").mode("append").save(str(tmp_path))
    got = spark.read.format("npz").load(str(tmp_path)).orderBy("path", "frame").collect()
    assert [(os.path.basename(r.path), r.frame, r.n, r.state, r.action, r.lang) for r in got] == [(f"{p}.npz", i, n, s, a, t) for p, i, n, s, a, t in rows]


def test_missing_library_is_named(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(b"x")
    files = formats.list_files(spark, str(tmp_path), "*.h5", depth=0)
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(PySparkException, match="h5py"):
            formats.read_files(files, formats.hdf5_rows({"a": "b"})).collect()


def test_file_reader_twin(spark, tmp_path):
    for k in range(3):
        np.save(tmp_path / f"{k}.npy", np.full((2, 1), k, np.float32))

    def rows(path):
        a = np.load(path)
        yield from ((path, i, "state", a[i].tolist()) for i in range(len(a)))

    got = formats.read_files(formats.list_files(spark, str(tmp_path), "*.npy", limit=2), rows)
    whole = formats.grouped(got, [("state", 1), ("head", 2)], "v").orderBy("path", "frame").collect()
    assert [r.v for r in whole] == [[0, 0, 0], [0, 0, 0], [1, 0, 0], [1, 0, 0]]


def test_resampled(spark):
    ev = [("p", "a", t, [float(t)]) for t in range(0, 1000, 90)] + [("p", "b", t, [float(-t)]) for t in range(150, 1200, 100)] + [("q", "a", 1, [0.0])]
    df = spark.createDataFrame(ev, "path string, topic string, ts_ns long, value array<float>")
    got = formats.resampled(df, 1e7, [("a", 1), ("b", 1)]).orderBy("frame").collect()
    assert [r.tick for r in got] == list(range(150, 991, 100)) and {r.path for r in got} == {"p"}
    assert [list(r.vector) for r in got] == [[float(max(t for t in range(0, 1000, 90) if t <= k)), float(-max(t for t in range(150, 1200, 100) if t <= k))] for k in range(150, 991, 100)]


def test_targets_and_subtasks(spark):
    df = spark.createDataFrame([("p", i, [float(i), 10.0 + i], 0.1 * i) for i in range(3)], "path string, frame long, s array<float>, g double")
    got = [r.action for r in formats.next_targets(df, "s", [(1, "g")], 2).orderBy("frame").collect()]
    assert np.allclose(got, [[1, 0], [2, 0.1], [2, 0.2]])
    labels = spark.createDataFrame([("f", "d1", "e", [(0, 4, "x")])], "source string, digest string, episode string, actions array<struct<start_frame:long,end_frame:long,action_text:string>>")
    assert formats.subtasks(labels, spark.createDataFrame([("f", "d1")], "source string, digest string")).first().stop == 4
    with pytest.raises(PySparkException):
        formats.subtasks(labels, spark.createDataFrame([("f", "d2")], "source string, digest string")).collect()
    meta = spark.createDataFrame([("/r", "a"), ("/r", "../b"), ("/r", "gone")], "root string, episode string")
    assert [r.path for r in formats.listed_episodes(meta, spark.createDataFrame([("/r/a",), ("/b",)], "path string")).collect()] == ["/r/a"]
    assert writers.ready_kind({"x/meta/info.json"}) == "lerobot" and writers.ready_kind({"a.txt"}) is None


def test_api(spark, tmp_path):
    writers.write_repo(frames(spark, (12, 9, 15, 8)), str(tmp_path / "tiny"), SPEC)
    if "tiny" not in REGISTRY.sources:
        from kinelake.spec import Source

        REGISTRY.add(Source(SPEC))
    ds = api.dataset(spark, "tiny", str(tmp_path), action_length=0.3, action_mode="delta", history_length=0.3)
    train, val = ds.normalized().split(0.25, seed=1)
    assert train.frames.select("episode_index").distinct().count() == 3 and val.frames.select("episode_index").distinct().count() == 1
    b = train.batches(4, world=2, seed=3)
    n = train.frames.count() // 8 * 8
    assert b.count() == n
    row = b.first()
    assert len(row.action) == 3 and len(row.action[0]) == 2 and len(row.state_history) == 3 and row.embodiment_id == 31
    assert api.mixture([(train, 1.0), (val, 2.0)]).select("source", "weight").distinct().count() == 2
    bare = api.Dataset(SPEC, ds.frames.withColumn("action", F.lit(None).cast("array<float>")), api.Config())
    got = bare.complete().frames.orderBy("episode_index", "frame").first()
    assert got.action == [0.0, 1.0]
    del REGISTRY.sources["tiny"]


def test_synthetic(spark):
    a = formats.synthetic(spark, 3, 5, 4, 2)
    assert a.count() == 15 and a.exceptAll(formats.synthetic(spark, 3, 5, 4, 2)).count() == 0


def test_image_streams(spark):
    rows = spark.createDataFrame([(1, b"a"), (1, b"b")], "e long, image binary")
    assert lerobot.is_image("binary") and lerobot.is_image("struct<bytes:binary,path:string>") and not lerobot.is_image("array<float>")
    assert lerobot.numeric_columns(rows.withColumn("v", F.array(F.lit(1.0)))) == ["e", "v"]
    assert lerobot.require_counts(rows, ["e"], spark.createDataFrame([(1, 2)], "e long, n_frames long")).first().frames == 2
    with pytest.raises(PySparkException):
        lerobot.require_counts(rows, ["e"], spark.createDataFrame([(1, 3)], "e long, n_frames long")).collect()
    boxed = rows.select(F.struct(F.col("image").alias("bytes"), F.lit("p").alias("path")).alias("image"))
    assert bytes(boxed.select(lerobot.image_bytes("image", dict(boxed.dtypes)["image"])).first()[0]) == b"a"
    got = spark.range(2).select(lerobot.video_frames(F.lit(0.1), F.lit(25.0), F.col("id")).alias("f")).collect()
    assert [r.f for r in got] == [2, 3]  # 2.5 is rounded to even
    info = spark.createDataFrame([('{"features": {"observation.images.top": {"dtype": "video"}, "low": {"dtype": "image"}}}',)], "i string")
    assert info.select(lerobot.feature_type(F.col("i"), "top"), lerobot.feature_type(F.col("i"), "low"), lerobot.feature_type(F.col("i"), "no")).first()[:] == ("video", "image", None)
