import hashlib

import pandas as pd
import pytest

from kinelake.functions.paths import camera_key, resolve_path
from kinelake.operators import archive
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "path, name, want",
    [
        ("/lake/datasets/x/a.parquet", None, "/lake/datasets/x/a.parquet"),
        ("file:///lake/datasets/x/a%2Db+c.npz", None, "/lake/datasets/x/a-b+c.npz"),
        (" file:/lake/datasets//x/./a.npz ", None, "/lake/datasets/x/a.npz"),
        ("file://localhost/lake/x", None, "/lake/x"),
        ("/lake/a%2Db", None, "/lake/a%2Db"),
        ("\\lake\\datasets\\x\\tmp\\..\\a", None, "/lake/datasets/x/a"),
        ("C:\\lake\\a", None, "/lake/a"),
        ("./part-1/a ", " datasets/foldery/ ", "/lake/datasets/foldery/part-1/a"),
        ("part-1//a", "foldery//", "/lake/datasets/foldery/part-1/a"),
        ("/../../a", None, "/a"),
        ("part-1/a", None, None),
        ("  ", "x", None),
        (None, "x", None),
    ],
)
def test_resolve_path(spark, path, name, want):
    df = spark.createDataFrame([(path, name)], "p string, d string")
    assert df.select(resolve_path(F.col("p"), F.col("d"))).first()[0] == want


def test_camera_key(spark):
    df = spark.createDataFrame([("observation.images.top",), ("image.top",), ("top",), (" ",), (None,)], "k string")
    assert [r[0] for r in df.select(camera_key(F.col("k"))).collect()] == ["top", "top", "top", None, None]


FILES = "file_id long, dataset_name string, path string, trajectory_id long, video_key string, first_frame long, num_frames long, n_bytes long, digest string"


def brute(rows):
    spans = {}
    for i, _, p, t, v, f, n, *_ in rows:
        if n and n > 0 and f is not None and p and t is not None and v:
            spans[i] = (p, t, v.split(".")[-1], f, f + n - 1)
    ids = sorted(spans)
    return {(a, b) for a in ids for b in ids if a < b and spans[a][:3] == spans[b][:3] and spans[a][3] <= spans[b][4] and spans[b][3] <= spans[a][4]}


def test_shared_frames_and_layout(spark):
    import random

    r = random.Random(3)
    rows = [(i, "d", f"/l/{r.randrange(3)}", r.randrange(2), r.choice(["c", "image.c", "observation.images.k"]), r.randrange(-3, 300), r.choice([0, 1, 2, 7, 64, 200, None]), 100, "x") for i in range(150)]
    rows += [rows[0], (900, None, None, 1, "c", 1, 5, 1, "x"), (901, "d", "/l/0", None, "c", 1, 5, 1, None), (902, "d", "/l/0", 0, "c", None, 5, None, None)]
    df = spark.createDataFrame(rows, FILES)
    index = archive.frame_index(df)
    got = [tuple(x) for x in archive.shared_frames(index).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    seen = []
    for x in archive.layout(index, target=1000).collect():
        seen += [(x.stream_path, x.trajectory_id, x.camera, k) for k in range(x.frame_from, x.frame_to + 1)]
    want = {(p, t, v.split(".")[-1], k) for _, _, p, t, v, f, n, *_ in rows if p and n and t is not None and f is not None for k in range(f, f + n)}
    assert len(seen) == len(set(seen)) and set(seen) == want


def test_layout_keeps_payloads_whole(spark):
    """Trimmed entries have the length and digest of the original; skip and range find each frame in it."""
    rows = [(1, "d", "/l/a", 0, "c", 0, 10, 1000, "d1"), (2, "d", "/l/a", 0, "c", 6, 10, 700, "d2"), (3, "d", "/l/a", 0, "c", 2, 3, 99, "d3"), (4, "d", "/l/a", 0, "c", 30, 2, None, None)]
    got = {x.file_id: x for x in archive.layout(archive.frame_index(spark.createDataFrame(rows, FILES)), target=10_000).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[2].frame_from, got[2].frame_to, got[2].skip, got[2].length, got[2].checksum) == (10, 15, 4, 700, "d2")
    assert (got[1].skip, got[1].length, got[4].length) == (0, 1000, None)
    assert sorted(x.offset for x in got.values()) == [0, 1000, 1700]


def test_shared_frames_empty(spark):
    index = archive.frame_index(spark.createDataFrame([], FILES))
    assert archive.shared_frames(index).count() == 0 and archive.layout(index).count() == 0


def test_pack_round_trip(spark, tmp_path):
    files = {f"/f/{i:03d}": hashlib.sha256(str(i).encode()).digest() * (i % 7) for i in range(60)}
    pdf = pd.DataFrame({"path": list(files), "content": list(files.values()), "extra": 1})
    df = spark.createDataFrame(pd.concat([pdf, pdf.head(3)]))
    index = archive.pack_files(df, str(tmp_path), target=1500, lanes=2)
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    back = {r.path: bytes(r.content) for r in archive.read_entries(index, str(tmp_path)).collect()}
    assert back == files
    assert 1 < index.select("container").distinct().count() < 20


def test_containers_verify(spark, tmp_path):
    """A container that grew past its target rolls over; damage, missing manifests and two files under a path raise."""
    folder = tmp_path / "packed"
    files = [(f"/f/{i}", bytes([i]) * 400) for i in range(20)] + [("/empty", None), (None, b"x")]
    df = spark.createDataFrame(files, "path string, content binary")
    told = archive.write_manifest(archive.pack_files(df, str(folder), target=1000, lanes=1), str(folder))
    assert told == {"entries": 21, "containers": 7, "bytes": 8000}
    index = archive.read_manifest(spark, str(folder))
    assert index.groupBy("container").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] < 1400
    assert archive.read_entries(index, str(folder)).count() == 21
    one = next(p for p in folder.iterdir() if p.name.startswith("c"))
    raw = one.read_bytes()
    one.write_bytes(b"!" + raw[1:])
    with pytest.raises(Exception, match="differ from the index"):
        archive.read_entries(index, str(folder)).collect()
    one.write_bytes(raw[:-1])
    with pytest.raises(ValueError):
        archive.read_manifest(spark, str(folder))
    with pytest.raises(ValueError):
        archive.read_manifest(spark, str(tmp_path))
    twice = spark.createDataFrame([("/a", b"1"), ("/a", b"2")], "path string, content binary")
    with pytest.raises(Exception, match="different files"):
        archive.pack_files(twice, str(tmp_path / "two")).collect()
    assert archive.write_manifest(archive.pack_files(df.limit(0), str(tmp_path / "none")), str(tmp_path / "none"))["entries"] == 0
    assert archive.read_entries(archive.read_manifest(spark, str(tmp_path / "none")), str(tmp_path / "none")).count() == 0
