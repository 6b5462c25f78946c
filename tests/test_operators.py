import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinelake.operators import batching, caches, geometry, joins, sampling, space, stats, temporal
from kinelake.spec import REGISTRY, SPECS, ActionSlice, DumpSpec, Registry, Source, embodiment_id, merged_io, one_arm, reformat, stored_pose, two_poses

# specs


def test_registry():
    assert len(SPECS) == 12 and REGISTRY.names() == tuple(sorted(s.name for s in SPECS))
    assert embodiment_id("franka") == 25 and embodiment_id("x") == embodiment_id(None) == 31
    r = Registry()
    r.add(Source(SPECS[0]))
    with pytest.raises(ValueError):
        r.add(Source(SPECS[0]))
    with pytest.raises(ValueError):
        r.mix("m", [("f", 0.0, "abc")])
    with pytest.raises(TypeError):
        r.add(Source(SPECS[1], frames="no"))
    r.mix("m", [("f", 2.0, "abc")])
    assert r.rows("m") == (("f", 2.0, "abc"),) and r.rows("all") == (("abc", 1.0, "abc"),)
    assert r.select(" abc ,abc") == ("abc",) and r.select("") == ("abc",)
    with pytest.raises(ValueError):
        r.select("abc,nope")


def test_catalog(spark):
    assert REGISTRY.catalog(spark).count() == 12


def test_spaces():
    s = REGISTRY.get("galaxea").spec
    assert [x.state_span for x in s.resolved("rel")] == [(16, 22), (23, 29), (14, 15), (15, 16)]
    assert [x.rep for x in s.resolved("relative")] == ["rel", "rel", "abs", "abs"]
    assert REGISTRY.get("libero").spec.resolved("abs")[0].rep == "delta"
    with pytest.raises(ValueError):
        s.resolved("sideways")
    wide = reformat(two_poses(format="xyz_quat"), "rot6d")
    assert [(x.start, x.end) for x in wide] == [(0, 9), (9, 10), (10, 19), (19, 20)]
    poses = REGISTRY.get("kai0").spec.resolved("delta", "eef")
    assert [(x.kind, x.start, x.end) for x in poses] == [("eef", 0, 6), ("gripper", 6, 7), ("eef", 7, 13), ("gripper", 13, 14)]
    with pytest.raises(ValueError):
        DumpSpec("x", (), 2, 2, 10.0, embodiment_id=32)
    io = merged_io([s.policy_io(5), REGISTRY.get("abc").spec.policy_io(9)])
    assert io["camera_keys"][0] == "head_rgb" and io["state_dim"] == 32 and io["chunk_length"] == 9


def test_scaled_mask():
    assert space.scaled(two_poses(format="xyz_quat"), 16) == [True] * 3 + [False] * 4 + [True] + [True] * 3 + [False] * 4 + [True]
    assert space.scaled(REGISTRY.get("agibot").spec.space, 20, "state") == [True] * 20
    assert space.scaled((ActionSlice("a", 0, 2, "abs", "joint", "off"),), 3) == [False, False, True]


# time


def test_steps():
    assert [temporal.n_steps(*x) for x in [(1, 10), (0.25, 10), (0.35, 10), (0, 10)]] == [10, 2, 4, 1]
    assert [temporal.native_stride(*x) for x in [(15, 10), (25, 10), (30, 7), (5, 10)]] == [2, 2, 4, 1]
    with pytest.raises(ValueError):
        temporal.native_stride(0, 10)
    assert temporal.delta_indices(0.4, 10, 30, past=True) == [-9, -6, -3, 0]
    assert temporal.locked_frequency(stored_pose(), 10, None) == 10
    with pytest.raises(ValueError):
        temporal.locked_frequency(stored_pose(), 10, 5)
    with pytest.raises(ValueError):
        temporal.history_offsets(10, 10)


def test_timed_history_golden(spark):
    f = spark.range(18).select(F.lit(1).alias("e"), F.col("id").alias("frame"), F.col("id").alias("v"))
    got = temporal.timed_history(f, ["e"], 15.0, 0.4, 10.0, ["v"]).filter("frame = 17").orderBy("k").collect()
    assert [r.src for r in got] == [12, 14, 15, 17] and all(r.valid for r in got)
    early = temporal.timed_history(f, ["e"], 15.0, 0.4, 10.0, ["v"]).filter("frame = 1").orderBy("k").collect()
    assert [(r.src, r.valid) for r in early] == [(0, False), (0, False), (0, False), (1, True)]


def test_runs_with_nulls(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "a", None, None, "b", "a"])]
    got = temporal.run_segments(spark.createDataFrame(rows, "e int, frame long, t string"), ["e"], "t").orderBy("start").collect()
    assert [(r.start, r.stop, r.t) for r in got] == [(0, 2, "a"), (2, 4, None), (4, 5, "b"), (5, 6, "a")]


def test_segment_samples_golden(spark):
    s = spark.createDataFrame([(1, 2, 5, "first"), (1, 7, 9, "second")], "e int, start long, stop long, text string")
    got = temporal.segment_samples(s, ["e"], ["text"]).orderBy("sample").collect()
    assert [(r.sample, r.frame, r.text) for r in got] == [(0, 2, "first"), (1, 3, "first"), (2, 4, "first"), (3, 7, "second"), (4, 8, "second")]
    bad = s.unionByName(spark.createDataFrame([(1, 8, 12, " ")], s.schema)).withColumn("n", F.lit(10).cast("long"))
    assert temporal.segment_faults(bad, ["e"]).count() == 1


def test_sample_index_empty_and_zero(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 2)], "e int, n long")
    assert [(r.e, r.start, r.stop) for r in temporal.sample_index(df, ["e"]).orderBy("e").collect()] == [(1, 0, 0), (2, 0, 3), (3, 3, 5)]
    assert temporal.sample_index(df.limit(0), ["e"]).count() == 0


# joins


def test_asof_variants(spark):
    v = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("b", 5, 9.0)], "k string, ts long, v double")
    t = spark.createDataFrame([("a", 5), ("a", 10), ("a", 20), ("a", 25), ("c", 1)], "k string, tick long")
    got = lambda **o: [(r.k, r.tick, r.v) for r in joins.asof(t, v, ["k"], "tick", "ts", ["v"], **o).orderBy("k", "tick").collect()]
    assert got() == [("a", 5, 1.0), ("a", 10, 1.0), ("a", 20, 2.0), ("a", 25, 2.0), ("c", 1, None)]
    assert got(strict=True) == [("a", 5, 1.0), ("a", 10, 1.0), ("a", 20, 1.0), ("a", 25, 2.0), ("c", 1, None)]
    assert got(clip=False)[0] == ("a", 5, None)
    for block in (1, 7, 1000):
        for strict in (False, True):
            for clip in (False, True):
                assert got(strict=strict, clip=clip, block=block) == got(strict=strict, clip=clip)


def test_lookups_raise(spark):
    told = spark.createDataFrame([("t", "1", "x"), ("t", "1", "y")], "task string, episode string, text string")
    with pytest.raises(PySparkException):
        joins.instruction(told.select("task", "episode"), told, "task", "episode", "text").collect()
    cams = spark.createDataFrame([(1, "odd", 1.0)], "e int, camera string, v double")
    with pytest.raises(PySparkException):
        joins.align_cameras(cams, ["e"], "camera", "v", ["top"]).collect()


def test_intern(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, s string")
    rows, dim = joins.intern(df, "s", "id")
    assert {(r.i, r.id) for r in rows.collect()} == {(1, 2), (2, 0), (3, 1), (4, 2)} and dim.count() == 3


# vectors


def test_pack_and_fit(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3.0)], "a array<float>, b float")
    whole = df.select(space.pack([F.col("a"), F.col("b")], {1}, 3).alias("v"), space.fit_dim(F.col("a"), 4).alias("f"), space.pack([F.col("a")], set(), 1).alias("c")).first()
    assert whole.v == [1, 2, 3] and whole.f == [1, 2, 0, 0] and whole.c == [1]
    with pytest.raises(PySparkException):
        df.select(space.pack([F.col("a"), F.col("b")], {1}, 4)).collect()


@pytest.mark.parametrize("rep", ["rel", "delta"])
def test_train_space_round_trip(spark, rep):
    sp = REGISTRY.get("galaxea").spec.resolved(rep)
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=(5, 14)).tolist(), r.normal(size=32).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>, s array<double>")
    got = df.select("i", space.to_train(F.col("c"), F.col("s"), sp, 14).alias("t"), "s", "c").withColumn("b", space.from_train(F.col("t"), F.col("s"), sp, 14)).orderBy("i").collect()
    for row, (_, c, s) in zip(got, rows):
        c, s, t = np.array(c), np.array(s), np.array(row.t)
        assert np.allclose(row.b, c)
        assert np.allclose(t[:, 12:], c[:, 12:])
        ref = s[16:22] if rep == "rel" else np.vstack([s[16:22], c[:-1, :6]])
        assert np.allclose(t[:, :6], c[:, :6] - ref)


# geometry

angles = st.floats(-math.pi, math.pi, allow_nan=False)


@settings(max_examples=200, deadline=None)
@given(st.tuples(angles, angles, angles))
def test_rotations_round_trip(v):
    m = geometry.rotvec_matrix(np.array(v))
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and np.isclose(np.linalg.det(m), 1)
    for a, b in geometry.ROTATION.values():
        assert np.allclose(a(b(m)), m, atol=1e-6)
    assert geometry.matrix_quat(m)[3] >= 0


def test_special_rotations():
    for v in ([math.pi, 0, 0], [0, math.pi, 0], [0, 0, math.pi], [0, 0, 0], [1e-9, 0, 0], [math.pi - 1e-7, 1e-9, 0]):
        m = geometry.rotvec_matrix(np.array(v, float))
        assert np.allclose(geometry.rotvec_matrix(geometry.matrix_rotvec(m)), m, atol=1e-7)


def test_poses():
    r = np.random.default_rng(2)
    for fmt, w in (("xyz_rotvec", 6), ("xyz_quat", 7), ("xyz_rot6d", 9)):
        a, b = (geometry.convert_pose(r.normal(size=(20, 6)), "xyz_rotvec", fmt) for _ in range(2))
        assert a.shape[-1] == w
        d = geometry.relative_pose(a, b, fmt)
        assert np.allclose(geometry.pose_matrix(geometry.absolute_pose(d, b, fmt), fmt), geometry.pose_matrix(a, fmt), atol=1e-9)
    t = geometry.pose_matrix(r.normal(size=(9, 6)), "xyz_rotvec")
    assert np.allclose(geometry.inverse(t) @ t, np.eye(4))
    with pytest.raises(ValueError):
        geometry.pose_matrix(np.zeros(7), "xyz_rotvec")


def test_arms():
    for (name, n), sides in geometry.ARMS.items():
        for side, arm in sides.items():
            t = arm.fk(np.zeros((1, n)))[0]
            assert np.allclose(t[:3, :3] @ t[:3, :3].T, np.eye(3), atol=1e-9)
    assert np.allclose(geometry.VX300S.fk(np.zeros((1, 6)))[0], geometry.VX300S.home)
    # a planar chain: first joint turns about z
    q = np.array([[0.3, 0, 0, 0, 0, 0.0]])
    x, y = geometry.VX300S.fk(q)[0][:2, 3]
    assert np.allclose([x, y], [0.536494 * math.cos(0.3), 0.536494 * math.sin(0.3)])
    # Franka at zero: known tool place
    assert np.allclose(geometry.FRANKA.fk(np.zeros((1, 7)))[0][:3, 3], [0.088, 0, 0.333 + 0.316 + 0.384 - 0.107])
    with pytest.raises(ValueError):
        geometry.arm_of("aloha", 7)
    kai = REGISTRY.get("kai0").spec
    packed = np.arange(14.0)[None] / 10
    out = geometry.apply_arms(packed, kai.space, "aloha", "xyz_quat")
    assert out.shape == (1, 16) and out[0, 7] == packed[0, 6]


def test_eef_chunks(spark):
    r = np.random.default_rng(3)
    c, s = r.normal(size=(4, 6)), r.normal(size=6)
    df = spark.createDataFrame([(c.tolist(), s.tolist()), (None, None)], "c array<array<double>>, s array<double>")
    for mode in ("rel", "delta"):
        there = df.select(geometry.eef_chunk_udf("xyz_rotvec", mode)("c", "s").alias("t"), "s")
        back = there.select(geometry.eef_chunk_udf("xyz_rotvec", mode, invert=True)("t", "s").alias("b")).collect()
        assert np.allclose(geometry.pose_matrix(np.array(back[0].b), "xyz_rotvec"), geometry.pose_matrix(c, "xyz_rotvec"), atol=1e-9)
        assert back[1].b is None


# statistics


@pytest.mark.parametrize("n", [1, 2, 100, 4097])
def test_quantiles_equal_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 3)).astype(np.float32)
    x[:, 1] = 0
    if n > 2:
        x[0, 2], x[1, 2] = 1e30, -1e30
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "i int, v array<float>")
    c = stats.long_form(df, [], ["v"])
    for f in (stats.quantiles, stats.quantiles_bounded):
        got = {r.dim: (r.q01, r.q99) for r in f(c, ["dim"], {"q01": 0.01, "q99": 0.99}).collect()}
        for k in range(3):
            assert np.allclose(got[k], np.quantile(x[:, k].astype(float), [0.01, 0.99]), rtol=1e-9)
    m = {r.dim: r for r in stats.moments(c, ["dim"]).collect()}
    assert np.isclose(m[0].std, x[:, 0].astype(float).std()) and m[0]["count"] == n


@pytest.mark.parametrize("most", [1, 40, 100_000])
def test_ranks_in_finer_cells(spark, most):
    """Ties, a null group, extreme and infinite values; cells are counted again until few values are left."""
    r = np.random.default_rng(5)
    groups = {None: r.normal(size=700), "ties": np.repeat([1.0, 2.0, 2.0, 2.0], 150), "narrow": 1e9 + r.random(500), "wild": np.concatenate([r.normal(size=300) * 10.0 ** r.integers(-300, 300, 300), [np.inf, -np.inf, 0.0, -0.0]]), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {x.g: x for x in stats.quantiles_bounded(df, ["g"], {"q01": 0.01, "q50": 0.5, "q99": 0.99}, most=most).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose([got[g].q01, got[g].q50, got[g].q99], np.quantile(vs, [0.01, 0.5, 0.99]), rtol=1e-9)
    near = {x.g: x for x in stats.nearest_rank(df, ["g"], "value", {"p50": 0.5, "p95": 0.95}).collect()}
    for g, vs in groups.items():
        assert (near[g].p50, near[g].p95, near[g].n) == tuple(np.sort(vs)[[round((len(vs) - 1) * q) for q in (0.5, 0.95)]]) + (len(vs),)
    whole = stats.quantiles(df.filter("g = 'ties'"), [], {"q": 0.5}).collect()
    assert [x.q for x in whole] == [2.0] and stats.quantiles(df.limit(0), ["g"], {"q": 0.5}).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_quantiles(spark, kind):
    from kinelake.operators import ranks

    r = np.random.default_rng(4)
    x = r.normal(size=(900, 4)) * [1, 1e-3, 1e30 if kind == "double" else 1e20, 1]
    x[:, 3] = np.round(x[:, 3])
    x = x.astype(np.float32 if kind == "float" else float)
    x[5, 0], x[6, 0], x[7, 0] = np.inf, -np.inf, -0.0
    groups = r.choice(["a", "b", None], 900)
    rows = [(g, [None if r.random() < 0.02 else float("nan") if r.random() < 0.02 else float(v) for v in row][: int(r.integers(2, 5))]) for g, row in zip(groups, x)] + [("a", None), ("c", []), ("c", None)]
    df = spark.createDataFrame(rows, f"g string, v array<{kind}>").repartition(5)
    qs = {"q0": 0.0, "q01": 0.01, "q50": 0.5, "q99": 0.99, "q1": 1.0}
    got = {(o.g, o.dim): o for o in ranks.vector_quantiles(df, ["g"], "v", qs).collect()}
    want = {}
    for g, v in rows:
        for d, c in enumerate(v or []):
            if c is not None and c == c:
                want.setdefault((g, d), []).append(np.float32(c) if kind == "float" else c)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].n == len(v)
        at = np.array(list(qs.values())) * (len(v) - 1)
        low, high = (np.sort(np.array(v, float))[f(at).astype(int)] for f in (np.floor, np.ceil))
        share = at - np.floor(at)
        with np.errstate(invalid="ignore"):  # between equal values there is no way
            told = np.where((share > 0) & (high > low), low + (high - low) * share, low)
        assert np.allclose([got[k][q] for q in qs], told, rtol=1e-12)
    whole = ranks.vector_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [o.dim for o in sorted(whole, key=lambda o: o.dim)] == [0, 1, 2, 3]
    assert ranks.vector_quantiles(df.limit(0), ["g"], "v", qs).count() == 0


@pytest.mark.parametrize("mode", ["rel", "delta"])
def test_chunks_of_poses_in_one_stack(spark, mode):
    """Ragged, empty and null chunks; back again gives the chunk."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=(n, 6)).tolist() if n is not None else None, r.normal(size=6).tolist() if i != 4 else None) for i, n in enumerate([3, 1, 0, None, 2, 5])]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>, s array<double>").coalesce(1)
    got = df.withColumn("r", geometry.eef_chunk_udf("xyz_rotvec", mode)("c", "s")).withColumn("b", geometry.eef_chunk_udf("xyz_rotvec", mode, True)("r", "s")).collect()
    for x in got:
        if x.c is None or x.s is None:
            assert x.r is None
            continue
        ref = np.array(x.s)
        for k, a in enumerate(x.c):
            assert np.allclose(x.r[k], geometry.relative_pose(np.array(a), ref, "xyz_rotvec"))
            assert np.allclose(geometry.relative_pose(np.array(x.b[k]), np.array(a), "xyz_rotvec"), 0, atol=1e-6)
            ref = np.array(a) if mode == "delta" else ref
        assert len(x.r) == len(x.c)


def test_poses_of_a_space(spark):
    """End effectors of a space are converted, its grippers stay; back again gives the chunk."""
    from kinelake.spec import two_poses

    space = two_poses(format="xyz_quat")
    r = np.random.default_rng(1)
    pose = lambda: np.concatenate([np.r_[r.normal(size=3), (q := r.normal(size=4)) / np.linalg.norm(q) * np.sign(q[3]), r.random()] for _ in "lr"])
    chunk, state = [pose() for _ in range(3)], pose()
    df = spark.createDataFrame([([c.tolist() for c in chunk], state.tolist())], "action array<array<double>>, state array<double>")
    for rep in ("rel", "delta"):
        from dataclasses import replace

        sp = tuple(replace(s, rep=rep) if s.kind == "eef" else s for s in space)
        told = geometry.eef_chunks(df, "action", "state", sp)
        got = np.array(told.first().action)
        arm = next(s for s in sp if s.kind == "eef")
        at = slice(arm.start, arm.end)
        for k in range(3):
            ref = state if rep == "rel" or k == 0 else chunk[k - 1]
            assert np.allclose(got[k][at], geometry.relative_pose(chunk[k][at], ref[at], "xyz_quat"), atol=1e-9)
        grips = [s.start for s in sp if s.kind == "gripper"]
        assert np.allclose(got[:, grips], np.array(chunk)[:, grips])
        back = np.array(geometry.eef_chunks(told, "action", "state", sp, invert=True).first().action)
        assert np.allclose(np.abs(back), np.abs(chunk), atol=1e-6)


def test_running_sums(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i, i % 5 if i % 7 else None) for i in range(300)], "k string, i int, n int")
    got = temporal.running(df, ["k"], ["i"], "n").collect()
    for key in ("a", None):
        total = 0
        for x in sorted((x for x in got if x.k == key), key=lambda x: x.i):
            assert x.before == total
            total += x.n or 0
    assert len(got) == 300


def test_flow(spark):
    from kinelake.operators import flow

    df = spark.createDataFrame([([1.0, 2.0, 3.0], [9.0, 8.0], 5), ([1.0], [9.0], None), ([1.0], None, 1)], "c array<double>, p array<double>, n int")
    assert [x.c for x in df.select(flow.with_prefix(F.col("c"), F.col("p"), F.col("n")).alias("c")).collect()] == [[9, 8, 3], [1], [1]]
    got = spark.range(1).select(flow.normalized_prefix(F.array(F.array(F.lit(5.0), F.lit(3.0))), [0, 0], [10, 10], [True, False]).alias("a")).first()
    assert np.allclose(got.a, [[0, 3]], atol=1e-5)
    w = spark.range(1).select(flow.time_waves(F.lit(-0.5), 4).alias("w")).first().w
    assert np.allclose([(x.s, x.c) for x in w], [(np.sin(-0.5 * 10000 ** (-i / 4)), np.cos(0.5 * 10000 ** (-i / 4)) - 1) for i in range(4)])


def test_normalize_vectors_and_finite(spark):
    df = spark.createDataFrame([([0.0, 5.0],), ([10.0, 5.0],)], "v array<float>")
    s = spark.createDataFrame([("v", 0, 0.0, 10.0, 0.0, 10.0, 1), ("v", 1, 5.0, 5.0, 5.0, 5.0, 1)], "field string, dim long, q01 double, q99 double, min double, max double, quantile_fallback int")
    y = stats.normalize_vectors(df, s, "v", "v")
    assert np.allclose([r.v for r in y.collect()], [[-1, 0], [1, 0]], atol=1e-5)
    assert np.allclose([r.v for r in stats.normalize_vectors(y, s, "v", "v", invert=True).collect()], [[0, 5], [10, 5]], atol=1e-6)
    raw = stats.normalize_vectors(df, s, "v", "v", [False, True])
    assert [r.v[0] for r in raw.collect()] == [0, 10]
    with pytest.raises(PySparkException):
        stats.require_finite(spark.createDataFrame([([float("nan")],)], "v array<double>"), "v").collect()


def test_parity_merges(spark):
    df = spark.createDataFrame([(i % 2, float(i), float(i) + 0.5) for i in range(10)], "g int, a double, r double")
    whole = stats.parity(df, [], "a", "r").first()
    merged = stats.merge_parity(stats.parity(df, ["g"], "a", "r"), []).first()
    assert all(np.isclose(whole[k], merged[k]) for k in whole.asDict())
    zero = stats.parity(spark.createDataFrame([(0.0, 0.0)], "a double, r double"), [], "a", "r").first()
    assert zero.cosine is None and zero.relative_l2 is None


def test_stats_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "field string, mean double")
    stats.save_stats(df, str(tmp_path / "s.json"))
    assert stats.load_stats(spark, str(tmp_path / "s.json")).first().mean == 1.0
    with pytest.raises(ValueError):
        stats.save_stats(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "n.json"))
    assert not (tmp_path / "n.json").exists()
    assert stats.stats_name("joint", "rel", "default", 10, 1.5) == "norm_joint_rel_default_10hz_1.5s.json"


# sampling


def test_shuffle_is_complete_and_resumable(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    a = sampling.shuffled(df, ["i"], 1)
    order = [r.i for r in a.orderBy("pos").collect()]
    assert sorted(order) == list(range(1000)) and order != list(range(1000))
    assert order == [r.i for r in sampling.shuffled(df.repartition(7), ["i"], 1).orderBy("pos").collect()]
    assert order != [r.i for r in sampling.shuffled(df, ["i"], 1, epoch=1).orderBy("pos").collect()]
    whole = sampling.cursor_batches(a, 16, 4, 1000)
    tail = sampling.cursor_batches(a, 16, 4, 1000, start=3)
    key = lambda d: {(r.batch, r["rank"], r.slot): r.i for r in d.collect()}
    w, t = key(whole), key(tail)
    assert len(w) == 960 and t == {k: v for k, v in w.items() if k[0] >= 3}
    assert len(key(sampling.cursor_batches(a, 16, 4, 1000, drop_last=False))) == 1000
    with pytest.raises(ValueError):
        sampling.cursor_batches(a, 600, 4, 1000)


def test_weighted_ratio(spark):
    got = sampling.weighted_draws(spark, [("a", 100.0, 1000), ("b", 1.0, 1000)], 20000, 3)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["b"] / 20000 - 1 / 101) < 0.003
    assert got.filter("row < 0 or row >= 1000").count() == 0
    for bad in ([], [("a", 0.0, 5)], [("a", float("inf"), 5)], [("a", 1.0, 0)]):
        with pytest.raises(ValueError):
            sampling.weighted_draws(spark, bad, 1, 1)
    assert sampling.needs_replacement([1, 2]) and not sampling.needs_replacement([1, 1])


def test_holdout(spark):
    df = spark.range(300).select("id", (F.col("id") % 40).alias("g"))
    got = sampling.holdout(df, "g", 0.2, 1)
    assert got.filter("held").select("g").distinct().count() == 8
    assert sampling.overlap(got.filter("held"), got.filter("not held"), "g").count() == 0
    assert sampling.holdout_cut(2, 0.01) == 1 and sampling.holdout_cut(10, 1.0) == 9
    with pytest.raises(ValueError):
        sampling.holdout(df.filter("g = 1"), "g", 0.5, 1)


@pytest.mark.parametrize("lengths, take", [([5, 1, 9], 7), ([5, 1, 9], 15), ([5, 1, 9], 100), ([3] * 50, 20), ([0, 4], 3), ([2, 2], 1)])
def test_balanced(spark, lengths, take):
    counts = sampling.balanced_counts(lengths, take)
    assert sum(counts) == min(take, sum(lengths)) or len([x for x in lengths if x]) > take
    got = sampling.balanced_sample(spark.createDataFrame(list(enumerate(lengths)), "e long, n long"), "e", "n", take)
    per = {r.e: r["count"] for r in got.groupBy("e").count().collect()}
    assert per == {i: c for i, c in enumerate(counts) if c}
    assert got.distinct().count() == got.count()


def test_rank_slices(spark):
    df = spark.range(10).select(F.col("id").alias("pos"))
    got = sampling.rank_slices(df, 4, 10).collect()
    assert len(got) == 12 and sum(r.valid for r in got) == 10 and {r.step for r in got} == {0, 1, 2}
    assert sampling.budgets(["a", "b", "c"], 8) == {"a": 3, "b": 3, "c": 2}


# batches


def test_pad_batches(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0]], [1]), (0, [[3.0], [4.0]], None), (1, [], [2, 3])], "b int, m array<array<double>>, h array<int>")
    got = {tuple(map(tuple, r.m)): r for r in batching.pad_batches(df, "b", ["m"], ["h"]).collect()}
    assert got[(1, 2), (0, 0)].m_mask == [True, False] and got[(1, 2), (0, 0)].h == [1]
    assert got[(3, 0), (4, 0)].h == [0] and got[(3, 0), (4, 0)].h_mask == [False]
    assert got[()].h == [2, 3]
    with pytest.raises(PySparkException):
        batching.require_uniform(df, "b", "h").collect()
    with pytest.raises(PySparkException):
        df.select(batching.to_model(F.col("h"), 1, "int")).collect()
    filled = batching.fill_masks(df.select("h"), ["h"]).first()
    assert filled.h_mask == [True] and filled.embodiment_id == 31


# caches


def test_shards(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("float")).alias("f"))
    path = str(tmp_path / "c")
    assert caches.write_shards(rows.filter("row_id < 1024"), path, {"m": 1}) == 1
    assert caches.write_shards(rows, path, {"m": 1}) == 2
    assert caches.write_shards(rows, path, {"m": 1}) == 0
    assert caches.read_shards(spark, path, {"m": 1}).agg(F.count_distinct("row_id")).first()[0] == 2500
    for f in (lambda: caches.write_shards(rows, path, {"m": 2}), lambda: caches.read_shards(spark, path, {"m": 2}), lambda: caches.read_shards(spark, str(tmp_path))):
        with pytest.raises(ValueError):
            f()
    assert caches.content_path("/c", {"a": 1, "b": 2}) == caches.content_path("/c", {"b": 2, "a": 1})
    with pytest.raises(TypeError):
        caches.require_fields(rows, {"f": ("double", 1)})
    with pytest.raises(PySparkException):
        caches.require_fields(rows, {"f": ("float", 2)}).collect()


def test_interrupted_shards(spark, tmp_path):
    """Rows left without a marker are not there twice after the next run; a repeated id raises."""
    rows = spark.range(3000).select(F.col("id").alias("row_id"))
    path = str(tmp_path / "c")
    caches.write_shards(rows, path, {})
    (tmp_path / "c" / "done-1.json").unlink()
    assert caches.write_shards(rows, path, {}) == 1
    assert caches.read_shards(spark, path, {}).count() == 3000
    with pytest.raises(ValueError):
        caches.write_shards(rows.union(rows.limit(1)), str(tmp_path / "d"), {})


def test_json_contract():
    assert json.loads(caches.canonical({"b": 1, "a": [1]})) == {"a": [1], "b": 1}


def test_one_arm():
    assert [s.name for s in one_arm()] == ["arm", "gripper"]


def test_resize_is_bilinear():
    from kinelake.functions import images

    ramp = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 12, 0).repeat(3, 2)
    big = images.resize(ramp, 24, 40).astype(int)
    assert big.shape == (24, 40, 3) and (np.diff(big[0, :, 0]) >= 0).all() and set(np.diff(big[0, 1:-1, 0])) <= {4, 5, 6}
    assert np.array_equal(images.resize(ramp, 12, 20), ramp) and (images.resize(ramp[:1, :1], 5, 7) == ramp[0, 0]).all()
    assert np.isclose(images.resize(ramp.astype(np.float32), 12, 10)[0, 3, 0], 65)


def test_images():
    from kinelake.functions import images

    r = np.random.default_rng(0)
    image = r.integers(0, 255, (100, 50, 3), dtype=np.uint8)
    out = images.letterbox(image, 20)
    assert out.shape == (20, 20, 3) and (out[:, :5] == 0).all() and (out[:, 15:] == 0).all() and out[:, 5:15].any()
    assert np.array_equal(images.resize(image, 100, 50), image)
    assert images.imagenet(image).shape == (3, 100, 50)
    x = np.float32([0, -0.0, 1.5, -3.25, 1e30, np.inf, np.nan, 1.00390625])
    back = images.bf16_float(images.float_bf16(x))
    assert np.allclose(back[:6], x[:6], rtol=2**-8) and np.isnan(back[6]) and back[2] == 1.5


def test_image_columns(spark):
    from kinelake.functions import images

    raw = np.arange(12, dtype=np.uint8).reshape(2, 2, 3).tobytes()
    df = spark.createDataFrame([(raw, 2, 2), (None, None, None)], "p binary, h int, w int")
    got = [bytes(r[0]) for r in df.select(images.letterbox_column("p", "h", "w", 2)).collect()]
    assert got == [raw, bytes(12)]
    bits = spark.createDataFrame([([0x3F80, 0xC000],), (None,)], "b array<int>")
    assert [r[0] for r in bits.select(images.bf16_column("b")).collect()] == [[1.0, -2.0], None]


def test_seal_and_cursor(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("row_id"))
    path = str(tmp_path / "c")
    caches.write_shards(rows, path, {}, shard_rows=40)
    assert caches.seal(spark, path) >= 3 and caches.seal_faults(spark, path).count() == 0
    name = next(f for _, _, fs in __import__("os").walk(f"{path}/rows") for f in fs if f.endswith(".parquet"))
    target = next(str(p) for p in (tmp_path / "c" / "rows").rglob(name))
    with open(target, "ab") as f:
        f.write(b"x")
    for crc in (tmp_path / "c" / "rows").rglob(".*.crc"):  # the local file system's own checksums
        crc.unlink()
    assert caches.seal_faults(spark, path).count() == 1
    with pytest.raises(ValueError):
        caches.require_all(rows, rows.filter("row_id < 50"), ["row_id"])
    tag = rows.select(caches.source_tag(F.lit("a"), F.lit(1), F.lit(2)), caches.source_tag(F.lit("a"), F.lit(1), F.lit(3))).first()
    assert tag[0] != tag[1]
    sampling.save_cursor(str(tmp_path / "k"), 1, 2, 3, "s")
    assert sampling.load_cursor(str(tmp_path / "k"), "s") == (1, 2, 3)
    with pytest.raises(ValueError):
        sampling.load_cursor(str(tmp_path / "k"), "other")


def test_command_line(spark, capsys):
    from kinelake.__main__ import main

    main(["--root", "/nowhere", "--dataset", "abc", "scan"])
    assert '"missing": "/nowhere/abc"' in capsys.readouterr().out
