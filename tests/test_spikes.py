import numpy as np

from kinelake.operators.spikes import SpikeRule, find_spikes

SCHEMA = "frame_id long, dataset_name string, repo_index long, episode_index long, frame_index long, state array<float>, action array<float>, extra string"


def series(seed=1, n=400):
    r = np.random.default_rng(seed)
    return np.cumsum(r.normal(0, 0.01, n)) * 0.5


def rows(x, y=None):
    y = series(9, len(x)) if y is None else y
    return [(i, "d", 1, 2, i, [float(v)], [float(w)], "e") for i, (v, w) in enumerate(zip(x, y))]


def found(spark, data, **rule):
    bounds = {("d", "state"): (np.array([-1.0]), np.array([1.0]))}
    df = spark.createDataFrame(data, SCHEMA)
    return {(r.frame_id, r.vector, r.dim) for r in find_spikes(df, bounds, rule=SpikeRule(**rule)).collect()}


def test_cases(spark):
    x = series()
    x[50] += 0.3
    x[80:83] -= 0.3
    x[120:140] = x[120] + np.linspace(0, 1e-6, 20)
    x[200:] += 0.3
    data = rows(x)
    data[10] = (*data[10][:5], [5.0], *data[10][6:])
    data[11] = (*data[11][:5], [float("inf")], *data[11][6:])
    data[300] = (*data[300][:5], None, *data[300][6:])
    data[301] = (*data[301][:5], [float("nan")], *data[301][6:])
    want = {(i, "state", 0) for i in [10, 11, 50, 80, 81, 82, *range(121, 140)]}
    assert found(spark, data) == want
    # an episode cut into blocks, repeated rows and a changed order give the same
    assert found(spark, [*data[::-1], *data[:40]], block=64, halo=40) == want


def test_long_departures_and_edges(spark):
    x = series()
    x[50:54] += 0.3
    x[0] += 0.3
    assert found(spark, rows(x)) == set()


def test_empty_and_null(spark):
    assert found(spark, []) == set()
    data = [(1, None, None, None, None, None, [1.0], None), (None, "d", 1, 1, 1, [9.0], None, None), (2, "d", 1, 1, None, [9.0], [], None)]
    assert found(spark, data) == {(2, "state", 0)}


def test_coarse_source_is_not_stuck(spark):
    r = np.random.default_rng(5)
    x = np.round(np.cumsum(r.normal(0, 0.012, 3000) - 0.0) / 0.02) * 0.02 * 0.5
    assert len(found(spark, rows(x, x))) == 0 or max(abs(x)) > 1


def test_small_departure_from_smooth_motion(spark):
    t = np.arange(600)
    x = 0.4 * np.sin(t / 15) + np.random.default_rng(3).normal(0, 1e-4, 600)
    x[200] += 0.12
    x[300:303] -= 0.15
    x[400:] += 0.2
    assert found(spark, rows(x)) == {(i, "state", 0) for i in (200, 300, 301, 302)}


def test_clashing_columns(spark):
    data = [(*r, 7, True, 1) for r in rows(series())]
    data[20] = (*data[20][:5], [3.0], *data[20][6:])
    df = spark.createDataFrame(data, SCHEMA + ", block int, core boolean, dim int")
    bounds = {("d", "state"): (np.array([-1.0]), np.array([1.0]))}
    assert {tuple(r) for r in find_spikes(df, bounds).collect()} == {(20, "state", 0)}


def test_natural_run_lengths():
    from kinelake.operators.spikes import natural_run

    ordinary = {k: int(4000 * 0.7**k) for k in range(2, 40)}
    stuck = {k: 3 for k in range(8, 40)}
    assert natural_run(ordinary, 0.2) == 2**40 or natural_run(ordinary, 0.2) > 24
    both = {k: ordinary.get(k, 0) + stuck.get(k, 0) for k in range(2, 40)}
    assert 18 <= natural_run(both, 0.2) <= 26
    assert natural_run({2: 5}, 0.2) == 24
