import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeflow.operators import assemble, asof, binning, components, dbscan, forest, frames, masks, series, signal
from spokeflow.streaming import live


def test_bin_edges_and_tail(spark):
    rows = [(0, t, 1.0) for t in (0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.95)]
    df = spark.createDataFrame(rows, "run int, t double, v double")
    edges = binning.grid(df, "t", ["run"], 0.1)
    got = [(r.t, r.bin) for r in binning.on_grid(df, edges, "t", ["run"], 0.1).orderBy("t").collect()]
    edges_by_hand = np.arange(0.0, 0.95, 0.1)
    want = np.histogram([t for _, t, _ in rows], edges_by_hand)[0]
    assert [sum(b == i for _, b in got) for i in range(len(want))] == want.tolist() and len(got) == want.sum()
    whole = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, 1.0)], "run int, t double, v double")
    assert binning.grid(whole, "t", ["run"], 0.25).first().bins == len(np.arange(0.0, 1.0, 0.25)) - 1


def test_rocks_reach_their_neighbours(spark):
    rows = [(0, b, r, d) for b, r, d in [(0, 0, 0.0), (1, 1, 4.0), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0), (5, 1, 3.0)]]
    df = spark.createDataFrame(rows, "run int, bin long, rock int, rock_depth double")
    onto = spark.range(6).select(F.lit(0).alias("run"), F.col("id").alias("bin"))
    got = [(r.bin, r.rock, r.rock_depth) for r in binning.bin_rocks(df, ["run"], onto=onto).orderBy("bin").collect()]
    assert got == [(0, 0, 0.0), (1, 1, 3.0), (2, 1, 3.0), (3, 0, 0.0), (4, 0, 0.0), (5, 1, 3.0)]


def test_asof_ties_and_wrap(spark):
    l = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 1.0), (2, 3.0)], "k int, t double")
    r = spark.createDataFrame([(1, 5.0, "a"), (1, 9.0, "b"), (1, 11.0, "c")], "k int, s double, v string")
    back = {(x.k, x.t): x.v for x in asof.backward(l, r, ["k"], "t", "s", ["v"]).collect()}
    assert back == {(1, 5.0): "a", (1, 10.0): "b", (1, 1.0): None, (2, 3.0): None}
    wrapped = {(x.k, x.t): x.v for x in asof.backward(l, r, ["k"], "t", "s", ["v"], wrap=True).collect()}
    assert wrapped[1, 1.0] == "c"
    near = {(x.k, x.t): x.v for x in asof.nearest(l, r, ["k"], "t", "s", ["v"]).collect()}
    assert near[1, 10.0] == "b" and near[1, 1.0] == "a" and near[2, 3.0] is None


def test_short_series_are_never_clean(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "r int, t int, x double")
    assert not any(r.clean for r in masks.clean_slip(df, "x", ["r"], ["t"]).collect())


def test_burn_in_keeps_last_row(spark):
    df = spark.createDataFrame([(0, i) for i in range(5)], "r int, i int")
    assert [r.i for r in masks.burn_in(df, ["r"], ["i"], 100).collect()] == [4]
    assert masks.burn_in(df, ["r"], ["i"], 3).count() == 2


def test_burn_in_of_a_hot_run(spark):
    df = spark.range(20_000).selectExpr("if(id % 4 = 0, id % 12, 1) AS r", "20000 - id AS i")
    got = {(x.r, x.i): x.t for x in masks.burn_in(df, ["r"], ["i"], 30).collect()}
    runs: dict = {}
    for x in df.collect():
        runs.setdefault(x.r, []).append(x.i)
    assert got == {(r, i): t for r, rows in runs.items() for t, i in enumerate(sorted(rows)) if t >= min(30, len(rows) - 1)}


def test_intervals_of_a_key_in_many_pieces(spark):
    df = spark.range(60_000).selectExpr("if(id % 9 = 0, 2, 1) AS k", "id AS t", "element_at(array('on', 'off', 'note'), cast(pmod(xxhash64(id), 3) + 1 as int)) AS kind")
    got = sorted(tuple(x) for x in live.intervals(df, ["k"], "t", "kind", "on", "off").collect())
    want, last = [], {}
    for x in sorted(df.where("kind <> 'note'").collect(), key=lambda x: x.t):
        if x.kind == "off" and last.get(x.k, ("", 0))[0] == "on":
            want.append((x.k, last[x.k][1], x.t))
        last[x.k] = x.kind, x.t
    assert got == sorted(want)


def test_impute_neighbours():
    near = frames.neighbours(20, 96, 23)
    assert {x for r, y, x in near if r == 5} == {22, 24} and len([1 for r, _, _ in near if r == 5]) == 6
    assert len([1 for r, _, _ in near if r == 0]) == 4


def test_contact_sets_count_coords(spark):
    r = np.random.default_rng(1)
    rows = [(0, t, i, j, float(r.exponential()), 8) for t in range(3) for i in range(4) for j in range(16)]
    px = spark.createDataFrame(rows, "run int, t int, row int, col int, p double, hub int")
    marked = frames.contact(px, ["run", "t"], "hub", 16, 1.0)
    sets = frames.contact_sets(marked, ["run", "t"]).collect()
    assert all(s.npix == len(s.coords) == len(s["values"]) for s in sets)
    area = {(x.t): x.npix_all for x in frames.contact_area(marked, ["t"]).collect()}
    assert all(area[s.t] == s.npix for s in sets if s.subset == "all")
    assert {x.lean for x in frames.lean(marked, ["t"], intended=True).collect()} <= {-1, 0, 1}


def test_components_match_union_find(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(500, 501 + i) for i in range(60)]
    lead = {}

    def find(x):
        lead.setdefault(x, x)
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        lead[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    for hub in (components.HUB, 5):
        got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "src long, dst long"), hub=hub).collect()}
        assert got == {x: find(x) for x in touched}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dbscan_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.3, (40, 2)), r.normal(3, 0.3, (40, 2)), r.uniform(-4, 8, (15, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    for own in (True, False):
        n = (d <= 0.5).sum(1) - (0 if own else 1)
        core = n >= 4
        got = {g.id: (g.cluster, g.core) for g in dbscan.dbscan(df, 0.5, 4, count_self=own).collect()}
        assert [got[i][1] for i in range(len(x))] == core.tolist()
        for i in range(len(x)):
            near = np.flatnonzero((d[i] <= 0.5) & core)
            if not core[i]:
                assert got[i][0] == (min(got[int(j)][0] for j in near) if len(near) else None)
            else:
                assert all(got[int(j)][0] == got[i][0] for j in near)


def test_cart_forest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    t = forest.grow(x, y, 2, max_depth=8, max_features=3, bootstrap=False)
    assert (forest.predict([t], x, 2) == y).mean() > 0.97
    df = spark.createDataFrame([(*map(float, v), float(c)) for v, c in zip(x, y)], "a double, b double, c double, label double")
    trees = forest.load_trees(forest.fit_forest(df, ["a", "b", "c"], "label", 2, trees=6, max_depth=6))
    out = forest.apply_forest(df, trees, ["a", "b", "c"], 2)
    assert out.where("prediction = label").count() > 270
    slope = forest.grow(x, x[:, 0] * 2, 0, max_depth=6, max_features=3, bootstrap=False)
    assert np.abs(forest.predict([slope], x, 0) - x[:, 0] * 2).mean() < 0.3


def test_group_folds_never_split(spark):
    df = spark.createDataFrame([(i % 17,) for i in range(400)], "g int")
    folds = assemble.group_folds(df, "g", 5).collect()
    assert len(folds) == 17 and len({f.fold for f in folds}) == 5


def test_aligned_features(spark):
    df = spark.range(2).select(F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert assemble.aligned(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        assemble.aligned(df, ["c"])


@pytest.mark.parametrize("name", ["haar", "db2"])
@pytest.mark.parametrize("n", [8, 9, 33, 201])
def test_wavelets_invert(name, n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(signal.waverec(signal.wavedec(x, name), name)[:n], x)


def test_haar_is_the_mean_and_difference():
    a, d = signal.dwt(np.array([1.0, 3.0, 5.0, 5.0]), "haar")
    assert np.allclose(a, np.array([4, 10]) / np.sqrt(2)) and np.allclose(np.abs(d), np.array([2, 0]) / np.sqrt(2))


def test_regions():
    m = np.zeros((12, 12), bool)
    m[2:8, 3:9] = True
    p = dict(zip(signal.PROPERTIES, signal.region(m, m.astype(float))))
    assert p["area"] == 36 and p["perimeter"] == 20 and p["convex_area"] == 36 and p["extent"] == 1 and p["euler_number"] == 1
    m[4, 5] = False
    p = dict(zip(signal.PROPERTIES, signal.region(m, m.astype(float))))
    assert p["filled_area"] == 36 and p["euler_number"] == 0
    assert signal.label(np.eye(3, dtype=bool)).max() == 3 and signal.label(np.eye(3, dtype=bool), True).max() == 1


def test_otsu_and_start_stop():
    x = np.concatenate([np.full(50, 0.0), np.full(50, 1.0)])
    assert 0 <= signal.otsu(x) < 1
    turn = np.concatenate([np.zeros(60), np.arange(200.0), np.full(60, 199.0)])
    assert signal.start_and_stop(turn) == (59, 258)
    assert signal.start_and_stop(np.zeros(50)) == (0, 49)


def test_series_features_of_short_runs():
    for n in (0, 1, 2, 5):
        assert set(signal.series_features(np.ones(n))) == set(series.SERIES)


def test_folds_and_stack(spark):
    a = spark.range(1).select(F.lit(1.0).alias("x"))
    b = spark.range(1).select(F.lit(2.0).alias("y"))
    assert sorted(assemble.stacked([a, b]).columns) == ["x", "y"]


def test_finite_rows(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert masks.finite_rows(df, ["x"]).count() == 1


def test_feature_selection():
    names = ["npix_all", "bbox_area1_lag0_mean_grouser", "sink_mean"]
    assert masks.select_features(names, wanted=["sink_mean", "x"]) == ["sink_mean"]
    assert masks.select_features(names, preset=True) == ["npix_all", "sink_mean"]
    assert masks.select_features(names, exclude=["npix"]) == names[1:]


def plain_pieces(y, depth=5):
    """A regression tree over row numbers by trying every cut."""
    out = np.full(len(y), y.mean() if len(y) else 0.0)
    if depth and len(y) > 1:
        loss = lambda v: ((v - v.mean()) ** 2).sum()
        cuts = [loss(y[:k]) + loss(y[k:]) for k in range(1, len(y))]
        if loss(y) - min(cuts) > 1e-12:
            k = int(np.argmin(cuts)) + 1
            out[:k], out[k:] = plain_pieces(y[:k], depth - 1), plain_pieces(y[k:], depth - 1)
    return out


def test_pieces_against_trying_every_cut():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 40, 120):
        y = np.repeat(r.normal(size=n // 5 + 1), 5)[:n] + r.normal(scale=0.01, size=n)
        assert np.allclose(signal.piecewise(y), plain_pieces(y))


def test_starts_and_stops_against_looking_at_each_row():
    r = np.random.default_rng(3)
    for _ in range(200):
        parts = [np.full(int(r.integers(1, 60)), 0.0) if k % 2 == 0 else np.full(int(r.integers(1, 60)), float(r.uniform(2, 9))) for k in range(int(r.integers(1, 7)))]
        angle = np.concatenate(([0.0], np.cumsum(np.concatenate(parts)))) % 360
        still = np.abs(signal.piecewise(np.diff(np.sin(np.radians(angle))))) < 1e-4
        start = next((i - 1 for i in range(15, len(still) - 14) if still[i - 15 : i].all() and not still[i : i + 15].any()), 0)
        stop = next((i - 1 for i in range(15, len(still) - 14) if not still[i - 15 : i].any() and still[i : i + 15].all()), len(angle) - 1)
        assert signal.start_and_stop(angle) == (start, stop)


def test_zero_runs():
    r = np.random.default_rng(4)
    for _ in range(100):
        x = r.integers(0, 2, int(r.integers(0, 40)))
        want = [len(g) for g in "".join("z" if v == 0 else " " for v in x).split()]
        assert signal.zero_runs(x).tolist() == want
    flats = np.repeat([5.0, 1, 5, 1, 5, 1, 5], [2, 8, 2, 20, 2, 6, 2]) + np.tile([0.0, 0.0], 21)
    flats[::2][[0, 5, 16]] += 1  # pairs that differ cut the runs
    assert signal.series_features(flats)["n_flat"] >= 1


def test_ridges_find_peaks():
    t = np.arange(200.0)
    at = [30, 75, 110, 160]
    x = sum(10 * np.exp(-((t - c) ** 2) / 8) for c in at) + 0.01 * np.sin(t)
    found = signal.cwt_peaks(x)
    assert all(np.abs(found - c).min() <= 1 for c in at)
    strong = [p for p in found if x[p] > 1]
    assert len(strong) == len(at)
    assert signal.cwt_peaks(np.zeros(2)).size == 0


def test_degrouse_of_db2_keeps_what_lies_across_rows():
    rows, cols = np.mgrid[0:20, 0:64]
    stripes = np.where(cols % 2 == 0, 1.0, -1.0)
    smooth = rows * 0.5
    out = signal.degrouse(smooth + stripes, "db2", 2)
    assert np.abs(out[4:-4, 8:-8] - smooth[4:-4, 8:-8]).max() < 0.2
    assert np.allclose(signal.degrouse(smooth, "haar", 2), smooth)


def test_dead_current_falls_back_on_the_angle(spark):
    rows = []
    for i in range(300):
        turning = (i - 60) * 4.0 if 60 <= i < 220 else 0.0 if i < 60 else 160 * 4.0
        rows += [("dead", i, 0.0 if i % 2 else None, turning % 360), ("live", i, 1.0 if i > 10 else 0.0, 0.0)]
    df = spark.createDataFrame(rows, "run string, bin long, current double, rho double")
    kept = masks.moving(df, "current", ["run"], "rho", "bin")
    start, stop = signal.start_and_stop(np.array([r[3] for r in rows if r[0] == "dead"]))
    assert (start, stop) != (0, 299) and sorted(r.bin for r in kept.where("run = 'dead'").collect()) == list(range(start, stop))
    assert kept.where("run = 'live'").count() == 289 and kept.columns == df.columns
    assert masks.moving(df, "current", ["run"]).count() == 589


def test_outliers_of_a_continuous_label_go(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(r.normal()), float(r.normal())) for i in range(400)]
    rows[50] = (50, 0.0, 900.0)
    rows[60] = (60, float("nan"), 0.0)
    df = spark.createDataFrame(rows, "i long, x double, y double")
    kept = {k.i for k in masks.trainable_rows(df, ["x"], "y", ["i"]).collect()}
    assert 50 not in kept and 60 not in kept and len(kept) > 350
    few = df.withColumn("y", F.when(F.col("i") == 50, 900.0).otherwise((F.col("i") % 3).cast("double")))
    assert masks.trainable_rows(few, ["x"], "y", ["i"]).count() == 399


def test_pieces_of_a_run_give_the_same_windows(spark):
    from spokeflow.functions.windows import gaussian, reach, running
    from spokeflow.plans.spread import in_pieces, owned

    rows = [(g, int(i), float(v)) for g, n in (("a", 500), ("b", 3), (None, 40)) for i, v in enumerate(np.random.default_rng(n).normal(size=n))]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(7)
    want = {(r.g, r.i): (r.m, r.s) for r in df.withColumns({"m": running(F.col("x"), "mean", ["g"], ["i"], 20, 5), "s": gaussian(F.col("x"), 2.0, ["g"], ["i"])}).collect()}
    pieces = in_pieces(df, ["g"], ["i"], 20, reach(2.0), rows=32)
    assert pieces.select("g", "_piece").distinct().count() == 16 + 1 + 2
    by = ["g", "_piece"], ["_rn"]
    out = owned(pieces.withColumns({"m": running(F.col("x"), "mean", *by, 20, 5), "s": gaussian(F.col("x"), 2.0, *by, number=F.col("_rn"), count=F.col("_n"))}))
    assert set(out.columns) == {"g", "i", "x", "m", "s"}
    got = {(r.g, r.i): (r.m, r.s) for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_dbscan_by_small_blocks_and_in_many_dimensions(spark):
    r = np.random.default_rng(1)
    for x, eps in ((np.concatenate([r.normal(0, 0.3, (60, 3)), r.normal(4, 0.5, (60, 3)), r.uniform(-9, 9, (60, 3))]), 0.8), (r.normal(0, 0.3, (150, 40)), 2.4)):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        near = d <= eps
        df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
        counts = {g.id: g.n for g in dbscan.neighbour_counts(df, eps, block=16).collect()}
        assert counts == {i * 3: int(n) - 1 for i, n in enumerate(near.sum(1)) if n > 1}
        pairs = {(g.a // 3, g.b // 3) for g in dbscan.neighbour_pairs(df, eps, block=16).collect()}
        assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i != j}
        core = near.sum(1) >= 5
        lead = list(range(len(x)))

        def find(i):
            while lead[i] != i:
                i = lead[i]
            return i

        for i, j in zip(*np.nonzero(near & core[:, None] & core[None])):
            a, b = find(int(i)), find(int(j))
            lead[max(a, b)] = min(a, b)
        want = {i * 3: (3 * find(i) if core[i] else min((3 * find(int(j)) for j in np.flatnonzero(near[i] & core)), default=None), bool(core[i])) for i in range(len(x))}
        assert {g.id: (g.cluster, g.core) for g in dbscan.dbscan(df, eps, 5, block=16).collect()} == want
    alone = spark.createDataFrame([(i, [i * 10.0]) for i in range(5)], "id long, features array<double>")
    assert {(g.cluster, g.core) for g in dbscan.dbscan(alone, 1.0, 2).collect()} == {(None, False)}
    assert dbscan.dbscan(alone, 1.0, 1).where("cluster = id and core").count() == 5
    assert dbscan.dbscan(alone.limit(0), 1.0, 2).count() == 0


def test_queries_of_nearest_neighbours_in_blocks(spark):
    x = np.random.default_rng(7).normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    rows = lambda **k: sorted(map(tuple, dbscan.nearest_neighbours(df, df.where("id % 3 = 0"), 4, **k).collect()))
    assert rows(most_bytes=100) == rows() and len(rows()) == 120


def test_ties_in_time(spark):
    l = spark.createDataFrame([(1, 5.0)], "k int, t double")
    for order in ([("a",), ("b",)], [("b",), ("a",)]):
        r = spark.createDataFrame([(1, 5.0, v) for (v,) in order], "k int, s double, v string")
        assert asof.backward(l, r, ["k"], "t", "s", ["v"]).first().v == "b" and asof.nearest(l, r, ["k"], "t", "s", ["v"]).first().v == "b"


def test_many_versions(spark):
    versions = spark.range(1500).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int") * 2).alias("start"), F.col("id").cast("double").alias("m"))
    df = spark.createDataFrame([(1, "1999-01-01"), (2, "2000-01-01"), (3, "2000-01-06"), (4, None), (5, "2020-01-01")], "id int, d string").withColumn("d", F.col("d").cast("date"))
    many = {r.id: r.m for r in asof.valid_from(df, versions, "d", "start", ["m"], [-1.0]).collect()}
    assert many == {1: -1.0, 2: 0.0, 3: 2.0, 4: -1.0, 5: 1499.0}


def test_forest_options():
    assert [forest.feature_count(o, 64) for o in ("AUTO", "SQRT", "LOG2", "NONE")] == [8, 8, 6, 64]
    x = np.random.default_rng(0).normal(size=(200, 16))
    y = (x[:, 3] > 0).astype(int)
    whole = forest.grow(x, y, 2, max_depth=1, max_features="none", bootstrap=False)
    assert whole.feature[0] == 3 and (forest.predict([whole], x, 2) == y).all()


def test_trees_learn(spark):
    from spokeflow.operators import evaluate, ml

    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (900, 3))
    y = x[:, 0] * 2 + (x[:, 1] > 0)
    kind = (x[:, 0] > 0.3).astype(int) + (x[:, 0] > -0.3)
    df = spark.createDataFrame([(i, i % 12, *map(float, v), float(t), float(k)) for i, (v, t, k) in enumerate(zip(x, y, kind))], "id long, run int, a double, b double, c double, y double, kind double")
    out = ml.out_of_fold(df, ml.regressor(["a", "b", "c"], "y", trees=25, leaf=5), "run", folds=3)
    assert out.count() == 900 and evaluate.errors(out, "y", "prediction").first().rmse < 0.35 * y.std()
    model = ml.boosted_classifier(["a", "b", "c"], "kind", trees=5, leaf=5).fit(df.where("id < 600"))
    assert evaluate.errors(model.transform(df.where("id >= 600")), "kind", "prediction").first().accuracy > 0.93
    forests = ml.out_of_stratum(df, ml.forest_classifier(["a", "b", "c"], "kind", trees=8), "kind", 3, [1, 2])
    assert forests.count() == 1800 and evaluate.errors(forests, "kind", "prediction").first().accuracy > 0.93
    folds = ml.stratified_folds(df, "kind").groupBy("kind", "fold").count().collect()
    for k in {f.kind for f in folds}:
        n = [f["count"] for f in folds if f.kind == k]
        assert len(n) == 3 and max(n) - min(n) <= 1
    assert ml.eliminated(df, lambda f: ml.forest_classifier(f, "kind", trees=8, depth=5), ["a", "b", "c"], 1) == ["a"]


def test_named_features_and_categories(spark):
    catalogue = assemble.feature_catalogue()
    assert "area1_lag-4_mean_grouser" in catalogue["image"] and "amplitude_10550.1" in catalogue["hydration"] and assemble.category("unwrap_std0_nongrouser") == "unwrap" and assemble.category("x") is None
    px = spark.createDataFrame([(0, t, r, c, float((t * 7 + r * 3 + c) % 11), (t * 2) % 96) for t in range(6) for r in range(2) for c in range(96)], "run int, t int, row int, col int, p double, hub int")
    strips = frames.unwrapped(px, ["run", "t", "hub"], "hub", [0, 1], "grouser_noamb")
    assert {r.hub for r in strips.select("hub").distinct().collect()} == {6, 8, 10}
    wide = series.named_features(series.image_features(strips.drop("hub"), ["run"], "t"), ["run", "t"], signal.PROPERTIES, "grouser", [0, 1], 1)
    assert wide.count() == 3 and set(wide.columns) - {"run", "t"} <= set(catalogue["image"])
    quirk = frames.unwrapped(px, ["run", "t", "hub"], "hub", [0], "all", as_published=True)
    assert quirk.where("t = 0").first().hub == 16


def test_values_carried_over_ranges(spark):
    from pyspark.sql import Window

    from spokeflow.plans.spread import filled, summed

    r = np.random.default_rng(11)
    rows = [(g, int(i), float(v) if v > 0.8 else None, float(v)) for g, n in (("a", 900), ("b", 4), (None, 60)) for i, v in enumerate(r.uniform(size=n))]
    df = spark.createDataFrame(rows, "g string, i int, x double, v double").repartition(6)
    out = summed(filled(df, ["g"], ["i"], back=(F.col("x"), False), ahead=(F.col("x"), True)), ["g"], ["i"], F.col("v"), "total")
    assert set(out.columns) == {"g", "i", "x", "v", "back", "ahead", "total"}
    w = Window.partitionBy("g").orderBy("i")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.withColumns({"back": F.last("x", True).over(up), "ahead": F.first("x", True).over(down), "total": F.sum("v").over(up)})
    rows_of = lambda d: {(x.g, x.i): (x.back, x.ahead, round(x.total, 9)) for x in d.collect()}
    assert rows_of(out) == rows_of(want)


def plain_euler(mask):
    """Regions less holes, by counting corners, edges and faces of pixels joined by their sides (4-neighbours)."""
    m = np.pad(mask, 1).astype(int)
    pixels = m.sum()
    sides = (m[1:] & m[:-1]).sum() + (m[:, 1:] & m[:, :-1]).sum()
    blocks = (m[1:, 1:] & m[:-1, 1:] & m[1:, :-1] & m[:-1, :-1]).sum()
    return int(pixels - sides + blocks)


def test_region_properties_against_their_definitions():
    r = np.random.default_rng(12)
    for _ in range(60):
        image = r.uniform(size=(9, 14))
        found = signal.label(image > 0.45)
        for k in range(1, found.max() + 1):
            mask = found == k
            p = dict(zip(signal.PROPERTIES, signal.region(mask, image)))
            y, x = np.nonzero(mask)
            n = len(y)
            spread = np.cov(np.vstack([y, x]), bias=True) + np.eye(2) / 12 if n > 1 else np.eye(2) / 12
            low, high = np.linalg.eigvalsh(spread)
            assert p["area"] == n and np.isclose(p["mean_intensity"], image[mask].mean()) and p["max_intensity"] == image[mask].max() and p["min_intensity"] == image[mask].min()
            assert np.isclose(p["major_axis_length"], 4 * np.sqrt(high)) and np.isclose(p["minor_axis_length"], 4 * np.sqrt(max(low, 0)))
            assert np.isclose(p["eccentricity"], np.sqrt(1 - max(low, 0) / high)) and np.isclose(p["equivalent_diameter"], np.sqrt(4 * n / np.pi))
            assert np.isclose(p["extent"], n / ((np.ptp(y) + 1) * (np.ptp(x) + 1))) and p["euler_number"] == plain_euler(mask)
            assert n <= p["filled_area"] and n <= p["convex_area"] <= (np.ptp(y) + 1) * (np.ptp(x) + 1) and np.isclose(p["solidity"], n / p["convex_area"])
