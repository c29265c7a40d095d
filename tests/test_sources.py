import numpy as np

from spokeflow.sources import readers, writers


def test_pressure_round_trip(spark, tmp_path):
    p = tmp_path / "a.dat"
    head = "amp\t" + "\t".join(map(str, range(1, 5)))
    p.write_text("# junk\n" + "".join(f"timestamp=2019/10/31 12:00:0{i}.500\n{head}\n" + "".join(f"{r}\t" + "\t".join(str(r * 10 + c + i) for c in range(4)) + "\n" for r in (1, 2)) for i in range(3)))
    cells = readers.pressure_text(spark, f"file://{p}", columns=4)
    assert cells.count() == 3 * 2 * 4 and cells.select("frame").distinct().count() == 3
    top = cells.where("frame = 0 and row = 1 and col = 0").first()
    assert top.p == 10.0
    lines = writers.pressure_lines(cells, ["frame"], columns=4, rows=2)
    writers.write_pressure(lines, f"file://{tmp_path}/out")
    again = readers.pressure_text(spark, f"file://{tmp_path}/out", columns=4)
    assert again.agg({"p": "sum"}).first()[0] == cells.agg({"p": "sum"}).first()[0]


def test_impedance(spark, tmp_path):
    p = tmp_path / "a.idf"
    p.write_text("Peaks=1\ntiming=2\nstarttime=10/31/2019 1:30:00 PM\ntiming.time[0]=0.5\ntiming.time[1]=1.5\nprimary_data\n3\n2\n1.0 2.0 48\n3.0 4.0 554\n")
    r = readers.impedance(spark, f"file://{p}").first()
    assert r.peaks and r.timesteps == 2 and r.times == [0.5, 1.5] and [x.freq for x in r.primary] == [48.0, 554.0] and r.pretreat is None
    assert r.exp_time == 1572528600.0


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "run_wheel.npy", np.array([[0.0, 5.0], [1.0, 6.0]]))
    np.save(tmp_path / "run_cart.npy", np.array([[0.0, 1, 2, 3, 4]]))
    long = readers.sensor_stream(readers.arrays(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.channel, r.ts, r.value) for r in long) == [("current", 0.0, 3.0), ("rho", 0.0, 5.0), ("rho", 1.0, 6.0), ("sink", 0.0, 2.0)]


def test_feature_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    (tmp_path / "b.yaml").write_text("features:\n  x: 1\n  y: 0\n")
    assert readers.feature_list(spark, f"file://{tmp_path}/a.txt") == ["x", "y"]
    assert readers.feature_list(spark, f"file://{tmp_path}/b.yaml") == ["x"]


def test_discovery(spark, tmp_path):
    run = "x_lab_terrain_flatlvl_vel_1_EISfreqsweep_2_grousers_4_loading_none_material_mm_hydra_0_pretreat_0_date_20190205_rep_01"
    (tmp_path / run).mkdir()
    (tmp_path / run / "wheel.npy").write_bytes(b"x")
    r = readers.discover(spark, f"file://{tmp_path}", "*.npy").first()
    assert r.run == run and r.terrain == "flatlvl" and r.date == "20190205"


def test_points_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2\n3 4\n")
    assert [r.features for r in readers.points_text(spark, f"file://{tmp_path}/p.txt").orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_lifecycle(spark):
    from spokeflow.plans import lifecycle

    rows = []
    for i in range(200):
        t = i * 0.05
        rows += [("r", "rho", t, (i * 3.0) % 360), ("r", "current", t, 0.0 if i < 20 else 1.0), ("r", "slip", t, 0.1)]
    samples = spark.createDataFrame(rows, "run_id string, channel string, ts double, value double")
    binned = lifecycle.unify(samples)
    assert {"rho", "slip", "sink", "current", "imu_bin"} <= set(binned.columns)
    r = np.random.default_rng(0)
    px = [("r", int(b), y, x, float(r.exponential())) for b in range(0, 99, 9) for y in range(4) for x in range(96)]
    out = lifecycle.featurise(binned, spark.createDataFrame(px, "run_id string, bin long, row int, col int, p double"))
    assert out.where("npix_all is not null").count() > 0 and "sink_slope" in out.columns


def test_jdbc_tables(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    stats = spark.createDataFrame([(i % 4, str(i % 12 * 100 if i % 5 else i % 12), float(i % 3 == 0)) for i in range(60)], "param_id int, feature string, stat double")
    stats.write.format("jdbc").option("url", url).option("dbtable", "stats").option("driver", driver).option("createTableColumnTypes", "feature VARCHAR(64)").save()
    back = readers.jdbc(spark, url, "stats", "param_id", 0, 4, 2, driver=driver)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, stats.collect()))
    short = readers.jdbc(spark, url, '(SELECT "feature", "stat" FROM stats WHERE LENGTH("feature") < 4) s', driver=driver)
    assert short.count() == stats.where("length(feature) < 4").count() > 0


def test_nested_notes(spark, tmp_path):
    notes = spark.createDataFrame([(1, "slip", "none"), (2, "hydration", "wet")], "run int, type string, notes string")
    marks = spark.createDataFrame([(1, "rock", "start", 5.0), (1, "rock", "start", 2.0), (1, "rock", "end", 3.0), (1, "dune", "start", 7.0), (3, "rock", "start", 1.0), (1, "rock", "note", 9.0)], "run int, kind string, sign string, ts double")
    writers.write_notes(writers.run_notes(notes, marks, "run", "kind", "ts"), f"file://{tmp_path}/notes")
    back = {r.run: r for r in spark.read.schema("run int, type string, notes string, run_features_time map<string,array<double>>").json(f"file://{tmp_path}/notes").collect()}
    assert back[1].run_features_time == {"rock_start": [2.0, 5.0], "rock_end": [3.0], "dune_start": [7.0], "dune_end": []} and back[2].run_features_time is None and set(back) == {1, 2}
