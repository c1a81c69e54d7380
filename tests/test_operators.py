import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from jetlake.constants import CODES
from jetlake.functions import kinematics as kin
from jetlake.functions import text
from jetlake.operators import clustering, events as ev, grouping, multiplicity, results as res
from jetlake.operators import scan, selection, substructure, trials
from jetlake.plans import catalog, series
from test_kernel import random_events


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Selection

def test_exclusive_selection_counts_and_errors(spark, make_events):
    four = random_events(2, [4, 4, 6])
    clustered = clustering.cluster(make_events(four), "EEKt", 4.0, 1.0)
    for k in range(0, 5):
        sizes = selection.select_jets(clustered, njets=k).select(F.size("jets")).collect()
        assert [s[0] for s in sizes] == [k] * 3
    with pytest.raises(Exception, match="5 exclusive jets"):
        selection.select_jets(clustered, njets=5).collect()
    for bad in ({}, {"ptmin": 1.0, "njets": 2}, {"njets": -1}):
        with pytest.raises(ValueError):
            selection.select_jets(clustered, **bad)


def test_dcut_agrees_with_the_number_left(spark, make_events):
    event = random_events(6, [12])[0]
    steps = brute.cluster(event, R=0.8, p=1.0)
    clustered = clustering.cluster(make_events([event]), "Kt", 0.8)
    highest = 0.0
    for n, step in enumerate(steps):
        highest = max(highest, step[2])
        nxt = next((m for m, s in enumerate(steps[n + 1:], n + 1) if s[2] > highest), len(steps))
        got = selection.select_jets(clustered, dcut=highest * (1 + 1e-9)).select(F.size("jets")).first()[0]
        assert got == len(event) - nxt


def test_sequence_layout(spark, make_events):
    event = random_events(7, [10])[0]
    row = clustering.cluster(make_events([event, []]), R=1.0).orderBy("event").collect()
    history, jets = row[0].history, row[0].jets
    assert len(history) == 20 and row[1].history == [] and row[1].jets == [] and row[1].membership == []
    assert all(h.max_dij <= n.max_dij for h, n in zip(history, history[1:]))
    for number, h in enumerate(history):
        for parent in (h.parent1, h.parent2):
            if parent >= 0:
                assert history[parent].child == number
        if h.parent2 >= 0:
            a, b = jets[history[h.parent1].jet], jets[history[h.parent2].jet]
            assert jets[h.jet].px == pytest.approx(a.px + b.px)
    # Members of each beam jet add up to it.
    beams = [h for h in history if h.parent2 == -1]
    for number, h in enumerate(beams):
        jet = jets[history[h.parent1].jet]
        own = [event[i] for i, m in enumerate(row[0].membership) if m == number]
        assert np.sum(own, axis=0)[0] == pytest.approx(jet.px)


def test_short_and_long_way_agree(spark, make_events):
    events = make_events(random_events(8, [30, 0, 55, 1]))
    short = selection.jet_rows(clustering.inclusive_jets(events, "Kt", 0.6, ptmin=3.0))
    long = selection.jet_rows(selection.select_jets(clustering.cluster(events, "Kt", 0.6), ptmin=3.0))
    assert rows(short) == rows(long) and short.count() > 10


def test_jet_documents_keep_or_drop_empty_events(spark, make_events):
    found = clustering.inclusive_jets(make_events([[(9, 0, 0, 9)], [(1, 0, 0, 1)]]), ptmin=5.0)
    assert [r.jetid for r in selection.jet_documents(found).orderBy("jetid").collect()] == [0, 1]
    assert [r.jetid for r in selection.jet_documents(found, keep_empty=False).collect()] == [0]


def test_parameter_grid():
    grid = clustering.parameter_grid(["AntiKt", "EEKt", "Durham"], [0.4, 1.0], [-1.0, 1.0])
    assert len(grid) == 2 + 4 + 1
    assert {g["p"] for g in grid if g["algorithm"] == "AntiKt"} == {-1.0}


# Kinematics

def test_kinematics_of_edge_cases(spark):
    cases = [(3.0, 4.0, 0.0, 6.0), (0.0, 0.0, 7.0, 7.0), (0.0, 0.0, -7.0, 7.0), (1.0, -1e-20, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(cases, "px double, py double, pz double, e double")
    args = [F.col(c) for c in df.columns]
    got = df.select(kin.pt(*args[:2]), kin.rapidity(*args), kin.phi(*args[:2]), kin.mass(*args)).collect()
    assert got[0][0] == 5.0 and got[0][3] == pytest.approx(math.sqrt(11))
    assert got[1][1] == 1e5 + 7 and got[2][1] == -1e5 - 7
    assert got[3][2] == 0.0 and got[4][1] == 1e5
    assert brute.rap(cases[0]) == pytest.approx(got[0][1])


# Substructure

def test_soft_wide_branch_is_dropped(spark, make_events):
    def massless(pt, y, f):
        return (pt * math.cos(f), pt * math.sin(f), pt * math.sinh(y), pt * math.cosh(y))
    hard = [massless(100, 0, 0.0), massless(80, 0.05, 0.02)]
    event = [*hard, massless(1.0, 0.6, 0.5)]
    clustered = substructure.substructure_input(make_events([event]), 1.0)
    core = np.sum(hard, axis=0)
    core_pt = math.hypot(core[0], core[1])
    for method in ("soft_drop", "mass_drop", "filter", "trim"):
        params = {"n_hardest": 1} if method == "filter" else {}
        got = substructure.measured(substructure.groom(clustered, method, **params)).collect()
        assert len(got) == 1
        if method != "mass_drop":
            assert got[0].pt == pytest.approx(core_pt), method
    single = substructure.substructure_input(make_events([[massless(10, 0, 0)]]), 1.0)
    assert substructure.measured(substructure.groom(single, "soft_drop")).first().pt is None
    with pytest.raises(ValueError):
        substructure.groom(clustered, "prune")


def test_constituents_either_way(spark, make_events):
    events = make_events(random_events(12, [40, 0, 1, 25]))
    long = substructure.constituents(substructure.substructure_input(events, 1.0), ptmin=10.0)
    short = clustering.jets_with_constituents(events, "CA", 1.0, ptmin=10.0)
    assert rows(long) == rows(short) and long.count() > 5


def test_mass_drop_finds_two_prongs(spark, make_events):
    def massless(pt, y, f):
        return (pt * math.cos(f), pt * math.sin(f), pt * math.sinh(y), pt * math.cosh(y))
    event = [massless(50, 0.0, 0.0), massless(48, 0.0, 0.8), massless(0.5, 0.9, 0.4)]
    clustered = substructure.substructure_input(make_events([event]), 1.5)
    got = substructure.measured(substructure.groom(clustered, "mass_drop")).first()
    whole = np.sum(event[:2], axis=0)
    assert got.pt == pytest.approx(math.hypot(whole[0], whole[1]))


# Events

def test_event_window_and_positions(spark):
    data = [(f, e) for f, n in (("a", 9), ("b", 3)) for e in range(0, 2 * n, 2)]
    df = spark.createDataFrame(data, "file string, event bigint")
    kept = rows(ev.event_window(df, max_events=5, skip_events=2))
    assert kept == [("a", 4), ("a", 6), ("a", 8), ("b", 4)]
    assert rows(ev.event_window(df, max_events=5, skip_events=2, range_rows=3)) == kept
    assert rows(ev.event_window(df, skip_events=3, range_rows=1)) == [("a", e) for e in (10, 12, 14, 16, 6, 8)]
    assert rows(ev.event_window(df, max_events=0)) == [] and ev.event_window(df).count() == 12
    assert len(rows(ev.event_window(df, max_events=-1, skip_events=1))) == 10
    numbered = rows(ev.event_positions(df, range_rows=4))
    assert sorted(numbered) == [(f, e, e // 2 + 1) for f, e in sorted(data)]
    with pytest.raises(ValueError):
        ev.event_window(df, skip_events=-1)
    with pytest.raises(ValueError):
        ev.require_events(df.where("event > 100"))


def test_per_event_function(spark, make_events):
    counts = ev.map_events(
        make_events(random_events(1, [3, 5])),
        lambda frames: (f.assign(n=f.particles.map(len))[["event", "n"]] for f in frames), "event bigint, n int")
    assert rows(counts) == [(0, 3), (1, 5)]


def test_charged_counts(spark):
    df = spark.createDataFrame(
        [("f", 1, [(1, 211), (1, 22), (2, 211), (1, -11)]), ("f", 2, [])],
        "file string, event bigint, particles array<struct<status:int,pdgid:int>>")
    assert rows(multiplicity.charged_counts(df)) == [("f", 1, 2), ("f", 2, 0)]
    assert rows(multiplicity.manifest_rows(df)) == [("f", 2.0)]


def test_positions_of_sparse_numbers(spark):
    """One file of numbers that differ by up to 2^40, another of few: ranks in many ranges, none of them large."""
    number = F.col("id") * F.col("id") * F.col("id") * 1000 - 5
    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("file"), number.alias("event"))
    ranged, _, starts = ev._numbers(df, ["file"], 500)
    sizes = [r["count"] for r in ranged.where("file = 'a'").groupBy("_range").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 500 and starts.count() == len(sizes) + 1
    want = sorted((file, event) for file, event in ((r.file, r.event) for r in df.collect()))
    places = {}
    found = {(r.file, r.event): r.position for r in ev.event_positions(df, range_rows=500).collect()}
    for file, event in want:
        places[file] = places.get(file, 0) + 1
        assert found[file, event] == places[file]
    window = ev.event_window(df, max_events=1000, skip_events=990, range_rows=500)
    for file in ("a", "b"):
        own = [e for f, e in want if f == file]
        assert sorted(r.event for r in window.where(F.col("file") == file).collect()) == own[990:1000]


# Groups

def test_quantiles_of_large_and_skewed_groups(spark):
    """Half the rows in one group, repeated values, outliers, NULLs and NULL keys."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(
            (F.col("id") % 7).cast("string")).alias("k"),
        F.when(F.col("id") % 11 == 0, None).otherwise(
            F.pow(F.lit(1.7), (F.hash("id") % 40).cast("double")) + F.col("id") % 3).alias("x"),
        F.when(F.col("id") % 2 == 1, F.lit(5.0)).alias("y"))
    probs = [0.25, 0.5, 0.75, 0.99]
    want = grouping.quantiles(df, ["k"], ["x", "y"], probs)
    for cell_rows in (1, 2000):
        got = grouping.quantiles(df, ["k"], ["x", "y"], probs, extra=[F.max("x").alias("top")], cell_rows=cell_rows)
        assert rows(catalog.rounded(want, 9)) == rows(catalog.rounded(got.select(*want.columns), 9))
        assert rows(got.select("k", "top")) == rows(df.groupBy("k").agg(F.max("x")))
    whole = grouping.quantiles(df, [], ["x"], [0.5], cell_rows=500).first()
    assert whole.x_q0 == df.agg(F.median("x")).first()[0]
    # Columns under the names used inside.
    odd = df.withColumnsRenamed({"k": "cell", "x": "v", "y": "rank"})
    again = grouping.quantiles(odd, ["cell"], ["v", "rank"], [0.5], cell_rows=50)
    assert rows(again.select("cell", "v_q0")) == rows(want.select("k", "x_q1"))
    assert grouping.quantiles(df.limit(0), ["k"], ["x"], probs, cell_rows=0).count() == 0


def test_quantiles_of_one_group_in_many_tasks(spark):
    """Five million values of one group: a third equal, the others close together."""
    df = spark.range(0, 5_000_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.25)).otherwise(F.pmod(F.hash("id"), F.lit(1_000_003)) * 1e-9 + 100).alias("x"))
    probs = [0.1, 0.5, 0.999]
    got = grouping.quantiles(df, [], ["x"], probs).first()
    want = np.quantile(df.toPandas()["x"].to_numpy(), probs)
    assert [got[f"x_q{i}"] for i in range(len(probs))] == pytest.approx(want.tolist(), abs=1e-13) and got["x_n"] == 5_000_000


def test_many_small_groups_are_counted_first(spark):
    """Many groups of few rows: no task takes the values of all groups, and rows that cannot be first are not sorted."""
    df = spark.range(6_000).select(
        F.when(F.col("id") % 60 != 7, F.col("id") % 60).alias("k"), F.when(F.col("id") % 11 != 0, F.hash("id") % 1000 / 7).alias("x"),
        F.struct(F.when(F.col("id") % 13 != 0, F.hash("id") % 3).alias("a"), (F.hash("id") % 1000 / 3).alias("b"), "id").alias("o"),
        F.when(F.col("id") % 4 == 1, F.col("id").cast("string")).alias("p"), F.when(F.col("id") % 60 > 30, F.col("id")).alias("q"),
        F.lit(None).cast("string").alias("never"))
    want = grouping.quantiles(df, ["k"], ["x"], [0.5, 0.9])
    got = grouping.quantiles(df, ["k"], ["x"], [0.5, 0.9], cell_rows=200)
    assert "percentile" in want._jdf.queryExecution().toString() and "percentile" not in got._jdf.queryExecution().toString()
    assert rows(got.select(*want.columns)) == rows(want)
    first = grouping.first_values(df, ["k"], ["p", "q", "never"], "o", cell_rows=1)
    assert rows(first) == rows(df.groupBy("k").agg(*[grouping.first_known(c, F.col("o")).alias(c) for c in ("p", "q", "never")]).where("p is not null or q is not null"))


def test_ordered_bits(spark):
    """The bits of a double's size, whatever it is, and back."""
    pick = np.random.default_rng(2)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, float("inf"), float("-inf")]
    values += [float(np.nextafter(2.0**k, 0)) for k in range(-1070, 1024, 7)] + [2.0**k for k in range(-1074, 1024, 7)]
    values += [v for v in pick.integers(-2**63, 2**63 - 1, 3000).view(np.float64).tolist() if v == v]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "x double").withColumn(
        "bits", grouping.ordered_bits(F.col("x"))).withColumn("back", grouping.from_ordered_bits(F.col("bits")))
    found = df.collect()
    for row in found[:-1]:
        size = int(np.float64(abs(row.x)).view(np.int64))
        assert row.bits == (-size if row.x < 0 else size) and row.back == row.x
    assert found[-1].bits > max(r.bits for r in found[:-1]) and np.isnan(found[-1].back)


def test_wide_keys_are_kept_apart(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, "a", 2.0), ("a", "b", 3.0), ("a", None, 5.0)],
                               "p string, q string, x double")
    got = grouping.quantiles(df, ["p", "q"], ["x"], [0.5])
    assert rows(got.select("p", "q", "x_q0")) == rows(df.groupBy("p", "q").agg(F.median("x")))


def test_checked_broadcast_leaves_large_tables_alone(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    plan = lambda d: spark.range(5).withColumnRenamed("id", "k").join(d, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(grouping.checked_broadcast(small))
    assert "strategy=broadcast" not in plan(grouping.checked_broadcast(small, max_rows=5))


def test_prefix_min_over_spans(spark):
    values = [5, 7, 3, 3, 9, 2, 2, 8, 1, 4]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v int")
    got = grouping.prefix_min(df, "i", "v", span_bits=1).orderBy("i").collect()
    assert [r.prefix_min for r in got] == list(np.minimum.accumulate(values))
    assert [r.prefix_index for r in got] == [0, 0, 2, 2, 2, 5, 5, 5, 8, 8]


def test_prefix_min_in_levels(spark):
    """Unkeyed and keyed series over four levels of blocks, with negative numbers, gaps and NULLs."""
    pick = np.random.default_rng(4)
    index = np.unique(pick.integers(-3000, 5000, 1500))
    values = [None if v == 0 else float(v) for v in pick.integers(0, 400, len(index))]
    df = spark.createDataFrame([(int(i), int(i) % 3, v) for i, v in zip(index, values)], "i bigint, k int, v double")
    for keys in ([], ["k"]):
        got = {r.i: (r.prefix_min, r.prefix_index) for r in grouping.prefix_min(df, "i", "v", keys, span_bits=3).collect()}
        best = {}
        for i, v in zip(index.tolist(), values):
            k = i % 3 if keys else 0
            if v is not None and (k not in best or v < best[k][0]):
                best[k] = v, i
            assert got[i] == best.get(k, (None, None))
    plan = grouping.prefix_min(df, "i", "v", span_bits=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_parent" in line or "_block" in line for line in plan.splitlines() if "Window [" in line)



def test_ordinals_with_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    assert rows(grouping.ordinals(df, ["k"], "n")) == [("a", 1), ("b", 2), ("b", 2), (None, 3)]


def test_many_ordinals_are_numbered_in_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = grouping.ordinals(df, ["k"], "n", max_rows=100)
    assert got.where("n <> k + 1").count() == 0 and got.count() == 3000


# Trials

def test_trial_statistics_of_small_groups(spark):
    df = spark.createDataFrame([("one", 4.0)] + [("same", 2.0)] * 5 + [("far", float(x)) for x in (1, 2, 3, 4, 1000)],
                               "w string, time_us double")
    stats = {r.w: r for r in trials.trial_stats(df, ["w"]).collect()}
    assert stats["one"].std == 0.0 and stats["one"].iqr == 0.0 and stats["same"].iqr == 0.0
    kept = trials.reject_outliers(df, ["w"])
    assert kept.where("w = 'far'").count() == 4 and kept.where("w = 'same'").count() == 5
    bins = trials.trial_histogram(df, ["w"]).collect()
    assert sum(b["count"] for b in bins) == df.count() and max(b.n_bins for b in bins) <= 80
    assert [b.n_bins for b in bins if b.w == "same"] == [1]
    outside = trials.result_table(trials.trial_stats(df, ["w"]), external=True).first()
    assert outside.time_per_event_min is not None and outside.time_per_event_mean is None


def test_best_sample_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("r", 2, 1.0, 7), ("r", 1, 1.0, 8), ("r", 3, 2.0, 9)],
                               "run string, sample_index int, wall_time_seconds double, bytes int")
    assert rows(trials.best_sample(df, ["run"], columns=["bytes"])) == [("r", 1, 1.0, 8)]


def test_no_time_has_no_gc_share(spark):
    df = spark.createDataFrame([(0.0, 10, 5, 0.0), (2.0, 10, 5, 0.5)],
                               "wall_time_seconds double, measured_events int, allocated_bytes_total bigint, gc_time_seconds double")
    got = trials.sample_metrics(df).collect()
    assert got[0].gc_fraction == 0.0 and got[0].events_per_second == math.inf and got[1].gc_fraction == 0.25


# Tables

def result_rows(spark, data):
    return spark.createDataFrame(data, "code string, algorithm string, strategy string, radius double, power double, "
                                       "threads int, time_per_event double, File string, schedule string")


def test_scan_rules(spark):
    base = ("AntiKt", "N2Plain", 0.4, -1.0)
    data = [("Fastjet", *base, 1, 100.0, "f", None), ("Fastjet", *base, 1, 300.0, "f", "dynamic"),
            ("Fastjet", *base, 2, 50.0, "f", ""), (CODES[0], *base, 2, 10.0, "f", None)]
    table = result_rows(spark, data).withColumn("_order", F.monotonically_increasing_id())
    one = scan.csv_rows(table)
    assert {(r.code, r.schedule, r.backend) for r in one.collect()} == {
        ("Fastjet", "static", "C++"), ("Fastjet", "dynamic", "C++"), (CODES[0], "julia_threads_default", "Julia")}
    merged = scan.merge_scan(one)
    fast = scan.with_speedup(merged.where("code = 'Fastjet'")).where("threads = 2").first()
    assert fast.baseline_events_per_second_median == pytest.approx((1e4 + 1e6 / 300) / 2)
    assert fast.efficiency_median == pytest.approx(fast.speedup_median / 2)
    with pytest.raises(Exception, match="no 1-thread baseline"):
        scan.with_speedup(merged).collect()
    with pytest.raises(Exception, match="must be positive"):
        scan.csv_rows(table.withColumn("time_per_event", F.lit(-1.0))).collect()
    with pytest.raises(ValueError, match="missing required column"):
        scan.csv_rows(table.drop("threads"))
    with pytest.raises(ValueError, match="input file column"):
        scan.csv_rows(table.drop("File"))


def test_selecting_and_appending(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "code string, n int")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert rows(res.select_rows(df, {"code": "a", "unknown": 3})) == [("a", 1)]
        assert "unknown is not a column name" in str(caught[0].message)
    assert res.select_rows(df, n=[1, 3], code=None).count() == 2
    assert rows(res.drop_rows(df, "code", "a")) == [("b", 2), (None, 3)]
    wide = spark.createDataFrame([("c", 2.5, 0)], "code string, n double, extra int")
    stacked = res.append_results([df, wide])
    assert stacked.columns == ["code", "n"] and dict(stacked.dtypes)["n"] == "double" and stacked.count() == 4
    with pytest.raises(ValueError, match="missing required column"):
        res.append_results([wide, df])
    assert rows(res.decorate(df.limit(1), threads=4)) == [("a", 1, 4)]


def test_lookup_must_match_once(spark):
    df = spark.createDataFrame([("x",), ("y",)], "k string")
    good = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert rows(res.lookup_one(df, good, "k")) == [("x", 1), ("y", 2)]
    for bad in (good.where("k = 'x'"), good.union(good)):
        with pytest.raises(Exception, match="exactly one row"):
            res.lookup_one(df, bad, "k").collect()


def test_ideal_scaling_over_weak_cores(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 18.0), (3, 19.0)], "threads int, event_rate double")
    got = {r.threads: r.perfect for r in res.ideal_scaling(df, strong=2, weak_value=0.1).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: pytest.approx(21.0)}


def test_scan_series_checks(spark):
    df = spark.createDataFrame([(1, 1.0, "d/f.hepmc3", "CA")], "threads int, efficiency_median double, input_file string, algorithm string")
    got = rows(series.scan_series(df, group_by="algorithm"))
    assert got == [("f.hepmc3", "algorithm=CA", 1, 1.0), ("f.hepmc3", "ideal", 1, 1.0)]
    assert series.scan_series(df, group_by="algorithm", split_by="none", ideal=False).first().split == "all"
    with pytest.raises(ValueError, match="invalid metric"):
        series.scan_series(df, "memory")
    with pytest.raises(ValueError, match="missing required"):
        series.scan_series(df, "speedup", group_by="algorithm")


def test_text_expressions(spark):
    df = spark.createDataFrame([("dir/a.b/x.hepmc3.gz", "1.5", "oops")], "path string, good string, bad string")
    p = F.col("path")
    got = df.select(text.basename(p), text.dirname(p), text.extension(p), text.unpacked_name(p),
                    text.number_or_null(F.col("good")), text.number_or_null(F.col("bad")),
                    text.captured(F.col("good"), r"(\d+)\."), text.captured(F.col("bad"), r"(\d+)")).first()
    assert tuple(got) == ("x.hepmc3.gz", "dir/a.b", ".gz", "dir/a.b/x.hepmc3", 1.5, None, "1", None)
    with pytest.raises(Exception, match="invalid value for code"):
        df.select(text.one_of(F.col("bad"), ["x"], "code")).collect()
