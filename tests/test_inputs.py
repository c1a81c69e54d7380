"""Inputs that are easily mixed up or lost."""

import json

import pytest
from pyspark.sql import functions as F

from jetlake.operators import scan
from jetlake.operators.multiplicity import is_charged
from jetlake.operators.selection import select_jets
from jetlake.operators import clustering
from jetlake.sources import tables


def document(folder, name, **fields):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text(json.dumps({"threads": 1, "measured_events": 10, "summary": {"wall_time_seconds_median": 1.0}, **fields}))
    return str(path)


def test_same_named_files_keep_their_order(spark, tmp_path):
    a = document(tmp_path / "a", "run.json", success=True, code="A" * 400)
    b = document(tmp_path / "b", "run.json", success=True, code="B")
    for paths in ([a, b], [b, a]):
        rows = scan.read_scan(spark, paths).orderBy("_order").collect()
        assert [r.source_file.split("/")[-2] for r in rows] == [p.split("/")[-2] for p in paths]


def test_failed_runs(spark, tmp_path):
    good = document(tmp_path / "a", "1.json", success=True)
    failed = document(tmp_path / "a", "2.json", success=False)
    unknown = document(tmp_path / "a", "3.json")
    assert scan.skipped_runs(tables.read_thread_runs(spark, [good, failed])).count() == 1
    assert scan.read_scan(spark, [good, failed]).count() == 1
    with pytest.raises(ValueError):
        scan.scan_summary(spark, [failed])
    with pytest.raises(Exception, match="no success field"):
        scan.read_scan(spark, [good, unknown]).collect()


def test_layouts_align_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("n_samples,time_per_event\n3,4.5\n")
    (tmp_path / "2.csv").write_text("time_per_event,n_samples\n30.5,4\n")
    (tmp_path / "3.csv").write_text("n_samples\n7\n")
    rows = tables.read_results(spark, [str(tmp_path / f"{k}.csv") for k in (1, 2, 3)]).collect()
    assert sorted((r.n_samples, r.time_per_event) for r in rows if r.time_per_event) == [(3, 4.5), (4, 30.5)]
    assert [r.n_samples for r in rows if r.time_per_event is None] == [7]


def test_charges(spark):
    charged = [211, -211, 321, 2212, 3112, 3222, 3312, 3334, 411, 431, 521, 541, 11, -13, 24, 213, 4122, 5132, 1000010020, 1000822080, 2224]
    neutral = [22, 111, 130, 310, 311, 421, 511, 2112, 3122, 3212, 3322, 12, 14, 23, 113, 443, 1000000010]
    rows = spark.createDataFrame([(c,) for c in charged + neutral], "id long").select("id", is_charged(F.col("id")).alias("c")).collect()
    assert [r.id for r in rows if r.c] == charged


def test_events_of_too_few_particles_stay(make_events):
    events = make_events([[(1, 0, 0, 1), (0, 1, 0, 1), (-1, 0, 0, 1)], [(1, 0, 0, 1)]])
    sequence = clustering.cluster(events, "Kt", R=1.0)
    rows = select_jets(sequence, njets=2, too_few="none").orderBy("event").collect()
    assert [len(r.jets) for r in rows] == [2, 0]
