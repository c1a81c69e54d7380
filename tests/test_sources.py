import gzip
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from jetlake.constants import CODES
from jetlake.operators import clustering, scan, selection
from jetlake.plans import pipelines
from jetlake.sources import event_files, sinks, tables
from jetlake.streaming import event_stream

HEAD = "HepMC::Version 3.02.05\nHepMC::Asciiv3-START_EVENT_LISTING\n"
END = "HepMC::Asciiv3-END_EVENT_LISTING\n"


def hepmc_event(number, particles):
    lines = [f"E {number} 1 {len(particles)}", "U GEV MM"]
    lines += [f"P {i} 0 {pid} {px} {py} {pz} {e} 0.1 {status}"
              for i, (pid, px, py, pz, e, status) in enumerate(particles, 1)]
    return "\n".join(lines) + "\n"


EVENTS = {
    0: [(211, 1.5, -2.25, 1e-3, 3.0, 1), (22, 0.1, 0.2, 0.3, 0.4, 2)],
    1: [(22, 1.0, 1.0, 1.0, 2.0, 2)],
    7: [(2212, 0.0, 5.0, -2.0, 6.0, 1), (-211, 2.0, 0.0, 1.0, 2.5, 1)],
}


@pytest.fixture
def hepmc(tmp_path):
    text = HEAD + "".join(hepmc_event(n, p) for n, p in EVENTS.items()) + END + "\ntrailing words\n"
    (tmp_path / "a.hepmc3").write_text(text.replace("U GEV MM\n", "U GEV MM\n\n", 1))
    with gzip.open(tmp_path / "b.hepmc3.gz", "wt") as out:
        out.write(text)
    return tmp_path


def final(number):
    return [(p[1], p[2], p[3], p[4]) for p in EVENTS[number] if p[5] == 1]


def test_hepmc_plain_and_compressed(spark, hepmc):
    events = event_files.read_hepmc3(spark, [str(hepmc / "a.hepmc3"), str(hepmc / "b.hepmc3.gz")])
    rows = events.collect()
    assert len(rows) == 6
    for row in rows:
        assert [(p.px, p.py, p.pz, p.e) for p in row.particles] == final(row.event)
    everything = event_files.read_hepmc3(spark, str(hepmc / "a.hepmc3"), final_only=False)
    assert {r.event: len(r.particles) for r in everything.collect()} == {0: 2, 1: 1, 7: 2}
    first = everything.where("event = 0").first().particles[0]
    assert (first.barcode, first.vertex, first.pdgid, first.status) == (1, 0, 211, 1)


def test_hepmc_without_header_and_broken_number(spark, tmp_path):
    (tmp_path / "c.hepmc3").write_text(hepmc_event(3, EVENTS[7]))
    assert [r.event for r in event_files.read_hepmc3(spark, str(tmp_path / "c.hepmc3")).collect()] == [3]
    (tmp_path / "u.hepmc3").write_text("E 5 1 1\nP  1 0 211\t1.0  2.0 3.0 4.0 0.1 1\n")
    spaced = event_files.read_hepmc3(spark, str(tmp_path / "u.hepmc3")).first()
    assert (spaced.event, spaced.particles[0].py) == (5, 2.0)
    (tmp_path / "d.hepmc3").write_text(hepmc_event(3, [(211, "x1", 0, 0, 1, 1)]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        event_files.read_hepmc3(spark, str(tmp_path / "d.hepmc3")).collect()


def test_hepmc_window_per_file(spark, hepmc):
    paths = [str(hepmc / "a.hepmc3"), str(hepmc / "b.hepmc3.gz")]
    got = event_files.read_hepmc3(spark, paths, max_events=2, skip_events=1)
    assert [r.event for r in got.collect()] == [1, 1]


def test_small_splits_keep_events_whole(spark, tmp_path):
    many = {n: [(211, float(n), 1.0, 2.0, n + 5.0, 1)] * (n % 4 + 1) for n in range(200)}
    (tmp_path / "many.hepmc3").write_text(HEAD + "".join(hepmc_event(n, p) for n, p in many.items()) + END)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        events = event_files.read_hepmc3(spark, str(tmp_path / "many.hepmc3"))
        assert events.rdd.getNumPartitions() > 4
        assert {r.event: len(r.particles) for r in events.collect()} == {n: len(p) for n, p in many.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_jet_dump_round_trip(spark, tmp_path):
    found = clustering.inclusive_jets(
        pipelines.event_rows(spark, "/root/testdata/sf0.001"), R=1.0, ptmin=60.0)
    sinks.write_jet_dump(found, str(tmp_path / "dump"))
    back = event_files.read_jet_dump(spark, str(tmp_path / "dump"))
    want = selection.jet_rows(found).groupBy("event").agg(F.round(F.sum("pt"), 6).alias("s"), F.count("*").alias("n"))
    got = back.where(F.size("jets") > 0).select(
        "event", F.round(F.aggregate("jets", F.lit(0.0), lambda a, j: a + j["pt"]), 6).alias("s"),
        F.size("jets").cast("bigint").alias("n"))
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    sinks.write_jet_documents(found, str(tmp_path / "json"))
    docs = spark.read.json(str(tmp_path / "json"))
    assert docs.count() == found.count() and set(docs.columns) == {"jetid", "jets"}


def test_jet_dump_with_comments(spark, tmp_path):
    line = "%5u %15.10f %15.10f %15.10f\n".replace("%5u", "%5d")
    (tmp_path / "x.txt").write_text(
        "# made by hand 12\n\nJets in processed event 4\n" + line % (0, 0.5, 1.25, 30.0) + "\n"
        + line % (1, -1.5, 3.0, 20.0) + "other words\nJets in processed event 5\nJets in processed event 6\n"
        + line % (0, 0.0, 0.0, 9.0))
    got = event_files.read_jet_dump(spark, str(tmp_path / "x.txt")).orderBy("event").collect()
    assert [(r.event, [(j.rap, j.phi, j.pt) for j in r.jets]) for r in got] == [
        (4, [(0.5, 1.25, 30.0), (-1.5, 3.0, 20.0)]), (5, []), (6, [(0.0, 0.0, 9.0)])]
    assert event_files.read_jet_dump(spark, str(tmp_path / "x.txt"), keep_empty=False).count() == 2
    (tmp_path / "y.txt").write_text("Jets in no event\n")
    with pytest.raises(Exception, match="no event number"):
        event_files.read_jet_dump(spark, str(tmp_path / "y.txt")).collect()


def test_particle_table(spark, tmp_path):
    rows = [(f, e, i, float(i), 1.0, 0.0, 5.0) for f in "ab" for e in range(3) for i in range(e + 1)]
    df = spark.createDataFrame(rows, "file string, event bigint, idx int, px double, py double, pz double, e double")
    df.write.parquet(str(tmp_path / "t"))
    got = event_files.read_particles(spark, str(tmp_path / "t"), keys=("file", "event"), max_events=2)
    assert sorted((r.file, r.event, len(r.particles)) for r in got.collect()) == [
        ("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2)]


def test_manifests(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("File,mean_particles\nevents-a.hepmc3, 43.05\nevents-b.hepmc3,431.18\n")
    got = tables.read_manifest(spark, str(path)).orderBy("File").collect()
    assert [tuple(r) for r in got] == [
        ("events-a.hepmc3", 43.05, f"{tmp_path}/events-a.hepmc3"), ("events-b.hepmc3", 431.18, f"{tmp_path}/events-b.hepmc3")]
    plain = tables.read_manifest(spark, ["d/x.hepmc3.gz"]).first()
    assert tuple(plain) == ("x.hepmc3.gz", -1.0, "d/x.hepmc3.gz")
    assert tables.read_manifest(spark, ["d/x.hepmc3"], missing=None).first().mean_particles is None
    with pytest.raises(ValueError):
        tables.read_manifest(spark, [str(path), str(path)])
    names = spark.createDataFrame([("d/events-a.hepmc3.gz",), ("events-a.hepmc",), ("events-a",)], "f string")
    assert {r[0] for r in names.select(tables.canonical_file(F.col("f"))).collect()} == {"events-a"}


def test_result_files_and_names(spark, tmp_path):
    release = tmp_path / "machine-1.0"
    release.mkdir()
    text = "File,mean_particles,File_path,n_samples,time_per_event\nf.hepmc3, 43.05,d/f.hepmc3,16,29.5\n"
    (release / "FastJet_AntiKt_N2Tiled_R0.4_P-1.0.csv").write_text(text)
    (release / "Julia-CA-N2Plain-1.0.csv").write_text(text)
    got = {r.code: r for r in tables.read_results(spark, str(release), parse_names=True).collect()}
    a, b = got["FastJet"], got["Julia"]
    assert (a.algorithm, a.strategy, a.radius, a.power, a.release) == ("AntiKt", "N2Tiled", 0.4, -1.0, "machine-1.0")
    assert (b.algorithm, b.strategy, b.radius, b.power, b.n_samples) == ("CA", "N2Plain", 1.0, None, 16)
    assert a.mean_particles == 43.05 and a.time_per_event == 29.5
    old = spark.createDataFrame([("f", "FastJet", 0.4, -1.0)], "file string, backend string, R double, p double")
    assert tuple(tables.current_names(old).first()) == ("f", "Fastjet", 0.4, -1.0)
    assert tables.current_names(old).columns == ["File", "code", "radius", "power"]


def run_document(threads, median, success=True):
    return {"success": success, "algorithm": "AntiKt", "strategy": "N2Tiled", "R": 0.4, "p": -1, "input_file": "d/f.hepmc3",
            "measured_events": 200, "nsamples": 3, "julia_version": "1.11.1", "julia_threads": threads, "sample_index": None,
            "samples": [{"sample_index": 1, "wall_time_seconds": median, "events_per_second": 200 / median}],
            "summary": {"wall_time_seconds_median": median, "events_per_second_median": 200 / median},
            "packages": {CODES[0]: {"version": "0.4.3"}}, "git": {"commit": "abc", "is_dirty": False},
            "hardware": {"cpu_threads": 16}, "runtime": {"environment": {"JULIA_NUM_GC_THREADS": None}}}


def test_mixed_scan(spark, tmp_path):
    for name, doc in {"t1": run_document(1, 2.0), "t2": run_document(2, 1.25), "bad": run_document(4, 1.0, False)}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "r.csv").write_text(
        "File,mean_particles,n_samples,time_per_event,code,algorithm,strategy,radius,power,threads,schedule\n"
        "g.hepmc3,43.0,16,100.0,Fastjet,AntiKt,N2Tiled,0.4,-1.0,1,\n"
        "g.hepmc3,43.0,,25.0,Fastjet,AntiKt,N2Tiled,0.4,-1.0,4,\n")
    paths = [str(tmp_path / n) for n in ("t1.json", "t2.json", "bad.json", "r.csv", "out.csv")]
    summary = scan.scan_summary(spark, paths, output=paths[-1]).collect()
    shown = [(r.code, r.code_version, r.threads, r.schedule, r.raw_rows, r.nsamples, round(r.speedup_median, 6)) for r in summary]
    assert shown == [("Fastjet", "unknown", 1, "static", 1, 16, 1.0), ("Fastjet", "unknown", 4, "static", 1, None, 4.0),
                     (CODES[0], "0.4.3", 1, "julia_threads_default", 1, 3, 1.0),
                     (CODES[0], "0.4.3", 2, "julia_threads_default", 1, 3, 1.6)]
    json_row = summary[2]
    assert json_row.time_per_event_seconds_median == 0.01 and json_row.repo_dirty is False and json_row.cpu_threads == 16
    with pytest.raises(ValueError, match="unsupported input extension"):
        tables.split_by_format(["a.parquet"])
    (tmp_path / "broken.json").write_text('{"success": tru')
    with pytest.raises(Exception):
        tables.read_thread_runs(spark, str(tmp_path / "broken.json")).collect()


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Fastjet", "CA", "Best", 0.4, 0.0, 1.0)],
                               "code string, algorithm string, strategy string, radius double, power double, t double")
    sinks.write_results(df, str(tmp_path / "r"))
    assert (pathlib.Path(tmp_path) / "r" / "code=Fastjet" / "algorithm=CA").is_dir()
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.where("radius = 0.4").count() == 1 and set(back.columns) == set(df.columns)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == df.columns


def test_files_that_keep_arriving(spark, hepmc, tmp_path):
    stream = event_stream.stream_jets(spark, str(hepmc), ptmin=1.0, R=0.4)
    run = stream.writeStream.format("memory").queryName("arriving_jets").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = clustering.inclusive_jets(event_files.read_hepmc3(spark, str(hepmc)), ptmin=1.0)
    assert spark.table("arriving_jets").exceptAll(batch).count() == 0 and spark.table("arriving_jets").count() == 6


def test_many_files_of_many_layouts_in_one_scan(spark, tmp_path):
    """2,000 files of four layouts, quoted fields and blank lines: one scan, headers by path."""
    layouts = [["File", "code", "threads"], ["threads", "File", "code", "schedule"], ["code", " threads ", "File"], ["note", "File", "threads", "code"]]
    want = []
    for n in range(2000):
        layout = layouts[n % 4]
        rows = [{"File": f"f{n}", "code": f'a, "b" {k}', "threads": str(k), "schedule": "", "note": "x"} for k in range(1, n % 3 + 1)]
        text = "\n".join([",".join(layout), "", *(",".join('"' + r[c.strip()].replace('"', '\\"') + '"' for c in layout) for r in rows)])
        (tmp_path / f"{n}.csv").write_text(("\ufeff" if n % 5 == 0 else "") + text + ("\n" if n % 2 else ""))
        want += [(r["File"], r["code"], int(r["threads"])) for r in rows]
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = tables.read_results(spark, [str(tmp_path / f"{n}.csv") for n in range(2000)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 20
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert set(got.columns) == {"File", "code", "threads", "schedule", "note"}
    assert sorted((r.File, r.code, r.threads) for r in got.collect()) == sorted(want)


def test_csv_rows_name_the_file_at_fault(spark, tmp_path):
    head = "File,time_per_event,code,algorithm,strategy,radius,power,threads"
    (tmp_path / "good.csv").write_text(f"{head}\nf,10,Fastjet,CA,Best,0.4,0,1\n")
    (tmp_path / "bad.csv").write_text(f"{head.replace('radius,', '')}\nf,10,Fastjet,CA,Best,0,1\n")
    (tmp_path / "none.csv").write_text(f"{head.replace('File,', '')}\n10,Fastjet,CA,Best,0.4,0,1\n")
    paths = [str(tmp_path / f"{n}.csv") for n in ("good", "bad", "none")]
    assert scan.read_scan(spark, paths[:1]).count() == 1
    for at, text in ((1, "bad.csv lacks column.* radius"), (2, "none.csv names no input file")):
        with pytest.raises(Exception, match=text):
            scan.read_scan(spark, [paths[0], paths[at]]).collect()


def test_manifest_events_in_balanced_tasks(spark, tmp_path):
    """One file of a few very busy events among quiet ones: tasks of about equal cost, every event once, with its row."""
    folder = tmp_path / "with space"
    folder.mkdir()
    quiet = {n: [(211, 1.0, 1.0, 2.0, 5.0, 1)] * (n % 7 + 1) for n in range(400)}
    busy = {n: [(211, 1.0, 1.0, 2.0, 5.0, 1)] * 60 for n in range(40)}
    for name, events in (("q.hepmc3", quiet), ("b.hepmc3", busy)):
        (folder / name).write_text(HEAD + "".join(hepmc_event(n, p) for n, p in events.items()) + END)
    (folder / "m.csv").write_text("File,mean_particles\nq.hepmc3, 4\nb.hepmc3, 60\nq.hepmc3, 4\n")
    events = event_files.read_manifest_events(spark, str(folder / "m.csv"), buckets=8)
    rows = events.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.listed_file, r.event, len(r.particles), r.mean_particles) for r in rows) == sorted(
        [("q.hepmc3", n, len(p), 4.0) for n, p in quiet.items()] + [("b.hepmc3", n, 60, 60.0) for n in busy])
    cost = {}
    for r in rows:
        cost[r.task] = cost.get(r.task, 0) + len(r.particles) ** 2
    assert len(cost) == 8 and max(cost.values()) < 2 * sum(cost.values()) / 8
    with pytest.raises(ValueError, match="no files"):
        (folder / "e.csv").write_text("File,mean_particles\n")
        event_files.read_manifest_events(spark, str(folder / "e.csv"))


def test_named_outputs(spark, tmp_path):
    names = ("code", "code_version", "algorithm", "strategy", "radius", "power", "backend", "backend_version", "threads", "schedule")
    df = spark.createDataFrame(
        [("Fastjet", "1.0", "CA", "Best", 0.4, 0.0, "C++", "a/b=c", 1, None, 1.5), ("Fastjet", "1.0", "CA", "Best", 0.4, 0.0, "C++", "x", 4, "static", 2.5)] * 3,
        ", ".join(f"{n} {'double' if n in ('radius', 'power') else 'int' if n == 'threads' else 'string'}" for n in names) + ", t double")
    plain = F.replace(sinks.run_name(), F.lit("/"), F.lit("_"))
    sinks.write_named(df, str(tmp_path / "out"), plain, columns=["t", "threads"])
    found = {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")}
    assert found == {"Fastjet_1.0_CA_Best_R0.4_P0.0_C++_a_b=c.csv": "t,threads\n" + "1.5,1\n" * 3,
                     "Fastjet_1.0_CA_Best_R0.4_P0.0_C++_x_T4_static.csv": "t,threads\n" + "2.5,4\n" * 3}
    with pytest.raises(FileExistsError):
        sinks.write_named(df, str(tmp_path / "out"), plain)
    # A task that fails leaves nothing behind, the files of other tasks included.
    broken = df.withColumn("t", F.when(F.col("threads") == 4, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_named(broken, str(tmp_path / "failed"), plain)
    assert not (tmp_path / "failed").exists() or not list((tmp_path / "failed").iterdir())


def test_large_named_outputs_are_directories(spark, tmp_path):
    """A name with many rows is written by many tasks, its parts in order; a listed directory is read as one file."""
    folder = str(tmp_path / "out")
    rows = [("big.hepmc3", n, hepmc_event(n, [(211, 1.0, 1.0, 2.0, 5.0, 1)] * 3).rstrip("\n")) for n in range(600)]
    rows += [("small.hepmc3", n, hepmc_event(n, [(211, 1.0, 1.0, 2.0, 5.0, 1)]).rstrip("\n")) for n in range(10)]
    df = spark.createDataFrame(rows, "name string, event bigint, value string").repartition(5)
    sinks.write_named(df, folder, F.col("name"), fmt="text", order=["event"], columns=["value"], file_bytes=10_000)
    listed = spark.createDataFrame([("big.hepmc3", 3.0), ("small.hepmc3", 1.0)], "File string, mean_particles double")
    sinks.write_named(listed, folder, F.lit("m.csv"))
    assert (tmp_path / "out" / "small.hepmc3").is_file()
    parts = sorted((tmp_path / "out" / "big.hepmc3").glob("part-*"))
    assert len(parts) > 3 and max(p.stat().st_size for p in parts) < 40_000
    numbers = [int(line.split()[1]) for p in parts for line in p.read_text().splitlines() if line.startswith("E ")]
    assert numbers == list(range(600))
    events = event_files.read_manifest_events(spark, f"{folder}/m.csv", max_events=500, skip_events=3, buckets=4)
    found = events.collect()
    assert sorted((r.listed_file, r.event, len(r.particles), r.mean_particles) for r in found) == sorted(
        [("big.hepmc3", n, 3, 3.0) for n in range(3, 500)] + [("small.hepmc3", n, 1, 1.0) for n in range(3, 10)])
    assert {r.file.rsplit("/", 1)[-1] for r in found} == {"big.hepmc3", "small.hepmc3"}


def test_dump_by_processed_position(spark, tmp_path):
    jets = "file string, event bigint, jets array<struct<px:double,py:double,pz:double,e:double>>"
    rows = [("a", e, [(float(e), 0.0, 0.0, float(e))]) for e in (90, 7, 1000)] + [("b", 5, []), ("b", 2, [(1.0, 0.0, 0.0, 1.0)])]
    sinks.write_jet_dump(spark.createDataFrame(rows, jets), str(tmp_path / "dump"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*")))
    shown = [line.split()[-1] if line.startswith("Jets") else round(float(line.split()[-1])) for line in text.splitlines()]
    assert shown == ["1", 7, "2", 90, "3", 1000, "1", 1, "2"]


def test_documents_without_a_schema(spark, tmp_path):
    whole = run_document(2, 1.25)
    odd = {**whole, "packages": {"OtherPackage": {"version": "9.9", "extra": [1, 2]}, "Third": {"version": "0.1"}},
           "measured_events": "many", "summary": {"wall_time_seconds_median": 3.5}, "surprise": {"deep": [1]}}
    for name, text in {"whole": json.dumps(whole, indent=2), "odd": json.dumps(odd), "broken": '{"success": tru', "empty": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    documents = tables.read_run_documents(spark, str(tmp_path / "*.json"))
    runs = {r.source_file.rsplit("/", 1)[-1]: r for r in tables.variant_runs(documents).collect()}
    assert set(runs) == {"whole.json", "odd.json"}
    assert runs["odd.json"].measured_events is None and runs["odd.json"].summary.wall_time_seconds_median == 3.5
    assert runs["odd.json"].package_versions == {"OtherPackage": "9.9", "Third": "0.1"}
    assert runs["whole.json"].samples[0].wall_time_seconds == 1.25 and runs["whole.json"].package_versions == {CODES[0]: "0.4.3"}
    broken = {r.source_file.rsplit("/", 1)[-1]: (r.n_chars, r.begins) for r in tables.broken_documents(documents).collect()}
    assert broken["broken.json"] == (15, '{"success": tru')
    strict = tables.read_thread_runs(spark, str(tmp_path / "whole.json"))
    same = tables.variant_runs(documents).where("source_file LIKE '%whole.json'").select(strict.columns)
    assert same.drop("source_file").collect() == strict.drop("source_file").collect()
    rows = scan.json_rows(tables.variant_runs(documents).withColumn("_order", F.lit(0)))
    assert rows.count() == 2
