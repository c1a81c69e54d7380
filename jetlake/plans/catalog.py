"""Registered queries: every operator run over the given tables."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake.constants import CODES, PREFERRED_CODES
from jetlake.functions import kinematics as kin
from jetlake.functions import text
from jetlake.operators import clustering, events as ev, multiplicity as mult, results as res
from jetlake.operators import scan, selection, substructure, trials
from jetlake.operators.grouping import ordinals, prefix_min, shared_folder
from jetlake.plans import pipelines as pipe
from jetlake.plans import series, views
from jetlake.sources import event_files, sinks, tables

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits=5, **special) -> DataFrame:
    """Round floating-point columns (engines differ in last bits); zeros lose their sign."""
    return df.select(*[
        (F.round(F.col(c), special.get(c, digits)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
        for c, kind in df.dtypes])


def _jets(df):
    return rounded(df.select("event", "jet_rank", "rap", "phi", "pt"))


# Clustering and jet selection

def _inclusive(name, *args, **options):
    def run(spark, sf_dir):
        return _jets(pipe.jets(spark, sf_dir, *args, **options))
    QUERIES[name] = run


_inclusive("antikt_inclusive", "AntiKt", 0.4)
_inclusive("ca_inclusive", "CA", 0.4)
_inclusive("kt_inclusive", "Kt", 0.4)
_inclusive("genkt_inclusive", "GenKt", 0.4, -0.5)
_inclusive("eekt_inclusive", "EEKt", 1.0, -1.0)
_inclusive("scheme_pt", "AntiKt", 1.0, scheme="pt")
_inclusive("scheme_pt2", "AntiKt", 1.0, scheme="pt2")
_inclusive("strategy_plain", "AntiKt", 1.0, strategy="N2Plain")
_inclusive("strategy_tiled", "AntiKt", 1.0, strategy="N2Tiled")


def _exclusive(name, *args, **options):
    def run(spark, sf_dir):
        return _jets(pipe.exclusive(spark, sf_dir, *args, **options))
    QUERIES[name] = run


_exclusive("durham_exclusive", "Durham", 4.0, njets=3)
_exclusive("durham_dcut", "Durham", 4.0, dcut=2000.0)
_exclusive("eekt_exclusive", "EEKt", 4.0, 1.0, njets=2)
_exclusive("kt_exclusive_njets", "Kt", 0.4, njets=4)
_exclusive("kt_exclusive_dcut", "Kt", 0.4, dcut=400.0)


@query
def first_merge(spark, sf_dir):
    first = clustering.first_merge(pipe.event_rows(spark, sf_dir))
    return rounded(first.select("event", "parent1", "parent2", F.log("dij").alias("log_dij")))


@query
def tied_events(spark, sf_dir):
    """Particles with one of seven momenta: many distances of an event are equal, and go by number."""
    kind = F.col("l_suppkey") % 7
    rows = views.particle_rows(spark, sf_dir).where("status = 1").withColumns({
        "idx": F.struct(*[c.strip() for c in views.INPUT_ORDER.split(",")]),
        "px": (kind * kind + 3).cast("double"), "py": (kind * 7 - 20).cast("double"),
        "pz": (kind * kind * 11 - kind * 50).cast("double")})
    energy = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2 + F.lit(0.01948))
    first = clustering.first_merge(ev.assemble_events(rows.withColumn("e", energy), ["event"]))
    return rounded(first, digits=9)


@query
def history_rows(spark, sf_dir):
    sequence = clustering.cluster(pipe.event_rows(spark, sf_dir))
    rows = selection.history_table(sequence.drop("particles"))
    return rounded(rows.select(
        "event", "entry", "parent1", "parent2", "child",
        F.when(F.col("dij") > 0, F.log("dij")).alias("log_dij"),
        F.when(F.col("max_dij") > 0, F.log("max_dij")).alias("log_max_dij")))


@query
def sequence_jets(spark, sf_dir):
    sequence = clustering.cluster(pipe.event_rows(spark, sf_dir), R=1.0)
    return rounded(selection.jets_table(sequence.drop("particles")))


@query
def jet_count_per_file(spark, sf_dir):
    found = clustering.inclusive_jets(pipe.event_rows(spark, sf_dir), "CA", 0.4, ptmin=2.0)
    return selection.jets_per_file(found.withColumn("file", F.col("event") % 10))


@query
def jet_documents(spark, sf_dir):
    found = clustering.inclusive_jets(pipe.event_rows(spark, sf_dir), ptmin=100.0)
    docs = selection.jet_documents(found)
    shown = F.transform("jets", lambda j: F.round(j["pt"] * 1000).cast("bigint").cast("string"))
    return docs.select("jetid", F.size("jets").alias("n_jets"), F.concat_ws(",", shown).alias("pts"))


@query
def param_scan(spark, sf_dir):
    grid = clustering.parameter_grid(["AntiKt", "CA", "Kt"], [0.4, 1.0])
    found = clustering.scan(pipe.event_rows(spark, sf_dir), grid)
    total = F.aggregate("jets", F.lit(0.0), lambda a, j: a + kin.pt(j["px"], j["py"]))
    return rounded(found.select("algorithm", "R", "p", "event", F.size("jets").alias("n_jets"),
                                total.alias("sum_pt")), R=1, p=1)


def _groomed(name, method):
    def run(spark, sf_dir):
        found = pipe.groomed(spark, sf_dir, method)
        return rounded(found.select("event", "jet_id", "pt", "rap"), digits=4)
    QUERIES[name] = run


_groomed("filter", "filter")
_groomed("trim", "trim")
_groomed("mass_drop", "mass_drop")
_groomed("soft_drop", "soft_drop")


@query
def jet_constituents(spark, sf_dir):
    """The inputs of each jet, by their numbers, and their summed energy."""
    found = substructure.constituents(substructure.substructure_input(pipe.event_rows(spark, sf_dir), 1.0))
    energy = F.aggregate("particles", F.lit(0.0), lambda a, p: a + p["e"])
    return rounded(found.select("event", "jet_id", F.size("particles").alias("n_members"), energy.alias("sum_e"),
                                kin.pt(F.col("jet.px"), F.col("jet.py")).alias("pt")), digits=4)


@query
def object_members(spark, sf_dir):
    """The inputs of every merged object of the sequence."""
    sequence = substructure.with_intervals(substructure.substructure_input(pipe.event_rows(spark, sf_dir), 1.0))
    objects = F.filter(F.transform("history", lambda h, x: F.struct(x.alias("entry"), h["parent2"].alias("p2"))), lambda o: o["p2"] >= 0)
    rows = sequence.select("event", "spans", "leaves", F.explode(objects).alias("o")).select(
        "event", (F.col("o.entry") + 1).alias("entry"), substructure.members(F.col("o.entry")).alias("m"))
    return rows.select("event", "entry", F.size("m").alias("n_members"), F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


# Event rows

@query
def kinematics(spark, sf_dir):
    p = views.particles(spark, sf_dir)
    args = [F.col(c) for c in ("px", "py", "pz", "e")]
    return rounded(p.select("event", "idx", kin.pt(*args[:2]).alias("pt"), kin.rapidity(*args).alias("rap"),
                            kin.phi(*args[:2]).alias("phi"), kin.mass(*args).alias("mass")), mass=2)


@query
def final_state(spark, sf_dir):
    events = ev.assemble_events(views.particles(spark, sf_dir), ["event"], columns=(
        "px", "py", "pz", "e", "status"))
    return rounded(ev.final_state(events).select("event", F.inline("particles")))


def _files(spark, sf_dir):
    return views.particle_rows(spark, sf_dir).select((F.col("event") % 5).alias("file"), "event").distinct()


@query
def event_window(spark, sf_dir):
    return ev.event_window(_files(spark, sf_dir), max_events=100, skip_events=10)


@query
def event_skip(spark, sf_dir):
    return ev.event_window(_files(spark, sf_dir), skip_events=25)


@query
def event_position(spark, sf_dir):
    return ev.event_positions(_files(spark, sf_dir))


@query
def hepmc_round_trip(spark, sf_dir):
    p = views.particles(spark, sf_dir)
    line = F.concat_ws(" ", F.lit("P"), F.col("idx") + 1, F.lit("0"), "pdgid", "px", "py", "pz", "e",
                       F.lit("0.0"), "status")
    lines = p.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("l"))
    head = F.concat(F.col("event"), F.lit(" 1 "), F.size("l"), F.lit("\nU GEV MM\n"))
    records = lines.select(
        F.lit("file").alias("file"),
        F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))
    parsed = event_files.parse_hepmc3(records)
    return rounded(parsed.select("event", F.inline("particles")).drop("vertex"))


@query
def dump_round_trip(spark, sf_dir):
    found = clustering.inclusive_jets(pipe.event_rows(spark, sf_dir), R=1.0, ptmin=50.0)
    dump = selection.format_jet_dump(found)
    records = dump.select(F.lit("file").alias("file"), F.regexp_replace("value", "^Jets in", "").alias("value"))
    parsed = event_files.parse_jet_dump(records)
    return rounded(parsed.select("event", F.posexplode("jets").alias("jet_rank", "j")).select(
        "event", "jet_rank", "j.rap", "j.phi", "j.pt"))


@query
def multiplicity(spark, sf_dir):
    events = pipe.event_rows(spark, sf_dir).withColumn("file", F.col("event") % 10)
    return rounded(mult.multiplicity(events))


@query
def multiplicity_hist(spark, sf_dir):
    counts = mult.event_counts(views.particle_rows(spark, sf_dir), charged=True)
    return mult.fixed_histogram(counts)


@query
def multiplicity_auto_hist(spark, sf_dir):
    counts = mult.event_counts(views.particle_rows(spark, sf_dir))
    return rounded(trials.trial_histogram(counts, [], "n_particles"), digits=8)


@query
def array_argmin(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    found = vectors.select("vec_id", selection.argmin(F.col("embedding")).alias("m"),
                           selection.argmin(F.col("embedding"), F.lit(8)).alias("p"))
    return rounded(found.select("vec_id", F.col("m.value").cast("double").alias("low"), F.col("m.index").alias("at"),
                                F.col("p.value").cast("double").alias("low8"), F.col("p.index").alias("at8")))


# Trials and samples

@query
def trial_stats(spark, sf_dir):
    return rounded(trials.trial_stats(views.trials(spark, sf_dir), ["workload"]))


@query
def trial_outliers(spark, sf_dir):
    return rounded(trials.outlier_statistics(views.trials(spark, sf_dir), ["workload"], band=0.5))


@query
def trial_histogram(spark, sf_dir):
    return rounded(trials.trial_histogram(views.trials(spark, sf_dir), ["workload"]), digits=8)


@query
def result_table(spark, sf_dir):
    stats = trials.trial_stats(views.trials(spark, sf_dir), ["workload"])
    full = trials.result_table(stats).withColumn("external", F.lit(False))
    outside = trials.result_table(stats, external=True).withColumn("external", F.lit(True))
    return rounded(full.unionByName(outside))


@query
def sample_moments(spark, sf_dir):
    return rounded(trials.sample_moments(
        views.samples(spark, sf_dir), ["run"], "wall_time_seconds", F.lit(100)), digits=7)


@query
def sample_metrics(spark, sf_dir):
    return rounded(trials.sample_metrics(views.samples(spark, sf_dir)).drop("measured_events"), digits=8)


@query
def sample_summary(spark, sf_dir):
    return rounded(trials.sample_summary(trials.sample_metrics(views.samples(spark, sf_dir)), ["run"]))


@query
def best_sample(spark, sf_dir):
    return rounded(trials.best_sample(
        views.samples(spark, sf_dir), ["run"], columns=["allocated_bytes_total", "gc_time_seconds"]))


# Thread scans

def _scan_rows(spark, sf_dir):
    order = F.struct(*[c.strip() for c in views.INPUT_ORDER.split(",")])
    return scan.csv_rows(views.results(spark, sf_dir).withColumn("_order", order))


def _merged(spark, sf_dir):
    return scan.merge_scan(_scan_rows(spark, sf_dir))


@query
def csv_scan_rows(spark, sf_dir):
    rows = _scan_rows(spark, sf_dir).select(
        "_order.*", "code", "code_version", "backend", "backend_version", "threads", "schedule",
        "events_per_second", "R", "p", "input_file", "nsamples", "time_per_event_seconds")
    return rounded(rows, time_per_event_seconds=12)


@query
def json_scan_rows(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    document = F.to_json(F.struct(
        (F.col("l_linenumber") != 4).alias("success"), "algorithm", "strategy",
        F.col("radius").alias("R"), F.col("power").alias("p"),
        F.col("File_path").alias("input_file"), F.lit(100).alias("measured_events"),
        F.col("threads").alias("julia_threads"), F.lit("1.11").alias("julia_version"),
        F.struct(F.col("time_per_event").alias("wall_time_seconds_median"),
                 (F.col("n_samples") * F.lit(64.0)).alias("allocated_bytes_total_median")).alias("summary"),
        F.struct(F.col("l_orderkey").cast("string").alias("commit")).alias("git")))
    from jetlake.schemas import THREAD_RUN
    runs = rows.select(F.col("l_orderkey").cast("string").alias("source_file"), F.lit(0).alias("_order"),
                       F.from_json(document, THREAD_RUN).alias("d")).select("source_file", "_order", "d.*")
    out = scan.json_rows(runs).select(
        "repo_commit", "code", "code_version", "backend", "backend_version", "threads", "schedule", "algorithm",
        "R", "p", "input_file", "measured_events", "wall_time_seconds", "time_per_event_seconds",
        "allocated_bytes_total", "allocated_bytes_per_event")
    return rounded(out, digits=8)


@query
def scan_merge(spark, sf_dir):
    return rounded(_merged(spark, sf_dir).select(
        *scan.GROUP, "events_per_second_median", "time_per_event_seconds_median", "nsamples", "raw_rows"),
        time_per_event_seconds_median=13)


@query
def scan_speedup(spark, sf_dir):
    summary = scan.sorted_scan(scan.with_speedup(_merged(spark, sf_dir), strict=False))
    return rounded(summary.select(*scan.GROUP, "baseline_events_per_second_median", "speedup_median",
                                  "efficiency_median"))


@query
def scan_series(spark, sf_dir):
    summary = scan.with_speedup(_merged(spark, sf_dir), strict=False)
    return rounded(series.scan_series(summary, "speedup", group_by="code,algorithm,strategy,R,schedule"))


def _scaling(spark, sf_dir):
    rows = views.results(spark, sf_dir).where("time_per_event IS NOT NULL")
    return rows.groupBy("code", "threads").agg((F.lit(1e6) / F.min("time_per_event")).alias("event_rate"))


@query
def ideal_scaling(spark, sf_dir):
    return rounded(res.ideal_scaling(_scaling(spark, sf_dir), 4, 0.1, ["code"]), digits=4)


@query
def scaling_series(spark, sf_dir):
    return rounded(series.scaling_series(_scaling(spark, sf_dir), 4, 0.1, ["code"]), digits=4)


@query
def speedup_series(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    wide = rows.groupBy("threads").agg(*[
        F.avg(F.when(F.col("strategy") == s, F.col("time_per_event"))).alias(s) for s in ("N2Plain", "N2Tiled")])
    return rounded(series.speedup_series(wide, ["N2Plain", "N2Tiled"]))


# Result tables

@query
def select_rows(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    chosen = res.select_rows(rows, {"algorithm": ["AntiKt", "CA"], "radius": 0.4}, strategy="N2Tiled", code=None)
    return rounded(chosen.select("l_orderkey", "l_linenumber", "l_partkey", "algorithm", "radius", "time_per_event"))


@query
def drop_rows(spark, sf_dir):
    rows = res.drop_rows(views.results(spark, sf_dir), "n_samples", 7)
    return rows.groupBy("n_samples").agg(F.count("*").alias("n"))


@query
def append_results(spark, sf_dir):
    rows = views.results(spark, sf_dir).select("code", "threads", "time_per_event", "radius")
    first = rows.where("radius < 1").select("code", "threads", F.col("time_per_event").cast("float").alias("t"))
    later = rows.where("radius >= 1").select("code", F.col("threads").cast("bigint").alias("threads"),
                                             F.col("time_per_event").alias("t"), "radius")
    stacked = res.append_results([first, later])
    return stacked.groupBy("code", "threads").agg(
        F.count("*").alias("n"), F.sum(F.floor("t")).alias("total"))


def _ratios(spark, sf_dir):
    rows = views.results(spark, sf_dir).withColumnRenamed("radius", "R")
    return res.runtime_ratio(rows, CODES[1], CODES[0], ["File", "algorithm", "strategy", "R", "threads"])


@query
def runtime_ratio(spark, sf_dir):
    return rounded(_ratios(spark, sf_dir))


@query
def ratio_means(spark, sf_dir):
    return rounded(res.ratio_means(_ratios(spark, sf_dir)), R=1)


@query
def ratio_series(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    return rounded(series.ratio_series(rows, CODES[1], CODES[0], ["File", "algorithm", "strategy", "radius"]))


@query
def weighted_mean(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    files = rows.groupBy("File", "algorithm").agg(
        F.count("*").alias("ExJets"), F.avg("time_per_event").alias("filter_time"),
        F.min("time_per_event").alias("trimming_time"), F.max("time_per_event").alias("massdrop_time"),
        F.avg(F.col("threads").cast("double")).alias("softdrop_time"))
    return rounded(res.weighted_means(files, "ExJets", {
        "Filter": "filter_time", "Trim": "trimming_time",
        "Massdrop": "massdrop_time", "Softdrop": "softdrop_time"}))


@query
def fastest_per_jet(spark, sf_dir):
    samples = views.samples(spark, sf_dir).withColumnsRenamed(
        {"run": "method", "wall_time_seconds": "seconds", "measured_events": "n_jets"})
    return rounded(res.fastest_per_jet(samples.withColumn("file", F.col("sample_index") % 3)))


@query
def file_lookup(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    counts = rows.groupBy("File_path").agg(F.sum("threads").alias("n_jets"))
    per_code = rows.groupBy("File_path", "code").agg(F.count("*").alias("n"))
    return res.lookup_one(per_code, counts, "File_path")


@query
def describe(spark, sf_dir):
    return rounded(res.describe(views.results(spark, sf_dir), ["threads", "n_samples", "time_per_event"]))


@query
def group_means(spark, sf_dir):
    return rounded(res.group_means(views.results(spark, sf_dir), ["code", "radius"]))


@query
def group_count(spark, sf_dir):
    return res.group_count(views.results(spark, sf_dir), ["code", "algorithm", "n_samples"])


@query
def distinct_values(spark, sf_dir):
    return res.distinct_values(views.results(spark, sf_dir), "n_samples")


@query
def head(spark, sf_dir):
    rows = views.results(spark, sf_dir).select("code", *[c.strip() for c in views.INPUT_ORDER.split(",")])
    return rounded(res.head(rows, ["code", *[c.strip() for c in views.INPUT_ORDER.split(",")]]))


@query
def preferred_order(spark, sf_dir):
    counts = views.results(spark, sf_dir).groupBy("code", "algorithm").agg(F.count("*").alias("n"))
    return res.in_preferred_order(counts, then=["algorithm"]).withColumn(
        "place", text.code_order(F.col("code")).cast("int"))


@query
def top_of(spark, sf_dir):
    return rounded(res.top_of(views.results(spark, sf_dir), "time_per_event", "mean_particles"))


@query
def prefix_minimum(spark, sf_dir):
    series_rows = views.trials(spark, sf_dir).select("trial", "time_us")
    return rounded(prefix_min(series_rows, "trial", "time_us", span_bits=6))


# Figures

def _curves(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    keys = ["code", "code_version", "algorithm", "strategy", "radius", "mean_particles"]
    return rows.groupBy(*keys).agg(F.min("time_per_event").alias("time_per_event"))


@query
def figure_series(spark, sf_dir):
    return rounded(series.figure_series(
        _curves(spark, sf_dir), {"strategy": "N2Tiled", "algorithm": ["AntiKt", "Kt"]},
        split_by=["algorithm", "radius"], plot_by=["code", "code_version"]))


@query
def radius_scan(spark, sf_dir):
    return rounded(series.radius_scan(_curves(spark, sf_dir), ["AntiKt", "CA"], "N2Plain"))


@query
def showcase(spark, sf_dir):
    return rounded(series.showcase(_curves(spark, sf_dir), "Kt", 1.0, "N2Tiled", without=[PREFERRED_CODES[2]]))


@query
def latency_series(spark, sf_dir):
    t = views.trials(spark, sf_dir)
    wide = t.groupBy("trial").agg(*[
        F.max(F.when(F.col("workload") == w, F.col("time_us"))).alias(w) for w in ("click", "purchase")])
    return rounded(series.latency_series(wide, "trial", ["click", "purchase"]))


@query
def version_comparison(spark, sf_dir):
    curves = _curves(spark, sf_dir)
    releases = {f"v{i}": curves.where(F.col("code_version") == f"1.{i}").drop("code_version") for i in (0, 1)}
    return rounded(series.version_comparison(
        releases, select_by={"strategy": "N2Plain", "radius": 0.4, "algorithm": "Kt"}))


# Scalars

@query
def run_names(spark, sf_dir):
    rows = views.results(spark, sf_dir).withColumns({
        "backend": text.default_backend(F.col("code")), "backend_version": F.lit("unknown"),
        "schedule": F.nullif("schedule", F.lit(""))})
    return rows.select(sinks.run_name().alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query
def filename_meta(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    old = F.when(F.col("code") == CODES[1], F.lit("FastJet")).otherwise(F.lit("Julia"))
    name = F.when(F.col("threads") % 2 == 0, F.concat(
        old, F.lit("_"), "algorithm", F.lit("_"), "strategy", F.lit("_R"), "radius", F.lit("_P"), "power",
        F.lit(".csv"))).otherwise(F.concat(
            old, F.lit("-"), "algorithm", F.lit("-"), "strategy", F.lit("-"), "radius", F.lit(".csv")))
    fields = tables.name_fields(F.col("name"))
    return rounded(rows.select(name.alias("name")).select(*[v.alias(k) for k, v in fields.items()])
                   .groupBy(*fields).agg(F.count("*").alias("n")))


@query
def labels(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    rows = rows.select("code", "radius", "power", F.col("File_path").alias("input_file"))
    return rows.select(
        text.code_label(F.col("code")).alias("code_label"),
        text.row_label(rows, ["code", "radius", "input_file"], ", ").alias("label"),
        text.safe_filename(F.concat(F.lit("/"), "input_file", F.lit("--"))).alias("safe"),
        text.basename(F.col("input_file")).alias("base"), text.dirname(F.col("input_file")).alias("dir"),
        text.extension(F.col("input_file")).alias("ext"),
        text.value_label(F.col("radius") / 3, "double").alias("third"),
    ).groupBy("code_label", "label", "safe", "base", "dir", "ext", "third").agg(F.count("*").alias("n"))


@query
def defaults(spark, sf_dir):
    rows = views.results(spark, sf_dir)
    code, t = F.col("code"), F.col("time_per_event")
    return rounded(rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        text.default_backend(code).alias("backend"),
        text.schedule_label(code, F.col("schedule")).alias("schedule"),
        text.divide_or_null(t, F.col("n_samples") - 10).alias("quotient"),
        text.positive_or_null(t).alias("checked"),
        text.number_or_null(F.concat(F.col("n_samples").cast("string"), F.when(F.col("threads") == 3, "x").otherwise("")))
        .alias("parsed"),
        text.wrap(F.col("threads"), 3).alias("wrapped"),
        text.clamp(F.col("n_samples"), 5, 20).alias("clamped"),
        text.one_of(F.col("algorithm"), ["AntiKt", "CA", "Kt"], "algorithm").alias("algorithm")), digits=10)


@query
def group_ordinals(spark, sf_dir):
    rows = views.results(spark, sf_dir).select("code", "n_samples")
    return ordinals(rows, ["code", "n_samples"], "number").groupBy("code", "n_samples", "number").agg(
        F.count("*").alias("n"))


@query
def product_text(spark, sf_dir):
    """Comma lists and captured numbers of free text."""
    parts = views.table(spark, sf_dir, "part")
    items = text.comma_list(F.concat(F.lit(" a,, "), "p_brand", F.lit(" ,"), F.col("p_size").cast("string")))
    return parts.select(
        "p_partkey", F.concat_ws("|", items).alias("items"),
        text.captured(F.col("p_brand"), r"(\d)(\d)").alias("digit"),
        text.unpacked_name(F.concat("p_brand", F.lit(".hepmc3.gz"))).alias("unpacked"))


# Queries through files, written from the tables into the shared folder and read back

def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def manifest_events(spark, sf_dir):
    """Event files and their manifest: the events of every file, with the density that the manifest states."""
    folder = _folder(spark, "events")
    p = views.particles(spark, sf_dir)
    line = F.concat_ws(" ", F.lit("P"), F.col("idx") + 1, F.lit("0"), "pdgid", "px", "py", "pz", "e", F.lit("0.0"), "status")
    records = p.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("l")).select(
        F.concat(F.lit("run-"), F.col("event") % 5, F.lit(".hepmc3")).alias("name"), "event", F.concat(
            F.lit("E "), F.col("event"), F.lit(" 1 "), F.size("l"), F.lit("\nU GEV MM\n"),
            F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))
    sinks.write_named(records, folder, F.col("name"), fmt="text", order=["event"], columns=["value"])
    listed = records.groupBy(F.col("name").alias("File")).agg(F.count("*").cast("double").alias("mean_particles"))
    sinks.write_named(listed, folder, F.lit("manifest.csv"))
    events = event_files.read_manifest_events(spark, f"{folder}/manifest.csv", skip_events=3, buckets=16)
    return events.groupBy(F.col("listed_file").alias("File"), F.col("mean_particles").cast("long").alias("listed")).agg(
        F.count("*").alias("n_events"), F.sum(F.size("particles").cast("long")).alias("n_particles"), F.max("event").alias("last_event"))


@query
def scan_files(spark, sf_dir):
    """Result files of three layouts, named by their runs' parameters, read in one scan."""
    folder = _folder(spark, "results")
    rows = views.results(spark, sf_dir).withColumns({"backend": text.default_backend(F.col("code")), "backend_version": F.lit("1.0")})
    rows = rows.withColumn("n_threads", F.col("threads")).withColumn("threads", F.lit(1)).withColumn("name", sinks.run_name())
    rows = rows.withColumn("threads", F.col("n_threads"))
    columns = ["threads", "time_per_event", "code", "algorithm", "strategy", "radius", "power", "n_samples", "File"]
    layouts = {CODES[0]: columns, CODES[1]: [*columns[::-1], "schedule"], CODES[4]: ["File_path", *columns[:-1]]}
    paths = []
    for number, (code, layout) in enumerate(layouts.items()):
        paths.append(f"{folder}/{number}")
        sinks.write_named(rows.where(F.col("code") == code), paths[-1], F.col("name"), columns=layout)
    shown = scan.read_scan(spark, [f"{path}/*.csv" for path in paths])
    ticks = F.sum(F.round(F.col("time_per_event_seconds") * 1e10).cast("long"))
    return shown.groupBy("code", "algorithm", "strategy", "threads", "schedule", "input_file").agg(
        F.count("*").alias("n"), F.count("nsamples").alias("n_sampled"), ticks.alias("sum_ticks"))


@query
def variant_runs(spark, sf_dir):
    """Thread-run documents of one file each, some with other packages, odd types or broken off; the last are reported."""
    folder = _folder(spark, "runs")
    rows = views.results(spark, sf_dir).where("l_orderkey % 97 = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "threads", "algorithm", "strategy")
    body = F.to_json(F.struct(
        F.lit(True).alias("success"), "algorithm", "strategy", F.col("threads").alias("julia_threads"),
        F.map_from_arrays(F.array(F.concat(F.lit("Package"), F.col("l_suppkey") % 3)), F.array(
            F.struct(F.concat(F.lit("0."), F.col("l_suppkey") % 5).alias("version")))).alias("packages"),
        F.struct((F.col("l_partkey") / 8).alias("wall_time_seconds_median")).alias("summary"), F.lit(100).alias("measured_events")))
    body = F.when(F.col("l_partkey") % 7 == 0, F.replace(body, F.lit('"measured_events":100'), F.lit('"measured_events":"many"'))).otherwise(body)
    body = F.when(F.col("l_partkey") % 11 == 0, F.substring(body, 1, 40)).otherwise(body)
    sinks.write_named(rows.groupBy((F.col("l_orderkey") % 50).alias("k")).agg(
        F.min_by(body, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("value")), folder,
        F.concat(F.lit("run-"), F.col("k"), F.lit(".json")), fmt="text", columns=["value"])
    documents = tables.read_run_documents(spark, f"{folder}/*.json")
    runs = tables.variant_runs(documents)
    whole = runs.select(
        text.basename(F.col("source_file")).alias("name"), "algorithm", "strategy", "julia_threads", "measured_events",
        F.col("summary.wall_time_seconds_median").alias("seconds"), F.element_at(F.map_keys("package_versions"), 1).alias("package"),
        F.element_at(F.map_values("package_versions"), 1).alias("version"), F.lit(False).alias("broken"))
    broken = tables.broken_documents(documents).select(text.basename(F.col("source_file")).alias("name"), F.lit(True).alias("broken"))
    return rounded(whole.unionByName(broken, allowMissingColumns=True))


@query
def skipped_runs(spark, sf_dir):
    """The failed runs among thread-run documents, by file."""
    folder = _folder(spark, "skipped")
    rows = views.results(spark, sf_dir).groupBy((F.col("l_orderkey") % 40).alias("k")).agg(F.max("l_linenumber").alias("m"), F.count("*").alias("n"))
    document = F.to_json(F.struct((F.col("n") % 3 != 0).alias("success"), F.col("m").alias("threads")))
    sinks.write_named(rows.select("k", document.alias("value")), folder, F.concat(F.lit("run-"), F.col("k"), F.lit(".json")),
                      fmt="text", columns=["value"])
    return scan.skipped_runs(tables.read_thread_runs(spark, f"{folder}/*.json")).select(text.basename(F.col("source_file")).alias("name"))
