"""Fixed values shared by readers and operators.

They are part of the file formats and of the published algorithm definitions,
so they are stated here once, as they are.
"""

# Clustering algorithms: family, and the fixed power of the distance measure
# (None where the caller chooses it).
ALGORITHMS = {
    "AntiKt": ("pp", -1.0),
    "CA": ("pp", 0.0),
    "Kt": ("pp", 1.0),
    "GenKt": ("pp", None),
    "EEKt": ("EEKt", None),
    "Durham": ("Durham", 1.0),
}
STRATEGIES = ("Best", "N2Plain", "N2Tiled")
SCHEMES = ("E", "pt", "pt2")
SCHEME_NAMES = {"": "E", "E_scheme": "E", "pt_scheme": "pt", "pt2_scheme": "pt2"}

# Codes that appear in result tables and the language backend of each.
CODES = ("JetReconstruction", "Fastjet", "AkTPython", "AkTNumPy", "CJetReconstruction")
CODE_BACKENDS = {
    "JetReconstruction": "Julia",
    "Fastjet": "C++",
    "CJetReconstruction": "C++",
    "AkTPython": "Python",
    "AkTNumPy": "Python",
}
# Older tables spell this one differently.
CODE_ALIASES = {"FastJet": "Fastjet", "Julia": "JetReconstruction"}
CODE_LABELS = {
    "Fastjet": "FastJet v3.5.1",
    "CJetReconstruction": "JetReconstruction.jl\n(JuliaC.jl)",
    "JetReconstruction": "JetReconstruction.jl",
}
PREFERRED_CODES = ("Fastjet", "JetReconstruction", "CJetReconstruction")
DEFAULT_CODE = "JetReconstruction"
DEFAULT_JSON_BACKEND = "Julia"
STATIC_SCHEDULE_CODE = "Fastjet"
DEFAULT_SCHEDULE = "julia_threads_default"

# History markers.
NO_PARENT = -2
BEAM = -1

# Columns of a merged thread-scan row, in output order: name and Spark type.
SCAN_ROW = (
    ("source_file", "string"), ("source_format", "string"),
    ("code", "string"), ("code_version", "string"),
    ("backend", "string"), ("backend_version", "string"),
    ("threads", "int"), ("schedule", "string"), ("events_per_second", "double"),
    ("algorithm", "string"), ("strategy", "string"), ("R", "double"), ("p", "double"),
    ("input_file", "string"), ("input_event_count", "int"), ("measured_events", "int"),
    ("nsamples", "int"), ("repeats", "int"), ("warmup_events", "int"),
    ("julia_version", "string"), ("wall_time_seconds", "double"),
    ("time_per_event_seconds", "double"), ("allocated_bytes_total", "double"),
    ("allocated_bytes_per_event", "double"), ("gc_fraction", "double"),
    ("benchmark_command", "string"), ("repo_commit", "string"),
    ("repo_short_commit", "string"), ("repo_branch", "string"),
    ("repo_dirty", "boolean"), ("remote_origin", "string"),
    ("package_commit", "string"), ("jetreconstruction_version", "string"),
    ("jetreconstruction_source", "string"), ("cpu_threads", "int"),
    ("cpu_model", "string"), ("machine", "string"), ("kernel", "string"),
    ("total_memory_bytes", "bigint"), ("julia_project", "string"),
    ("julia_num_gc_threads", "string"), ("julia_exclusive", "string"),
)
WORKLOAD = ("code", "code_version", "backend", "backend_version",
            "algorithm", "strategy", "R", "p", "input_file")
SCAN_METRICS = ("events_per_second", "wall_time_seconds", "time_per_event_seconds",
                "allocated_bytes_total", "allocated_bytes_per_event", "gc_fraction")

# Statistics columns of a current result table, in file order.
TIMING_STATS = ("mean", "std", "median", "min", "max", "q25", "q75", "iqr")

# Figure metrics of a thread scan.
METRIC_COLUMNS = {
    "speedup": "speedup_median",
    "efficiency": "efficiency_median",
    "throughput": "events_per_second_median",
}

# |PDG id| of charged particles that are not hadrons: quarks, leptons, bosons.
CHARGED_ELEMENTARY = (*range(1, 9), 11, 13, 15, 17, 24, 34, 37)
