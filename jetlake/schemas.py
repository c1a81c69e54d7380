"""Spark types of the data model."""

from jetlake.constants import DEFAULT_CODE

MOMENTUM = "struct<px:double,py:double,pz:double,e:double>"
HISTORY = ("struct<parent1:int,parent2:int,child:int,jet:int,"
           "dij:double,max_dij:double>")

OLD_RESULT = ("File string, mean_particles double, File_path string, "
              "n_samples int, time_per_event double")
RESULT = OLD_RESULT + "".join(
    f", time_per_event_{s} double" for s in ("mean", "std", "median", "min", "max", "q25", "q75", "iqr")
) + (", code string, code_version string, algorithm string, strategy string, "
     "radius double, power double, threads int, schedule string, "
     "backend string, backend_version string")

_SUMMARY = ", ".join(
    f"{m}_{s}: double"
    for m in ("wall_time_seconds", "events_per_second", "time_per_event_seconds",
              "allocated_bytes_total", "gc_fraction")
    for s in ("min", "median", "max", "iqr"))
THREAD_RUN = f"""
    success boolean, error_message string, code string, code_version string,
    backend string, backend_version string, algorithm string, strategy string,
    R double, p double, input_file string, input_event_count int, measured_events int,
    nsamples int, repeats int, warmup_events int, julia_version string,
    threads int, julia_threads int, schedule string, sample_index int, timing_choice string,
    wall_time_seconds double, events_per_second double, time_per_event_seconds double,
    allocated_bytes_total bigint, allocated_bytes_per_event double,
    gc_time_seconds double, gc_fraction double,
    samples array<struct<sample_index: int, wall_time_seconds: double,
        events_per_second: double, time_per_event_seconds: double,
        allocated_bytes_total: bigint, allocated_bytes_per_event: double,
        gc_time_seconds: double, gc_fraction: double>>,
    summary struct<{_SUMMARY}>,
    hardware struct<machine: string, kernel: string, cpu_threads: int, cpu_model: string,
        total_memory_bytes: bigint>,
    git struct<repo_root: string, commit: string, short_commit: string, branch: string,
        is_dirty: boolean, remote_origin: string>,
    packages struct<{DEFAULT_CODE}: struct<name: string, version: string, uuid: string,
        tree_hash: string, git_revision: string, git_source: string, is_direct_dep: boolean,
        is_tracking_path: boolean, is_tracking_repo: boolean, source: string>>,
    benchmark_command string,
    runtime struct<julia_project: string,
        environment: struct<JULIA_NUM_GC_THREADS: string, JULIA_EXCLUSIVE: string>>,
    package_commit string, process_id int, timestamp string
"""
