"""Event and benchmark views over the generic tables, in SQL that two engines run unchanged."""

from pyspark.sql import DataFrame

from jetlake.constants import CODES

# Particles: one row each, many per event.  {event} picks the event column.
PARTICLE_ROWS = """
SELECT {event} AS event, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS status,
  CASE l_returnflag WHEN 'A' THEN 211 WHEN 'R' THEN -211 ELSE 22 END AS pdgid,
  px, py, pz, sqrt(px*px + py*py + pz*pz + CAST(0.01948 AS DOUBLE)) AS e
FROM (SELECT *,
  CAST((l_orderkey*7919 + CAST(l_linenumber AS BIGINT)*104729 + l_partkey*31) % 20011 - 10005 AS DOUBLE) / 100 AS px,
  CAST((l_orderkey*104723 + l_suppkey*6151 + CAST(l_linenumber AS BIGINT)*17) % 20021 - 10010 AS DOUBLE) / 100 AS py,
  CAST((l_partkey*15485863 + l_orderkey*32452843 + CAST(l_linenumber AS BIGINT)*7) % 40009 - 20004 AS DOUBLE) / 100 AS pz
  FROM lineitem) m
"""
# The order in which particles enter their event.
INPUT_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

NUMBERED = (
    "SELECT event, CAST(row_number() OVER (PARTITION BY event ORDER BY {order}) - 1 AS INT) AS idx, "
    "status, pdgid, px, py, pz, e FROM ({rows}) r")

# Result rows in the current table layout.
RESULTS = f"""
SELECT CASE l_returnflag WHEN 'A' THEN '{CODES[0]}' WHEN 'R' THEN '{CODES[1]}' ELSE '{CODES[4]}' END AS code,
  '1.' || CAST(l_suppkey % 2 AS VARCHAR(4)) AS code_version,
  CASE l_partkey % 3 WHEN 0 THEN 'AntiKt' WHEN 1 THEN 'CA' ELSE 'Kt' END AS algorithm,
  CASE l_linestatus WHEN 'O' THEN 'N2Tiled' ELSE 'N2Plain' END AS strategy,
  CAST(CASE l_orderkey % 2 WHEN 0 THEN 0.4 ELSE 1.0 END AS DOUBLE) AS radius,
  CAST(CASE l_partkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END AS DOUBLE) AS power,
  CASE l_suppkey % 2 WHEN 0 THEN 'events-small.hepmc3' ELSE 'events-large.hepmc3' END AS File,
  CASE l_suppkey % 2 WHEN 0 THEN 'data/events-small.hepmc3' ELSE 'data/events-large.hepmc3' END AS File_path,
  CAST(CASE l_suppkey % 2 WHEN 0 THEN 43.05 ELSE 431.18 END AS DOUBLE) AS mean_particles,
  l_linenumber AS threads,
  CASE WHEN l_returnflag <> 'R' THEN '' WHEN l_suppkey % 3 = 0 THEN 'static'
       WHEN l_suppkey % 3 = 1 THEN 'dynamic' ELSE 'guided' END AS schedule,
  CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS n_samples,
  CASE WHEN l_quantity = 50 THEN NULL ELSE l_extendedprice / 100 END AS time_per_event,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem
"""

# Benchmark trials and timed samples.
TRIALS = "SELECT event_type AS workload, event_id AS trial, value AS time_us FROM events"
SAMPLES = """
SELECT event_type AS run, event_id AS sample_index, value AS wall_time_seconds,
  CAST(100 + user_id % 7 AS INT) AS measured_events,
  CAST(user_id * 1024 AS BIGINT) AS allocated_bytes_total,
  value * CAST(user_id % 10 AS DOUBLE) / 16 AS gc_time_seconds
FROM events
"""


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark, sf_dir, sql, *names) -> DataFrame:
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def particle_rows(spark, sf_dir, event="l_partkey") -> DataFrame:
    """Particles without their number in the event: no shuffle."""
    return _query(spark, sf_dir, PARTICLE_ROWS.format(event=event), "lineitem")


def particles(spark, sf_dir, event="l_partkey") -> DataFrame:
    """Particles numbered within their event (``idx``), whatever their status."""
    rows = PARTICLE_ROWS.format(event=event)
    return _query(spark, sf_dir, NUMBERED.format(order=INPUT_ORDER, rows=rows), "lineitem")


def results(spark, sf_dir) -> DataFrame:
    return _query(spark, sf_dir, RESULTS, "lineitem")


def trials(spark, sf_dir) -> DataFrame:
    return _query(spark, sf_dir, TRIALS, "events")


def samples(spark, sf_dir) -> DataFrame:
    return _query(spark, sf_dir, SAMPLES, "events")
