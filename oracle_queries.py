"""Oracle SQL of the registered queries, for DuckDB over the same tables.

Clustering is stated as a recursive query that finds the smallest distance of
each event over all its pairs, step by step: an independent formulation of what
the kernel computes.
"""

from jetlake.constants import CODE_BACKENDS, CODE_LABELS, CODES, DEFAULT_SCHEDULE, PREFERRED_CODES
from jetlake.plans import views

NUMBERED = views.NUMBERED.format(order=views.INPUT_ORDER, rows=views.PARTICLE_ROWS.format(event="l_partkey"))
# Final-state particles, numbered without gaps.
PART = f"""part AS MATERIALIZED (
  SELECT event, CAST(row_number() OVER (PARTITION BY event ORDER BY idx) - 1 AS INT) AS idx, px, py, pz, e,
         CAST(count(*) OVER (PARTITION BY event) AS INT) AS n
  FROM ({NUMBERED}) q WHERE status = 1)"""

PHI = "CASE WHEN atan2(py, px) < 0 THEN atan2(py, px) + 2*pi() ELSE atan2(py, px) END"
PT = "sqrt(px*px + py*py)"
RAP = "0.5*ln((e+pz)/(e-pz))"


def _weight(family, p, who):
    size = f"{who}.kt2" if family == "pp" else f"({who}.e*{who}.e)"
    if p == 0:
        return "CAST(1 AS DOUBLE)"
    return {1: size, -1: f"1/{size}"}.get(p, f"power({size}, {p})")


def _pair(family, R, p):
    low = f"least({_weight(family, p, 'a')}, {_weight(family, p, 'b')})"
    if family == "pp":
        return f"""{low} * (power(a.rap-b.rap, 2) + power(CASE WHEN abs(a.phi-b.phi) > pi()
            THEN 2*pi() - abs(a.phi-b.phi) ELSE abs(a.phi-b.phi) END, 2)) / CAST({R * R:.17g} AS DOUBLE)"""
    angle = "(1 - (a.px*b.px + a.py*b.py + a.pz*b.pz) / (a.p3 * b.p3))"
    if family == "Durham":
        return f"2 * {low} * {angle}"
    return f"{low} * {angle} / " + (f"(1 - cos({R}))" if R < 3.14 else f"(3 + cos({R}))")


def _merge(scheme):
    if scheme == "E":
        return "x.px+y.px AS px, x.py+y.py AS py, x.pz+y.pz AS pz, x.e+y.e AS e", ""
    w = "w.pt" if scheme == "pt" else "w.pt*w.pt"
    wx, wy = w.replace("w.", "x."), w.replace("w.", "y.")
    turn = ("(CASE WHEN y.phi-x.phi > pi() THEN y.phi-x.phi-2*pi() "
            "WHEN y.phi-x.phi < -pi() THEN y.phi-x.phi+2*pi() ELSE y.phi-x.phi END)")
    phi = f"(x.phi + {wy}*{turn}/({wx}+{wy}))"
    rap = f"(({wx}*x.rap + {wy}*y.rap)/({wx}+{wy}))"
    pt = "(x.pt+y.pt)"
    sinh, cosh = f"(exp({rap})-exp(-{rap}))/2", f"(exp({rap})+exp(-{rap}))/2"
    return f"{pt}*cos({phi}) AS px, {pt}*sin({phi}) AS py, {pt}*{sinh} AS pz, {pt}*{cosh} AS e", "massless"


def cluster(name="st", source="part", family="pp", R=0.4, p=-1, scheme="E", key="event", stop="", dcut=None):
    """CTE of all clustering states: objects after each step, with the step's distance."""
    merge, massless = _merge(scheme)
    e0 = "sqrt(px*px+py*py+pz*pz)" if massless else "e"
    beam = "" if family == "Durham" else (
        f"UNION ALL SELECT a.{key}, {_weight(family, p, 'a')}, a.id, 2147483647 FROM act a")
    cut = f"HAVING min(d) <= {dcut}" if dcut is not None else ""
    return f"""{name} AS (
  SELECT {key}, 0 AS step, idx AS id, 0 AS done, px, py, pz, {e0} AS e, n AS nxt, n,
         CAST(0 AS DOUBLE) AS d, [idx] AS members
  FROM {source}
  UNION ALL
  (WITH act AS (SELECT *, px*px + py*py AS kt2, {PT} AS pt, {RAP} AS rap, atan2(py, px) AS phi,
                       sqrt(px*px+py*py+pz*pz) AS p3 FROM {name} WHERE done = 0 {stop}),
   pr AS (SELECT a.{key}, {_pair(family, R, p)} AS d, a.id AS i, b.id AS j
          FROM act a JOIN act b ON a.{key} = b.{key} AND a.id < b.id {beam}),
   best AS (SELECT {key}, arg_min(struct_pack(d := d, i := i, j := j), struct_pack(d := d, i := i, j := j)) AS m
            FROM pr GROUP BY {key} {cut})
   SELECT s.{key}, s.step+1, s.id, CASE WHEN b.m.j = 2147483647 AND s.id = b.m.i THEN 1 ELSE 0 END,
          s.px, s.py, s.pz, s.e, s.nxt+1, s.n, b.m.d, s.members
   FROM act s JOIN best b ON s.{key} = b.{key}
   WHERE NOT (b.m.j <> 2147483647 AND s.id IN (b.m.i, b.m.j))
   UNION ALL
   SELECT t.{key}, t.step, t.id, 0, t.px, t.py, t.pz, t.e, t.nxt, t.n, t.d, t.members
   FROM (SELECT x.{key}, x.step+1 AS step, x.nxt AS id, {merge}, x.nxt+1 AS nxt, x.n, b.m.d AS d,
                list_concat(x.members, y.members) AS members
         FROM best b JOIN act x ON x.{key} = b.{key} AND x.id = b.m.i
                     JOIN act y ON y.{key} = b.{key} AND y.id = b.m.j) t))"""


def _shown(source, where):
    return f"""
SELECT event, CAST(row_number() OVER (PARTITION BY event ORDER BY {PT} DESC) - 1 AS INT) AS jet_rank,
  round({RAP}, 5) + 0.0 AS rap, round({PHI}, 5) + 0.0 AS phi, round({PT}, 5) + 0.0 AS pt
FROM {source} WHERE {where}"""


def inclusive(ptmin=5.0, **options):
    return f"WITH RECURSIVE {PART}, {cluster(**options)} {_shown('st', f'done = 1 AND {PT} >= {ptmin}')}"


def exclusive_njets(k, **options):
    state = cluster(stop=f"AND n - step > {k}", **options)
    few = f"SELECT event, NULL, NULL, NULL, NULL FROM st WHERE step = 0 AND n < {k} GROUP BY event"
    return f"WITH RECURSIVE {PART}, {state} {_shown('st', f'done = 0 AND n - step = {k}')} UNION ALL {few}"


def exclusive_dcut(dcut, **options):
    state = cluster(dcut=dcut, **options)
    return f"""WITH RECURSIVE {PART}, {state},
ends AS (SELECT event, max(step) AS step FROM st GROUP BY event),
alive AS (SELECT st.* FROM st JOIN ends USING (event, step) WHERE done = 0)
{_shown('alive', 'true')}"""


# Which objects each step used up, and what it made.
STEPS = """
gone AS (SELECT a.event, a.step, a.n, min(a.id) AS first, CASE WHEN count(*) = 2 THEN max(a.id) ELSE -2 END AS second
         FROM st a LEFT JOIN st b ON b.event = a.event AND b.id = a.id AND b.step = a.step + 1 AND b.done = 0
         WHERE a.done = 0 AND b.id IS NULL GROUP BY a.event, a.step, a.n),
took AS (SELECT event, step, max(d) AS d FROM st WHERE step > 0 GROUP BY event, step),
steps AS (SELECT g.event, g.n + g.step AS id, g.first AS p1, g.second AS p2, t.d,
                 max(t.d) OVER (PARTITION BY g.event ORDER BY g.step) AS max_d
          FROM gone g JOIN took t ON t.event = g.event AND t.step = g.step + 1)"""

MEASURES = f"{PT} AS pt, {RAP} AS rap, {PHI} AS phi, (e+pz)*(e-pz) - px*px - py*py AS m2"


def history():
    return f"""WITH RECURSIVE {PART}, {cluster()}, {STEPS},
entries AS (SELECT event, idx AS id, -2 AS parent1, -2 AS parent2, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS max_d FROM part
  UNION ALL SELECT event, id, p1 + 1, CASE WHEN p2 < 0 THEN -1 ELSE p2 + 1 END, d, max_d FROM steps),
child AS (SELECT event, p1 AS id, id + 1 AS child FROM steps
          UNION ALL SELECT event, p2, id + 1 FROM steps WHERE p2 >= 0)
SELECT event, CAST(id + 1 AS INT) AS entry, CAST(parent1 AS INT) AS parent1, CAST(parent2 AS INT) AS parent2,
  CAST(coalesce(child, -1) AS INT) AS child,
  round(ln(d), 5) + 0.0 AS log_dij, round(ln(max_d), 5) + 0.0 AS log_max_dij
FROM entries LEFT JOIN child USING (event, id)"""


def sequence_jets():
    return f"""WITH RECURSIVE {PART}, {cluster(R=1.0)},
made AS (SELECT event, id, px, py, pz, e FROM st WHERE step = 0
         UNION ALL SELECT event, id, px, py, pz, e FROM st WHERE step > 0 AND id = n + step - 1)
SELECT event, CAST(row_number() OVER (PARTITION BY event ORDER BY id) AS INT) AS jet_id,
  round(px, 5) + 0.0 AS px, round(py, 5) + 0.0 AS py, round(pz, 5) + 0.0 AS pz, round(e, 5) + 0.0 AS e FROM made"""


def param_scan():
    parts, states = [], []
    for algorithm, p in (("AntiKt", -1), ("CA", 0), ("Kt", 1)):
        for R in (0.4, 1.0):
            name = f"s{len(states)}"
            states.append(cluster(name, R=R, p=p))
            parts.append(f"""SELECT '{algorithm}' AS algorithm, CAST({R} AS DOUBLE) AS R, CAST({p} AS DOUBLE) AS p,
  event, CAST(count(*) FILTER (WHERE done = 1 AND {PT} >= 5) AS INT) AS n_jets,
  round(coalesce(sum({PT}) FILTER (WHERE done = 1 AND {PT} >= 5), 0), 5) AS sum_pt FROM {name} GROUP BY event""")
    return f"WITH RECURSIVE {PART}, {', '.join(states)} " + " UNION ALL ".join(parts)


# Beam jets of the CA clustering that substructure starts from, numbered in beam order.
CA_JETS = f"""jets AS (SELECT event, id, px, py, pz, e, members,
    CAST(row_number() OVER (PARTITION BY event ORDER BY step) - 1 AS INT) AS jet_id
  FROM st WHERE done = 1),
chosen AS (SELECT *, event * 100000 + jet_id AS jet FROM jets WHERE {PT} >= 2.0),
inner_part AS (SELECT jet, px, py, pz, e, CAST(count(*) OVER (PARTITION BY jet) AS INT) AS n,
    CAST(row_number() OVER (PARTITION BY jet ORDER BY idx) - 1 AS INT) AS idx
  FROM (SELECT event, jet, unnest(members) AS idx FROM chosen) c JOIN part USING (event, idx))"""


def _subjets(R, keep):
    """Recluster each jet with CA and sum the subjets that ``keep`` chooses."""
    return f"""WITH RECURSIVE {PART}, {cluster(R=1.0, p=0)}, {CA_JETS},
{cluster("sub", "inner_part", R=R, p=0, key="jet")},
subs AS (SELECT s.jet, s.px, s.py, s.pz, s.e, sqrt(c.px*c.px + c.py*c.py) AS jet_pt,
    row_number() OVER (PARTITION BY s.jet ORDER BY sqrt(s.px*s.px + s.py*s.py) DESC) AS place
  FROM sub s JOIN chosen c USING (jet) WHERE s.done = 1),
total AS (SELECT jet, sum(px) AS px, sum(py) AS py, sum(pz) AS pz, sum(e) AS e FROM subs WHERE {keep} GROUP BY jet)
SELECT c.event, c.jet_id, round(sqrt(t.px*t.px + t.py*t.py), 4) + 0.0 AS pt,
  round(0.5*ln((t.e+t.pz)/(t.e-t.pz)), 4) + 0.0 AS rap
FROM chosen c LEFT JOIN total t USING (jet)"""


def _walked(states, steps, objects, start, size, accept):
    """Follow the branch with more ``size`` until ``accept`` or an undivided object."""
    return f"""{states}, {steps}, {objects},
walk AS (
  SELECT event, jet_id, id, 0 AS ended FROM {start}
  UNION ALL
  SELECT w.event, w.jet_id,
    CASE WHEN {accept} THEN w.id WHEN a.{size} >= b.{size} THEN a.id ELSE b.id END,
    CASE WHEN {accept} THEN 1 ELSE 0 END
  FROM walk w JOIN steps s ON s.event = w.event AND s.id = w.id AND s.p2 >= 0
    JOIN objects a ON a.event = s.event AND a.id = s.p1
    JOIN objects b ON b.event = s.event AND b.id = s.p2
    JOIN objects o ON o.event = s.event AND o.id = w.id
  WHERE w.ended = 0),
tagged AS (SELECT w.event, w.jet_id, o.px, o.py, o.pz, o.e FROM walk w
           JOIN objects o ON o.event = w.event AND o.id = w.id WHERE w.ended = 1)"""


_DR2 = """(power(a.rap-b.rap, 2) + power(CASE WHEN abs(a.phi-b.phi) > pi()
    THEN 2*pi() - abs(a.phi-b.phi) ELSE abs(a.phi-b.phi) END, 2))"""
_OBJECTS = f"""objects AS (SELECT event, id, px, py, pz, e, {MEASURES} FROM st WHERE step = 0
  UNION ALL SELECT event, id, px, py, pz, e, {MEASURES} FROM st WHERE step > 0 AND id = n + step - 1)"""
_TAG_OUT = """
SELECT c.event, c.jet_id, round(sqrt(t.px*t.px + t.py*t.py), 4) + 0.0 AS pt,
  round(0.5*ln((t.e+t.pz)/(t.e-t.pz)), 4) + 0.0 AS rap
FROM {jets} c LEFT JOIN tagged t USING (event, jet_id)"""


def mass_drop():
    accept = f"""(greatest(a.m2, b.m2) < o.m2 * CAST(0.4489 AS DOUBLE)
      AND power(least(a.pt, b.pt), 2) * {_DR2} > o.m2 * CAST(0.09 AS DOUBLE))"""
    walked = _walked(f"{PART}, {cluster(R=1.0, p=0)}, {CA_JETS}", STEPS, _OBJECTS, "chosen", "m2", accept)
    return f"WITH RECURSIVE {walked} {_TAG_OUT.format(jets='chosen')}"


def soft_drop():
    accept = f"(least(a.pt, b.pt)/(a.pt+b.pt) > CAST(0.1 AS DOUBLE) * {_DR2})"
    first = f"{PART}, {cluster('st0', R=1.0, p=0)}, {CA_JETS.replace('FROM st ', 'FROM st0 ')}"
    again = cluster("st1", "inner_part", R=1.0, p=0, key="jet")
    renamed = "st AS (SELECT jet AS event, * EXCLUDE (jet) FROM st1)"
    hardest = f"""start AS (SELECT event, 0 AS jet_id, id FROM st WHERE done = 1
      QUALIFY row_number() OVER (PARTITION BY event ORDER BY {PT} DESC) = 1)"""
    walked = _walked(f"{first}, {again}, {renamed}, {hardest}", STEPS, _OBJECTS, "start", "pt", accept)
    return f"""WITH RECURSIVE {walked}
SELECT c.event, c.jet_id, round(sqrt(t.px*t.px + t.py*t.py), 4) + 0.0 AS pt,
  round(0.5*ln((t.e+t.pz)/(t.e-t.pz)), 4) + 0.0 AS rap
FROM chosen c LEFT JOIN tagged t ON t.event = c.jet"""


def tied_events():
    """First steps of events whose particles have one of seven momenta: many distances are equal."""
    return f"""WITH {PART.replace("px, py, pz, e,", "l_suppkey % 7 AS kind,", 1).replace("FROM (" + NUMBERED, "FROM (" + NUMBERED.replace("px, py, pz, e FROM", "l_suppkey FROM"))},
seven AS (SELECT *, sqrt(px*px + py*py + pz*pz + CAST(0.01948 AS DOUBLE)) AS e FROM (SELECT k AS kind,
  CAST(3 + k * k AS DOUBLE) AS px, CAST(7 * k - 20 AS DOUBLE) AS py, CAST(11 * k * k - 50 * k AS DOUBLE) AS pz FROM range(7) r(k))),
act AS (SELECT p.event, p.idx AS id, px*px + py*py AS kt2, {RAP} AS rap, {PHI} AS phi FROM part p JOIN seven USING (kind)),
steps AS (SELECT a.event, CASE WHEN a.rap = b.rap AND a.phi = b.phi THEN 0 ELSE {_pair("pp", 0.4, -1)} END AS d, a.id AS i, b.id AS j
  FROM act a JOIN act b ON a.event = b.event AND a.id < b.id
  UNION ALL SELECT a.event, {_weight("pp", -1, "a")}, a.id, 2147483647 FROM act a),
best AS (SELECT event, arg_min(struct_pack(d := d, i := i, j := j), struct_pack(d := d, i := i, j := j)) AS m FROM steps GROUP BY event)
SELECT event, CAST(m.i AS INT) AS parent1, CAST(CASE WHEN m.j = 2147483647 THEN -1 ELSE m.j END AS INT) AS parent2,
  round(m.d, 9) + 0.0 AS dij FROM best"""


def clustering_queries():
    antikt = inclusive()
    counts = f"WITH RECURSIVE {PART}, {cluster(p=0)} "
    documents = f"WITH RECURSIVE {PART}, {cluster()} "
    return {
        "antikt_inclusive": antikt,
        "ca_inclusive": inclusive(p=0),
        "kt_inclusive": inclusive(p=1),
        "genkt_inclusive": inclusive(p=-0.5),
        "eekt_inclusive": inclusive(family="EEKt", R=1.0, p=-1),
        "scheme_pt": inclusive(R=1.0, scheme="pt"),
        "scheme_pt2": inclusive(R=1.0, scheme="pt2"),
        "strategy_plain": inclusive(R=1.0),
        "strategy_tiled": inclusive(R=1.0),
        "durham_exclusive": exclusive_njets(3, family="Durham", p=1),
        "eekt_exclusive": exclusive_njets(2, family="EEKt", R=4.0, p=1),
        "durham_dcut": exclusive_dcut(2000.0, family="Durham", p=1),
        "kt_exclusive_njets": exclusive_njets(4, p=1),
        "kt_exclusive_dcut": exclusive_dcut(400.0, p=1),
        "first_merge": f"""WITH RECURSIVE {PART}, {cluster(stop="AND step = 0")}, {STEPS}
SELECT event, CAST(p1 AS INT) AS parent1, CAST(CASE WHEN p2 < 0 THEN -1 ELSE p2 END AS INT) AS parent2,
  round(ln(d), 5) + 0.0 AS log_dij FROM steps WHERE id = (SELECT n FROM part WHERE part.event = steps.event LIMIT 1)""",
        "tied_events": tied_events(),
        "history_rows": history(),
        "sequence_jets": sequence_jets(),
        "jet_count_per_file": counts + f"""SELECT event % 10 AS file,
  CAST(count(*) FILTER (WHERE done = 1 AND {PT} >= 2) AS BIGINT) AS n_jets FROM st GROUP BY 1""",
        "jet_documents": documents + f"""SELECT event AS jetid,
  CAST(count(*) FILTER (WHERE done = 1 AND {PT} >= 100) AS INT) AS n_jets,
  coalesce(string_agg(CAST(CAST(round({PT} * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY {PT} DESC)
    FILTER (WHERE done = 1 AND {PT} >= 100), '') AS pts FROM st GROUP BY event""",
        "param_scan": param_scan(),
        "filter": _subjets(0.3, "place <= 3"),
        "trim": _subjets(0.3, "sqrt(px*px + py*py) >= jet_pt * CAST(0.3 AS DOUBLE)"),
        "jet_constituents": f"""WITH RECURSIVE {PART}, {cluster(R=1.0, p=0)}, {CA_JETS}
SELECT c.event, c.jet_id, CAST(count(*) AS INT) AS n_members, round(sum(q.e), 4) + 0.0 AS sum_e,
  round(sqrt(c.px*c.px + c.py*c.py), 4) + 0.0 AS pt
FROM (SELECT *, unnest(members) AS idx FROM chosen) c JOIN part q ON q.event = c.event AND q.idx = c.idx
GROUP BY c.event, c.jet_id, c.px, c.py""",
        "object_members": f"""WITH RECURSIVE {PART}, {cluster(R=1.0, p=0)}
SELECT event, id + 1 AS entry, CAST(len(members) AS INT) AS n_members, array_to_string(list_sort(members), ',') AS members
FROM st WHERE step > 0 AND id = n + step - 1""",
        "mass_drop": mass_drop(),
        "soft_drop": soft_drop(),
        "dump_round_trip": inclusive(50.0, R=1.0),
        "multiplicity": f"""WITH {PART} SELECT event % 10 AS file, count(DISTINCT event) AS n_events,
  round(count(*) / CAST(count(DISTINCT event) AS DOUBLE), 5) AS mean_particles FROM part GROUP BY 1""",
    }


ROWS = views.PARTICLE_ROWS.format(event="l_partkey")
FILES = f"SELECT DISTINCT event % 5 AS file, event FROM ({ROWS}) r"


def event_queries():
    columns = "round(px, 5) + 0.0 AS px, round(py, 5) + 0.0 AS py, round(pz, 5) + 0.0 AS pz, round(e, 5) AS e, status"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY file ORDER BY event) AS position FROM ({FILES}) f"
    counts = f"""SELECT event, count(*) FILTER (WHERE status = 1) AS n_particles,
      count(*) FILTER (WHERE status = 1 AND abs(pdgid) = 211) AS charged FROM ({ROWS}) r GROUP BY event"""
    return {
        "kinematics": f"""SELECT event, idx, round({PT}, 5) AS pt, round({RAP}, 5) + 0.0 AS rap, round({PHI}, 5) AS phi,
  round(sqrt((e+pz)*(e-pz) - px*px - py*py), 2) AS mass FROM ({NUMBERED}) q""",
        "final_state": f"SELECT event, idx, {columns} FROM ({NUMBERED}) q WHERE status = 1",
        "event_window": f"SELECT file, event FROM ({ranked}) r WHERE position > 10 AND position <= 100",
        "event_skip": f"SELECT file, event FROM ({ranked}) r WHERE position > 25",
        "event_position": ranked,
        "hepmc_round_trip": f"""SELECT event, CAST(idx + 1 AS INT) AS barcode, pdgid, {columns}
  FROM ({NUMBERED}) q WHERE status = 1""",
        "multiplicity_hist": f"""SELECT bin, count(*) AS count, CAST(-0.5 + (bin - 1) * 8 AS DOUBLE) AS low FROM (
  SELECT CAST(CASE WHEN charged < -0.5 THEN 0 WHEN charged >= 799.5 THEN 101
    ELSE floor((charged + 0.5) / 8.0) + 1 END AS INT) AS bin FROM ({counts}) c) b GROUP BY bin""",
        "multiplicity_auto_hist": histogram(f"SELECT n_particles FROM ({counts}) c", "n_particles", []),
        "array_argmin": """SELECT vec_id, round(CAST(low AS DOUBLE), 5) + 0.0 AS low,
  CAST(list_position(embedding, low) AS INT) AS at, round(CAST(low8 AS DOUBLE), 5) + 0.0 AS low8,
  CAST(list_position(embedding, low8) AS INT) AS at8
FROM (SELECT *, list_min(embedding) AS low, list_min(embedding[1:8]) AS low8 FROM embeddings) t""",
    }


def histogram(source, value, keys):
    k = "".join(f"{c}, " for c in keys)
    on = f"USING ({', '.join(keys)})" if keys else "ON true"
    return f"""WITH src AS ({source}),
stats AS (SELECT {k}count({value}) AS n, min({value}) AS low0, max({value}) AS high0,
    quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) AS iqr FROM src {'GROUP BY ' + ', '.join(keys) if keys else ''}),
w AS (SELECT *, ceil(2 * iqr / power(n, 1.0/3.0)) AS raw, CASE WHEN ceil(2 * iqr / power(n, 1.0/3.0)) <= 0 THEN 1
    ELSE ceil(2 * iqr / power(n, 1.0/3.0)) END AS width FROM stats),
b AS (SELECT *, CAST(least(greatest(ceil((high0 - low0) / width), 1), 80) AS INT) AS n_bins FROM w),
h AS (SELECT *, CASE WHEN high0 > low0 THEN CAST(high0 - low0 AS DOUBLE) / n_bins ELSE width END AS step FROM b),
c AS (SELECT {k}n_bins, low0, step, CAST(least(floor(({value} - low0) / step), n_bins - 1) AS INT) AS bin
      FROM src JOIN h {on})
SELECT {k}n_bins, bin, round(CAST(low0 + bin * step AS DOUBLE), 8) AS low,
  round(CAST(low0 + (bin + 1) * step AS DOUBLE), 8) AS high,
  count(*) AS count FROM c GROUP BY ALL"""


_STATS = """count(time_us) AS n_samples, round(avg(time_us), 5) AS mean,
  round(coalesce(stddev_samp(time_us), 0), 5) AS std, round(median(time_us), 5) AS median,
  round(min(time_us), 5) AS min, round(max(time_us), 5) AS max, round(quantile_cont(time_us, 0.25), 5) AS q25,
  round(quantile_cont(time_us, 0.75), 5) AS q75,
  round(quantile_cont(time_us, 0.75) - quantile_cont(time_us, 0.25), 5) AS iqr"""
_METRICS = f"""SELECT *, measured_events / wall_time_seconds AS events_per_second,
  wall_time_seconds / measured_events AS time_per_event_seconds,
  allocated_bytes_total / CAST(measured_events AS DOUBLE) AS allocated_bytes_per_event,
  CASE WHEN wall_time_seconds = 0 THEN 0 ELSE gc_time_seconds / wall_time_seconds END AS gc_fraction
FROM ({views.SAMPLES}) s"""


def trial_queries():
    stat = ("mean", "std", "median", "min", "max", "q25", "q75", "iqr")
    shown = ", ".join(f"{s} AS time_per_event_{s}" for s in stat)
    hidden = ", ".join(f"{'min' if s == 'min' else 'CAST(NULL AS DOUBLE)'} AS time_per_event_{s}" for s in stat)
    full = f"SELECT workload, {_STATS} FROM ({views.TRIALS}) t GROUP BY workload"
    metrics = ("wall_time_seconds", "events_per_second", "allocated_bytes_total", "gc_fraction")
    summary = ", ".join(
        f"round(CAST(min({m}) AS DOUBLE), 5) AS {m}_min, round(median({m}), 5) AS {m}_median, "
        f"round(CAST(max({m}) AS DOUBLE), 5) AS {m}_max, "
        f"round(quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25), 5) AS {m}_iqr" for m in metrics)
    return {
        "trial_stats": full,
        "trial_outliers": f"""WITH t AS ({views.TRIALS}), q AS (SELECT workload, quantile_cont(time_us, 0.25) AS a,
    quantile_cont(time_us, 0.75) AS b FROM t GROUP BY workload)
SELECT *, 'full' AS selection FROM ({full}) f UNION ALL
SELECT *, 'outlier_excluded' FROM (SELECT workload, {_STATS} FROM t JOIN q USING (workload)
  WHERE time_us BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) GROUP BY workload) k""",
        "trial_histogram": histogram(views.TRIALS, "time_us", ["workload"]),
        "result_table": f"""SELECT workload, n_samples, min AS time_per_event, {shown}, false AS external FROM ({full}) a
UNION ALL SELECT workload, n_samples, min, {hidden}, true FROM ({full}) b""",
        "sample_moments": f"""SELECT run, count(*) AS n_samples, round(avg(wall_time_seconds) / 100, 7) AS mean,
  round(stddev_samp(wall_time_seconds) / 100, 7) AS sigma, round(min(wall_time_seconds) / 100, 7) AS lowest,
  round(100 / min(wall_time_seconds), 7) AS event_rate FROM ({views.SAMPLES}) s GROUP BY run""",
        "sample_metrics": f"""SELECT run, sample_index, round(wall_time_seconds, 8) AS wall_time_seconds,
  allocated_bytes_total, round(gc_time_seconds, 8) AS gc_time_seconds,
  round(events_per_second, 8) AS events_per_second, round(time_per_event_seconds, 8) AS time_per_event_seconds,
  round(allocated_bytes_per_event, 8) AS allocated_bytes_per_event, round(gc_fraction, 8) AS gc_fraction
FROM ({_METRICS}) m""",
        "sample_summary": f"SELECT run, {summary} FROM ({_METRICS}) m GROUP BY run",
        "best_sample": f"""SELECT run, sample_index, round(wall_time_seconds, 5) AS wall_time_seconds,
  allocated_bytes_total, round(gc_time_seconds, 5) AS gc_time_seconds FROM ({views.SAMPLES}) s
QUALIFY row_number() OVER (PARTITION BY run ORDER BY wall_time_seconds, sample_index) = 1""",
    }


def _case(mapping, column, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


BACKEND = _case(CODE_BACKENDS, "code", "'unknown'")
SCHEDULE = (f"CASE WHEN coalesce(schedule, '') <> '' THEN schedule WHEN code = '{CODES[1]}' THEN 'static' "
            f"ELSE '{DEFAULT_SCHEDULE}' END")
SCAN = f"""SELECT {views.INPUT_ORDER}, code, code_version, {BACKEND} AS backend, 'unknown' AS backend_version, threads,
  {SCHEDULE} AS schedule, 1.0 / (time_per_event * CAST(1e-6 AS DOUBLE)) AS events_per_second, algorithm, strategy,
  radius AS R, power AS p, File_path AS input_file, n_samples AS nsamples,
  time_per_event * CAST(1e-6 AS DOUBLE) AS time_per_event_seconds FROM ({views.RESULTS}) r"""
WORKLOAD = "code, code_version, backend, backend_version, algorithm, strategy, R, p, input_file"
GROUP = f"{WORKLOAD}, threads, schedule"
MERGED = f"""SELECT {GROUP}, median(events_per_second) AS eps, median(time_per_event_seconds) AS tpe,
  arg_min(nsamples, ({views.INPUT_ORDER})) FILTER (WHERE nsamples IS NOT NULL) AS nsamples, count(*) AS raw_rows
FROM ({SCAN}) s GROUP BY {GROUP}"""
SPEEDUP = f"""SELECT m.*, base, eps / base AS speedup, eps / base / threads AS efficiency FROM ({MERGED}) m
LEFT JOIN (SELECT {WORKLOAD}, median(eps) AS base FROM ({MERGED}) b WHERE threads = 1 GROUP BY {WORKLOAD}) b
USING ({WORKLOAD})"""


def scan_queries():
    rates = f"""SELECT code, threads, 1e6::DOUBLE / min(time_per_event) AS event_rate FROM ({views.RESULTS}) r
      WHERE time_per_event IS NOT NULL GROUP BY code, threads"""
    perfect = f"""SELECT code, threads, event_rate, one * CASE WHEN threads <= 4 THEN threads
        ELSE 4 + (threads - 4) * 0.1::DOUBLE END AS perfect
      FROM ({rates}) a JOIN (SELECT code, arg_min(event_rate, threads) AS one FROM ({rates}) b GROUP BY code) b USING (code)"""
    lines = f"""SELECT CASE input_file WHEN 'data/events-small.hepmc3' THEN 'events-small.hepmc3'
        ELSE 'events-large.hepmc3' END AS split, 'code=' || code || chr(44) || chr(10) || 'algorithm=' || algorithm
        || chr(44) || chr(10) || 'strategy=' || strategy || chr(44) || chr(10) || 'R=' || R || chr(44) || chr(10)
        || 'schedule=' || schedule AS series, threads, speedup AS value FROM ({SPEEDUP}) s"""
    averages = f"""SELECT threads, avg(time_per_event) FILTER (WHERE strategy = 'N2Plain') AS N2Plain,
      avg(time_per_event) FILTER (WHERE strategy = 'N2Tiled') AS N2Tiled FROM ({views.RESULTS}) r GROUP BY threads"""
    return {
        "csv_scan_rows": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(l_extendedprice, 5) AS l_extendedprice, code, code_version, backend, backend_version, threads, schedule,
  round(events_per_second, 5) AS events_per_second, R, p, input_file, nsamples,
  round(time_per_event_seconds, 12) AS time_per_event_seconds FROM ({SCAN}) s""",
        "json_scan_rows": f"""SELECT CAST(l_orderkey AS VARCHAR) AS repo_commit, '{CODES[0]}' AS code,
  'unknown' AS code_version, 'Julia' AS backend, '1.11' AS backend_version, threads,
  '{DEFAULT_SCHEDULE}' AS schedule, algorithm, radius AS R, power AS p, File_path AS input_file,
  100 AS measured_events, round(time_per_event, 8) AS wall_time_seconds,
  round(time_per_event / 100, 8) AS time_per_event_seconds, n_samples * CAST(64 AS DOUBLE) AS allocated_bytes_total,
  round(n_samples * CAST(64 AS DOUBLE) / 100, 8) AS allocated_bytes_per_event
FROM ({views.RESULTS}) r WHERE l_linenumber <> 4""",
        "scan_merge": f"""SELECT {GROUP}, round(eps, 5) AS events_per_second_median,
  round(tpe, 13) AS time_per_event_seconds_median, nsamples, raw_rows FROM ({MERGED}) m""",
        "scan_speedup": f"""SELECT {GROUP}, round(base, 5) AS baseline_events_per_second_median,
  round(speedup, 5) AS speedup_median, round(efficiency, 5) AS efficiency_median FROM ({SPEEDUP}) s""",
        "scan_series": f"""SELECT split, series, threads, round(value, 5) AS value FROM ({lines}) l
UNION ALL SELECT DISTINCT split, 'ideal', threads, CAST(threads AS DOUBLE) FROM ({lines}) l""",
        "ideal_scaling": f"""SELECT code, threads, round(event_rate, 4) AS event_rate, round(perfect, 4) AS perfect
FROM ({perfect}) p""",
        "scaling_series": f"""SELECT code, threads, 'actual' AS series, round(event_rate, 4) AS rate FROM ({perfect}) p
UNION ALL SELECT code, threads, 'perfect', round(perfect, 4) FROM ({perfect}) q""",
        "speedup_series": " UNION ALL ".join(f"""SELECT '{s}' AS series, threads,
  round(first_value({s}) OVER (ORDER BY threads) / {s}, 5) AS speedup FROM ({averages}) a""" for s in ("N2Plain", "N2Tiled"))
        + f" UNION ALL SELECT 'ideal', threads, CAST(threads AS DOUBLE) FROM ({averages}) a",
    }


def result_queries():
    r = f"({views.RESULTS}) r"
    sides = f"""SELECT {{keys}}, min(time_per_event) FILTER (WHERE code = '{CODES[1]}') AS num,
      min(time_per_event) FILTER (WHERE code = '{CODES[0]}') AS den FROM {r} GROUP BY {{keys}}"""
    keys = "File, algorithm, strategy, radius, threads"
    ratios = f"SELECT {keys}, radius AS R, num / den AS ratio FROM ({sides.format(keys=keys)}) x WHERE num / den IS NOT NULL"
    means = "round(avg(ratio), 5) AS mean, round(exp(avg(ln(ratio))), 5) AS geomean, count(*) AS n"
    files = f"""SELECT File, algorithm, count(*) AS w, avg(time_per_event) AS a, min(time_per_event) AS b,
      max(time_per_event) AS c, avg(CAST(threads AS DOUBLE)) AS d FROM {r} GROUP BY File, algorithm"""
    order = views.INPUT_ORDER

    def described(c):
        return f"""SELECT '{c}' AS column, count({c}) AS count, count(*) - count({c}) AS missing,
  round(CAST(min({c}) AS DOUBLE), 5) AS min, round(median({c}), 5) AS median, round(avg({c}), 5) AS mean,
  round(CAST(max({c}) AS DOUBLE), 5) AS max FROM {r}"""

    place = "CASE code " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PREFERRED_CODES, 1)) + " ELSE 0 END"
    return {
        "select_rows": f"""SELECT l_orderkey, l_linenumber, l_partkey, algorithm, radius,
  round(time_per_event, 5) AS time_per_event FROM {r} WHERE algorithm IN ('AntiKt', 'CA') AND radius = 0.4
  AND strategy = 'N2Tiled'""",
        "drop_rows": f"""SELECT n_samples, count(*) AS n FROM {r} WHERE n_samples IS DISTINCT FROM 7 GROUP BY n_samples""",
        "append_results": f"""SELECT code, CAST(threads AS BIGINT) AS threads, count(*) AS n,
  CAST(sum(floor(time_per_event)) AS BIGINT) AS total FROM (SELECT code, threads, CASE WHEN radius < 1
    THEN CAST(CAST(time_per_event AS FLOAT) AS DOUBLE) ELSE time_per_event END AS time_per_event FROM {r}) x
GROUP BY code, threads""",
        "runtime_ratio": f"SELECT File, algorithm, strategy, R, threads, round(ratio, 5) AS ratio FROM ({ratios}) x",
        "ratio_means": f"""SELECT 'all' AS scope, algorithm, strategy, CAST(NULL AS DOUBLE) AS R, {means}
FROM ({ratios}) x GROUP BY algorithm, strategy UNION ALL
SELECT 'from_1.0', algorithm, strategy, NULL, {means} FROM ({ratios}) x WHERE R >= 1 GROUP BY algorithm, strategy
UNION ALL SELECT 'each', algorithm, strategy, R, {means} FROM ({ratios}) x GROUP BY algorithm, strategy, R""",
        "ratio_series": f"""SELECT File, algorithm, strategy, radius, mean_particles AS x, round(num / den, 5) AS y
FROM ({sides.format(keys="File, algorithm, strategy, radius, mean_particles")}) x WHERE num / den IS NOT NULL""",
        "weighted_mean": " UNION ALL ".join(
            f"SELECT '{m}' AS method, round(sum(w * {c}) / sum(w), 5) AS time FROM ({files}) f"
            for m, c in (("Filter", "a"), ("Trim", "b"), ("Massdrop", "c"), ("Softdrop", "d"))),
        "fastest_per_jet": f"""SELECT sample_index % 3 AS file, run AS method,
  round(min(wall_time_seconds * 1e6::DOUBLE / measured_events), 5) AS time_per_jet FROM ({views.SAMPLES}) s GROUP BY 1, 2""",
        "file_lookup": f"""SELECT File_path, code, n, n_jets FROM (SELECT File_path, code, count(*) AS n FROM {r}
  GROUP BY File_path, code) a JOIN (SELECT File_path, CAST(sum(threads) AS BIGINT) AS n_jets FROM {r} GROUP BY File_path) b
USING (File_path)""",
        "describe": " UNION ALL ".join(described(c) for c in ("threads", "n_samples", "time_per_event")),
        "group_means": f"""SELECT *, row_number() OVER (ORDER BY code, radius) AS group_no FROM (
  SELECT code, radius, round(avg(time_per_event), 5) AS mean FROM {r} GROUP BY code, radius) g""",
        "group_count": f"SELECT count(*) AS n_groups FROM (SELECT DISTINCT code, algorithm, n_samples FROM {r}) g",
        "distinct_values": f"SELECT DISTINCT n_samples FROM {r}",
        "head": f"""SELECT code, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(l_extendedprice, 5) AS l_extendedprice FROM {r} ORDER BY code, {order} LIMIT 5""",
        "preferred_order": f"""SELECT code, algorithm, count(*) AS n, {place} AS place FROM {r}
GROUP BY code, algorithm HAVING {place} > 0""",
        "top_of": f"""SELECT round(greatest(max(time_per_event), max(mean_particles)), 5) AS top,
  CAST(ceil(greatest(max(time_per_event), max(mean_particles))) AS BIGINT) AS ceiling FROM {r}""",
        "prefix_minimum": f"""SELECT trial, round(time_us, 5) AS time_us,
  round((min({{'v': time_us, 'i': trial}}) OVER w).v, 5) AS prefix_min, (min({{'v': time_us, 'i': trial}}) OVER w).i AS prefix_index
FROM ({views.TRIALS}) t WINDOW w AS (ORDER BY trial ROWS UNBOUNDED PRECEDING)""",
    }


def figure_queries():
    curves = f"""SELECT code, code_version, algorithm, strategy, radius, mean_particles,
      min(time_per_event) AS time_per_event FROM ({views.RESULTS}) r GROUP BY ALL"""
    place = "CASE code " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PREFERRED_CODES, 1)) + " END"
    label = "CASE code " + " ".join(
        "WHEN '{}' THEN '{}'".format(k, v.replace("\n", "' || chr(10) || '")) for k, v in CODE_LABELS.items()) + " END"
    xy = "mean_particles AS x, round(time_per_event, 5) AS y"
    wide = "trial, max(time_us) FILTER (WHERE workload = '{w}') AS v"
    return {
        "figure_series": f"""SELECT algorithm, radius, code, code_version,
  dense_rank() OVER (ORDER BY algorithm, radius) AS facet_no,
  CAST(dense_rank() OVER (PARTITION BY algorithm, radius ORDER BY code, code_version) AS INT) AS series_no,
  code || ' ' || code_version AS series_label, {xy}
FROM ({curves}) c WHERE strategy = 'N2Tiled' AND algorithm IN ('AntiKt', 'Kt')""",
        "radius_scan": f"""SELECT algorithm, strategy, radius, code,
  dense_rank() OVER (ORDER BY algorithm, strategy, radius) AS facet_no, {place} AS series_no,
  code AS series_label, {xy} FROM ({curves}) c WHERE strategy = 'N2Plain' AND algorithm IN ('AntiKt', 'CA')""",
        "showcase": f"""SELECT code, {place} AS series_no, {label} AS series_label, {xy} FROM ({curves}) c
WHERE algorithm = 'Kt' AND radius = 1.0 AND strategy = 'N2Tiled' AND code <> '{PREFERRED_CODES[2]}'""",
        "latency_series": " UNION ALL ".join(
            f"SELECT trial, '{w}' AS code, round(v, 5) AS value FROM (SELECT {wide.format(w=w)} FROM ({views.TRIALS}) t "
            "GROUP BY 1) t" for w in ("click", "purchase")),
        "version_comparison": f"""SELECT code, 'v' || right(code_version, 1) AS release, 1 AS facet_no,
  CAST(dense_rank() OVER (ORDER BY code, code_version) AS INT) AS series_no,
  code || ' v' || right(code_version, 1) AS series_label, {xy} FROM ({curves}) c
WHERE strategy = 'N2Plain' AND radius = 0.4 AND algorithm = 'Kt'""",
    }


def scalar_queries():
    r = f"({views.RESULTS}) r"
    old = f"CASE WHEN code = '{CODES[1]}' THEN 'FastJet' ELSE 'Julia' END"
    label = "CASE code " + " ".join(
        "WHEN '{}' THEN '{}'".format(k, v.replace("\n", "' || chr(10) || '")) for k, v in CODE_LABELS.items()) + " END"
    return {
        "run_names": f"""SELECT code || '_' || code_version || '_' || algorithm || '_' || strategy || '_R' || radius || '_P'
  || power || '_' || {BACKEND} || '_unknown' || CASE WHEN threads = 1 THEN '' ELSE '_T' || threads ||
  CASE WHEN schedule = '' THEN '' ELSE '_' || schedule END END || '.csv' AS name, count(*) AS n FROM {r} GROUP BY 1""",
        "filename_meta": f"""SELECT {old} AS code, algorithm, strategy, radius,
  CASE WHEN threads % 2 = 0 THEN power END AS power, count(*) AS n FROM {r} GROUP BY ALL""",
        "labels": f"""SELECT {label} AS code_label, 'code=' || code || ', radius=' || radius || ', input_file=' || File AS label,
  'data_' || File AS safe, File AS base, 'data' AS dir, '.hepmc3' AS ext,
  CASE radius WHEN 0.4 THEN '0.1333' ELSE '0.3333' END AS third, count(*) AS n FROM {r} GROUP BY ALL""",
        "defaults": f"""SELECT l_orderkey, l_linenumber, l_partkey, {BACKEND} AS backend, {SCHEDULE} AS schedule,
  round(CASE WHEN n_samples = 10 THEN NULL ELSE time_per_event / (n_samples - 10) END, 10) + 0.0 AS quotient,
  round(time_per_event, 10) AS checked, CASE WHEN threads = 3 THEN NULL ELSE CAST(n_samples AS DOUBLE) END AS parsed,
  (threads - 1) % 3 + 1 AS wrapped, CASE WHEN n_samples IS NULL THEN 5 ELSE least(greatest(n_samples, 5), 20) END AS clamped,
  algorithm FROM {r}""",
        "group_ordinals": f"""SELECT code, n_samples, row_number() OVER (ORDER BY code, n_samples NULLS LAST) AS number,
  count(*) AS n FROM {r} GROUP BY code, n_samples""",
        "product_text": """SELECT p_partkey, 'a|' || p_brand || '|' || p_size AS items,
  nullif(regexp_extract(p_brand, '(\\d)(\\d)', 1), '') AS digit, p_brand || '.hepmc3' AS unpacked FROM part""",
    }


def file_queries():
    r = f"({views.RESULTS}) r"
    seconds = "CASE WHEN l_suppkey % 2 = 0 THEN 'events-small.hepmc3' ELSE 'events-large.hepmc3' END"
    source = f"CASE WHEN code = '{CODES[4]}' THEN File_path ELSE {seconds} END"
    body = """SELECT *, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place
  FROM {r} WHERE l_orderkey % 97 = 1""".format(r=r)
    good = "CASE WHEN l_partkey % 11 <> 0 THEN {} END"
    return {
        "manifest_events": f"""WITH p AS (SELECT event, count(*) FILTER (status = 1) AS n,
    row_number() OVER (PARTITION BY event % 5 ORDER BY event) AS place FROM ({NUMBERED}) q GROUP BY event)
SELECT 'run-' || (event % 5) || '.hepmc3' AS File, count(*) AS listed, count(*) FILTER (place > 3) AS n_events,
  CAST(sum(n) FILTER (place > 3) AS BIGINT) AS n_particles, max(event) AS last_event FROM p GROUP BY 1""",
        "scan_files": f"""SELECT code, algorithm, strategy, threads, {SCHEDULE} AS schedule, {source} AS input_file,
  count(*) AS n, count(n_samples) AS n_sampled, CAST(sum(CAST(round(time_per_event * 10000) AS BIGINT)) AS BIGINT) AS sum_ticks
FROM (SELECT * REPLACE (CASE WHEN code = '{CODES[1]}' THEN schedule ELSE '' END AS schedule) FROM {r}) q GROUP BY ALL""",
        "variant_runs": f"""SELECT 'run-' || (l_orderkey % 50) || '.json' AS name, {good.format('algorithm')} AS algorithm,
  {good.format('strategy')} AS strategy, {good.format('threads')} AS julia_threads,
  CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 7 <> 0 THEN 100 END AS measured_events,
  {good.format('round(l_partkey / CAST(8 AS DOUBLE), 5) + 0.0')} AS seconds, {good.format("'Package' || (l_suppkey % 3)")} AS package,
  {good.format("'0.' || (l_suppkey % 5)")} AS version, l_partkey % 11 = 0 AS broken FROM ({body}) b WHERE place = 1""",
        "skipped_runs": f"SELECT 'run-' || (l_orderkey % 40) || '.json' AS name FROM {r} GROUP BY l_orderkey % 40 HAVING count(*) % 3 = 0",
    }


def all_queries() -> dict[str, str]:
    return {**clustering_queries(), **event_queries(), **trial_queries(), **scan_queries(),
            **result_queries(), **figure_queries(), **scalar_queries(), **file_queries()}
