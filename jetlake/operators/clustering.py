"""Sequential recombination of event rows, distributed over Spark tasks.

Event rows are clustered where they are (``mapInArrow``, no shuffle).  The
NumPy step loop of ``kernel`` gets whole Arrow batches and works on all their
events at once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake import schemas
from jetlake.constants import ALGORITHMS, BEAM, NO_PARENT, SCHEME_NAMES, SCHEMES, STRATEGIES
from jetlake.operators import closest, kernel
from jetlake.operators.grouping import join_on

COMPONENTS = ("px", "py", "pz", "e")


def resolve(algorithm="AntiKt", R=0.4, p=None, scheme="E", strategy="Best") -> kernel.Spec:
    """Check the parameters and settle the power of the distance measure."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    scheme = SCHEME_NAMES.get(scheme, scheme)
    if scheme not in SCHEMES:
        raise ValueError(f"unknown recombination scheme: {scheme}")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    family, fixed = ALGORITHMS[algorithm]
    if fixed is None and p is None:
        raise ValueError(f"{algorithm} needs a power")
    if fixed is not None and p is not None and float(p) != fixed:
        raise ValueError(f"{algorithm} has power {fixed}, not {p}")
    if not R > 0:
        raise ValueError("R must be positive")
    if family == "EEKt" and R >= 3 * np.pi:
        raise ValueError("R must be below 3 pi for EEKt")
    return kernel.Spec(family, float(R), float(p if fixed is None else fixed), scheme, strategy)


def _momenta(batch):
    """Flat (4, n) momenta and particle counts of the events of a batch.

    A momentum that is null or not a finite number is an error that names its event.
    """
    columns = [batch.column(f"_{c}") for c in COMPONENTS]
    offsets = np.asarray(columns[0].offsets, dtype=np.int64)
    flat = np.stack([np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=float) for c in columns])
    fine = np.isfinite(flat).all(axis=0)
    if not fine.all():
        row = int(np.searchsorted(np.cumsum(np.diff(offsets)), int(fine.argmin()), side="right"))
        named = [n for n in batch.schema.names if n[1:] not in COMPONENTS and not pa.types.is_nested(batch.schema.field(n).type)]
        event = ", ".join(f"{n} {batch.column(n)[row].as_py()}" for n in named)
        raise ValueError(f"momentum that is not a number in event: {event or row}")
    return flat, np.diff(offsets)


def _list(values, counts):
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _struct(**arrays):
    return pa.StructArray.from_arrays([pa.array(a) for a in arrays.values()], list(arrays))


def _pass(batch, keys, **columns):
    arrays = [batch.column(k) for k in keys] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, *columns])


def _event_of(counts):
    return np.repeat(np.arange(len(counts)), counts)


def _inclusive_arrays(steps, ptmin):
    """Jets that met the beam, hardest first within each event."""
    pt = np.hypot(steps.mom[0], steps.mom[1])
    chosen = np.flatnonzero((steps.parent2 == BEAM) & (pt >= ptmin))
    event = _event_of(steps.counts)[chosen]
    chosen = chosen[np.lexsort((chosen, -pt[chosen], event))]
    jets = dict(zip(COMPONENTS, steps.mom[:, chosen]))
    return _list(_struct(**jets), np.bincount(event, minlength=len(steps.counts)))


def _sequence_arrays(momenta, steps):
    """The whole cluster sequence: jets, history and jet membership arrays."""
    n = steps.counts
    first = steps.offsets[:-1]
    event = _event_of(n)
    merge = steps.parent2 != BEAM
    merges = np.bincount(event, weights=merge, minlength=len(n)).astype(np.int64)

    # Flat positions: entry j < n of an event is an input, the others are steps.
    inputs_at = np.arange(len(event)) + first[event]
    steps_at = inputs_at + n[event]
    before = np.cumsum(merge) - merge
    before -= np.concatenate([before, [0]])[np.minimum(first, len(before))][event] if len(event) else 0
    jet_at = first + np.concatenate([[0], np.cumsum(merges)])[:-1]

    jets = np.empty((4, len(event) + int(merges.sum())))
    jets[:, np.arange(len(event)) - first[event] + jet_at[event]] = momenta
    where = (jet_at + n)[event] + before
    jets[:, where[merge]] = steps.mom[:, merge]

    total = 2 * len(event)
    local = np.arange(len(event)) - first[event]
    history = {
        "parent1": np.full(total, NO_PARENT, np.int32),
        "parent2": np.full(total, NO_PARENT, np.int32),
        "child": np.full(total, -1, np.int32),
        "jet": np.full(total, -1, np.int32),
        "dij": np.zeros(total),
        "max_dij": np.zeros(total),
    }
    history["jet"][inputs_at] = local
    history["jet"][steps_at[merge]] = (n[event] + before)[merge]
    for name in ("parent1", "parent2", "dij", "max_dij"):
        history[name][steps_at] = getattr(steps, name)
    own = (n[event] + local).astype(np.int32)
    start = 2 * first[event]
    history["child"][start + steps.parent1] = own
    history["child"][(start + steps.parent2)[merge]] = own[merge]

    return {
        "jets": _list(_struct(**dict(zip(COMPONENTS, jets))), n + merges),
        "history": _list(_struct(**history), 2 * n),
        "membership": _list(pa.array(_owners(steps)), n),
    }


def _owners(steps):
    """For each input, the number of the beam jet it ends in (in beam order)."""
    n, first = steps.counts, steps.offsets[:-1]
    event = _event_of(n)
    beam = steps.parent2 == BEAM
    number = np.cumsum(beam) - 1
    number -= np.concatenate([[0], np.cumsum(np.bincount(event, weights=beam, minlength=len(n)))])[:-1].astype(int)[event]
    # Hand the number down from the last step to the inputs.
    owner = np.full(2 * len(event), -1, np.int32)
    owner[np.arange(len(event)) + first[event] + n[event]] = np.where(beam, number, -1)
    longest = np.argsort(-n, kind="stable")
    for step in range(int(n.max(initial=0)) - 1, -1, -1):
        rows = longest[:np.searchsorted(-n[longest], -step, side="left")]
        at, start = first[rows] + step, 2 * first[rows]
        value = owner[start + n[rows] + step]
        owner[start + steps.parent1[at]] = value
        pair = ~beam[at]
        owner[(start + steps.parent2[at])[pair]] = value[pair]
    return owner[np.arange(len(event)) + first[event]]


def _member_arrays(momenta, steps, ptmin):
    """Beam jets with pt >= ptmin and their constituents, in beam order."""
    n = steps.counts
    event = _event_of(n)
    beam = np.flatnonzero(steps.parent2 == BEAM)
    jets_per_event = np.bincount(event[beam], minlength=len(n))
    starts = np.cumsum(jets_per_event) - jets_per_event
    jet = starts[event] + _owners(steps)
    kept = np.hypot(steps.mom[0, beam], steps.mom[1, beam]) >= ptmin
    inside = np.flatnonzero(kept[jet])
    inside = inside[np.argsort(jet[inside], kind="stable")]
    particles = _list(_struct(**dict(zip(COMPONENTS, momenta[:, inside]))),
                      np.bincount(jet[inside], minlength=len(beam))[kept])
    number = (np.arange(len(beam)) - starts[event[beam]])[kept].astype(np.int32)
    found = pa.StructArray.from_arrays(
        [pa.array(number), _struct(**dict(zip(COMPONENTS, steps.mom[:, beam[kept]]))), particles],
        ["jet_id", "jet", "particles"])
    return _list(found, np.bincount(event[beam][kept], minlength=len(n)))


def _flat(events, keep, particles):
    """The columns to keep, and one array per momentum component."""
    none = F.array().cast("array<double>")
    return events.select(*keep, *[
        F.coalesce(F.col(particles).getField(c), none).cast("array<double>").alias(f"_{c}") for c in COMPONENTS])


def _cluster_map(events, spec, make, out, keep, particles):
    kept = [c for c in events.columns if c in keep]
    flat = _flat(events, kept, particles)
    schema = ", ".join([f"`{c}` {events.schema[c].dataType.simpleString()}" for c in kept] + [out])

    def work(batches):
        for batch in batches:
            momenta, counts = _momenta(batch)
            steps = kernel.cluster_batch(momenta, counts, spec)
            yield _pass(batch, kept, **make(momenta, steps))

    return flat.mapInArrow(work, schema)


def cluster(events: DataFrame, algorithm="AntiKt", R=0.4, p=None, scheme="E", strategy="Best",
            particles="particles") -> DataFrame:
    """Cluster every event row; adds ``jets``, ``history`` and ``membership``.

    ``jets`` holds the inputs and then every merged object, ``history`` two
    entries per input, and ``membership`` for each input the number of the beam
    jet it ends in (in the order the jets met the beam).
    """
    spec = resolve(algorithm, R, p, scheme, strategy)
    out = f"jets array<{schemas.MOMENTUM}>, history array<{schemas.HISTORY}>, membership array<int>"
    return _cluster_map(events, spec, _sequence_arrays, out, events.columns, particles)


def inclusive_jets(events: DataFrame, algorithm="AntiKt", R=0.4, p=None, scheme="E", strategy="Best",
                   ptmin=5.0, particles="particles", keep=None) -> DataFrame:
    """Cluster and keep only jets with pt >= ptmin, hardest first, as ``jets``.

    The short way for the common case: the sequence never leaves the task, and
    the particles are dropped unless named in ``keep``.
    """
    spec = resolve(algorithm, R, p, scheme, strategy)
    if keep is None:
        keep = [c for c in events.columns if c != particles]
    return _cluster_map(
        events, spec, lambda _, steps: {"jets": _inclusive_arrays(steps, ptmin)},
        f"jets array<{schemas.MOMENTUM}>", keep, particles)


def jets_with_constituents(events: DataFrame, algorithm="CA", R=0.4, p=None, scheme="E", strategy="Best",
                           ptmin=2.0, particles="particles") -> DataFrame:
    """One row per inclusive jet: ``jet_id`` (beam order), ``jet`` and its constituents as ``particles``.

    Each jet is an event row of its own, ready to be clustered again.
    """
    spec = resolve(algorithm, R, p, scheme, strategy)
    keep = [c for c in events.columns if c != particles]
    found = _cluster_map(
        events, spec, lambda momenta, steps: {"found": _member_arrays(momenta, steps, ptmin)},
        f"found array<struct<jet_id:int,jet:{schemas.MOMENTUM},particles:array<{schemas.MOMENTUM}>>>",
        keep, particles)
    return found.select(*keep, F.inline("found"))


def first_merge(events: DataFrame, algorithm="AntiKt", R=0.4, p=None, scheme="E",
                particles="particles", keys=None) -> DataFrame:
    """The first step of each event: ``parent1``, ``parent2`` (-1 beam), ``dij``.

    Found by a join of tiles (see ``closest``), not by the step loop.  ``keys``
    identify an event: all other columns, unless named.  Events without particles
    have NULL.
    """
    spec = resolve(algorithm, R, p, scheme)
    keys = list(keys or [c for c in events.columns if c != particles])
    steps = closest.first_steps(events, spec, keys, particles)
    return join_on(events.select(*[c for c in events.columns if c != particles]), steps, keys, "left")


def parameter_grid(algorithms, radii, powers=(None,), strategies=("Best",)) -> list[dict]:
    """All consistent parameter combinations, with fixed powers filled in.

    A power list applies to the algorithms that take one.  Durham has no radius.
    """
    grid = []
    for algorithm in algorithms:
        fixed = ALGORITHMS[algorithm][1]
        for R in radii if algorithm != "Durham" else (4.0,):
            for p in powers if fixed is None else (fixed,):
                for strategy in strategies:
                    grid.append({"algorithm": algorithm, "R": float(R), "p": p, "strategy": strategy})
    return grid


def scan(events: DataFrame, grid: list[dict], ptmin=5.0, particles="particles") -> DataFrame:
    """Cluster every event once per grid row, in one job.

    The grid is a short list of parameters: each Arrow batch of events is read
    once and clustered for all of them, instead of multiplying the event rows.
    """
    points = [(g, resolve(g["algorithm"], g["R"], g["p"], strategy=g.get("strategy", "Best"))) for g in grid]
    keep = [c for c in events.columns if c != particles]
    flat = _flat(events, keep, particles)
    kept = [f"`{c}` {events.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(kept + ["algorithm string", "strategy string", "R double", "p double",
                               f"jets array<{schemas.MOMENTUM}>"])

    def work(batches):
        for batch in batches:
            momenta, counts = _momenta(batch)
            for g, spec in points:
                steps = kernel.cluster_batch(momenta, counts, spec)
                rows = len(counts)
                yield _pass(
                    batch, keep,
                    algorithm=pa.array([g["algorithm"]] * rows), strategy=pa.array([g.get("strategy", "Best")] * rows),
                    R=pa.array(np.full(rows, spec.R)), p=pa.array(np.full(rows, spec.power)),
                    jets=_inclusive_arrays(steps, ptmin))

    return flat.mapInArrow(work, schema)
