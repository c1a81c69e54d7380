"""Primary branches and constituents against walks and unions done one object at a time."""

import math
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from jetlake.operators import substructure
from test_closest import cloud

EVENTS = [[], cloud(1, 1), cloud(2, 2), cloud(3, 40, 3.0), [(1.0, 2.0, 3.0, 5.0)] * 6, cloud(4, 120, 2.0)]


def objects_of(event, R):
    """Momentum and parents of every object of the sequence, and the beam jets in order."""
    found, beam = [(p, None) for p in event], []
    for a, b, _, made in brute.cluster(event, R=R, p=0.0):
        if b < 0:
            beam.append(a)
        found.append((made, None if b < 0 else (a, b)))
    return found, beam


def plain_members(found, x):
    return [x] if found[x][1] is None else sorted(plain_members(found, found[x][1][0]) + plain_members(found, found[x][1][1]))


def test_members_of_every_object(make_events):
    events = make_events(EVENTS)
    rows = substructure.with_intervals(substructure.substructure_input(events, 1.0))
    picked = rows.select("event", "leaves", F.transform("history", lambda h, x: F.when(
        F.get("spans", x).isNotNull(), substructure.members(x))).alias("m")).collect()
    for row in picked:
        found, beam = objects_of(EVENTS[row.event], 1.0)
        assert sorted(row.leaves) == list(range(len(EVENTS[row.event])))
        for x, (_, parents) in enumerate(found):
            if parents is not None or x < len(EVENTS[row.event]):
                assert row.m[x] == plain_members(found, x)
            else:
                assert row.m[x] is None  # a beam step is no object of its own
    jets = {(r.event, r.jet_id): [tuple(p) for p in r.particles] for r in substructure.constituents(
        substructure.substructure_input(events, 1.0), 0.5).collect()}
    for n, event in enumerate(EVENTS):
        found, beam = objects_of(event, 1.0)
        for jet_id, x in enumerate(beam):
            if math.hypot(*found[x][0][:2]) >= 0.5:
                assert jets.pop((n, jet_id)) == [event[k] for k in plain_members(found, x)]
    assert not jets


def test_branches_against_walks(make_events):
    """Mass drop along each jet, with a loose and a strict rule."""
    events = make_events(EVENTS)
    for mu, y in ((0.9, 0.001), (0.5, 0.2)):
        got = {(r.event, r.jet_id): r.groomed for r in substructure.mass_drop(
            substructure.substructure_input(events, 1.0), mu, y, ptmin=0.0).collect()}
        for n, event in enumerate(EVENTS):
            found, beam = objects_of(event, 1.0)

            def m2(x):
                px, py, pz, e = found[x][0]
                return (e + pz) * (e - pz) - px * px - py * py

            for jet_id, x in enumerate(beam):
                while found[x][1] is not None:
                    a, b = found[x][1]
                    lead = a if m2(a) >= m2(b) else b
                    pa, pb = found[a][0], found[b][0]
                    far = (brute.rap(pa) - brute.rap(pb)) ** 2 + brute.dphi(pa, pb) ** 2
                    if m2(lead) < mu * mu * m2(x) and min(brute.pt(pa), brute.pt(pb)) ** 2 * far > y * m2(x):
                        break
                    x = lead
                groomed = got.pop((n, jet_id))
                assert (groomed is None) == (found[x][1] is None)
                if groomed is not None:
                    assert tuple(groomed) == pytest.approx(found[x][0])
        assert not got


def test_busy_event(make_events):
    """An event of 5,000 particles, most of them in one jet, is tagged in seconds."""
    pick = random.Random(9)
    event = []
    for _ in range(5000):
        y, phi, pt = pick.gauss(0, 0.3), pick.gauss(1.0, 0.3), pick.expovariate(1.0) + 0.1
        event.append((pt * math.cos(phi), pt * math.sin(phi), pt * math.sinh(y), pt * math.cosh(y)))
    sequence = substructure.substructure_input(make_events([event]), 1.0).persist()
    sequence.count()
    for run in (lambda: substructure.mass_drop(sequence), lambda: substructure.with_intervals(sequence).select("spans"),
                lambda: substructure.constituents(sequence)):
        start = time.time()
        assert run().collect()
        assert time.time() - start < 30
    sequence.unpersist()
