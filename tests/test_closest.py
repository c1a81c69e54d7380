"""The first step of each event by a join of tiles, against all pairs."""

import math
import random

import pytest

import brute
from jetlake.operators import clustering, closest
from test_kernel import TIED

CASES = [("AntiKt", 0.4, None), ("Kt", 1.0, None), ("CA", 3.5, None), ("GenKt", 1.0, -0.5), ("Durham", 4.0, None),
         ("EEKt", 1.0, -1.0), ("EEKt", 4.0, 1.0)]


def massless(x, y, z):
    return (x, y, z, math.sqrt(x * x + y * y + z * z))


def cloud(seed, count, spread=10.0):
    pick = random.Random(seed)
    found = []
    for _ in range(count):
        x, y, z = (pick.gauss(0, spread) for _ in range(3))
        found.append((x, y, z, math.sqrt(x * x + y * y + z * z + 0.02)))
    return found


EVENTS = [
    [], cloud(1, 1), cloud(2, 2), cloud(3, 25), cloud(4, 150),
    [massless(*p) for p in TIED], [massless(*p) for p in TIED[::-1]],
    [(1.0, 2.0, 3.0, 5.0)] * 5,                                             # copies
    [(0.0, 0.0, 5.0, 5.0), (0.0, 0.0, -5.0, 5.0), (1.0, 0.0, 0.0, 1.0)],    # along the beam
    [massless(math.cos(a), math.sin(a), 0.0) for a in (0.01, 2 * math.pi - 0.01, 3.0)],  # across the seam
    [massless(math.cos(k) * 5, math.sin(k) * 5, k / 3) for k in range(40)] + cloud(5, 60, 0.01),
]


def plain_first(event, spec):
    sizes = [q[0] ** 2 + q[1] ** 2 if spec.family == "pp" else q[3] ** 2 for q in event]
    weights = [1.0 if spec.power == 0 else max(s, 1e-300) ** spec.power for s in sizes]
    steps = []
    for i, a in enumerate(event):
        if spec.family != "Durham" or len(event) == 1:
            steps.append((weights[i] * (4.0 if spec.family == "Durham" else 1.0), i, math.inf))
        for j in range(i + 1, len(event)):
            low, b = min(weights[i], weights[j]), event[j]
            if spec.family == "pp":
                d = low * ((brute.rap(a) - brute.rap(b)) ** 2 + brute.dphi(a, b) ** 2) / spec.R**2
            elif spec.family == "Durham":
                d = 2 * low * brute.angle(a, b)
            else:
                d = low * brute.angle(a, b) / (1 - math.cos(spec.R) if spec.R < math.pi else 3 + math.cos(spec.R))
            steps.append((d, i, j))
    return min(steps)


@pytest.mark.parametrize("algorithm,R,p", CASES)
def test_first_merge_against_all_pairs(make_events, algorithm, R, p):
    found = {r.event: r for r in clustering.first_merge(make_events(EVENTS), algorithm, R, p, keys=["event"]).collect()}
    spec = clustering.resolve(algorithm, R, p)
    assert (found[0].parent1, found[0].parent2, found[0].dij) == (None, None, None)
    for n, event in enumerate(EVENTS[1:], 1):
        d, i, j = plain_first(event, spec)
        assert (found[n].parent1, found[n].parent2) == (i, -1 if j is math.inf else j)
        assert found[n].dij == pytest.approx(d, rel=1e-9, abs=1e-12)


def test_first_merge_against_the_step_loop(make_events):
    """Both ways agree on crowded events, in which tiles are much smaller than the reach."""
    events = make_events([cloud(s, 800) for s in (6, 7)])
    for algorithm, R in (("AntiKt", 1.0), ("Kt", 1.0)):
        tiles = {r.event: (r.parent1, r.parent2) for r in clustering.first_merge(events, algorithm, R, keys=["event"]).collect()}
        loop = {r.event: (r.h.parent1, r.h.parent2) for r in clustering.cluster(events, algorithm, R).selectExpr(
            "event", "history[800] AS h").collect()}
        assert tiles == loop


def test_momenta_must_be_numbers(spark, make_events):
    events = make_events([cloud(8, 3), [(1.0, 1.0, float("nan"), 2.0)]])
    null = spark.createDataFrame([(4, [(1.0, None, 0.0, 2.0)])],
                                 "event bigint, particles array<struct<px:double,py:double,pz:double,e:double>>")
    for rows, number in ((events, 1), (null, 4)):
        for run in (lambda r: clustering.first_merge(r, keys=["event"]), clustering.cluster, clustering.inclusive_jets):
            with pytest.raises(Exception, match=f"not a number in event: event {number}"):
                run(rows).collect()
