import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from jetlake.operators import clustering, kernel


def random_events(seed, sizes):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        p = rng.uniform(-50, 50, (n, 3))
        out.append(np.column_stack([p, np.sqrt((p ** 2).sum(1) + 0.02)]))
    return out


def flat(events):
    counts = np.array([len(e) for e in events], dtype=np.int64)
    rows = [np.asarray(e, dtype=float).reshape(-1, 4) for e in events]
    return np.concatenate(rows).T.copy() if rows else np.zeros((4, 0)), counts


def steps_of(events, **options):
    mom, counts = flat(events)
    steps = kernel.cluster_batch(mom, counts, clustering.resolve(**options))
    return [[(int(steps.parent1[k]), int(steps.parent2[k]), steps.dij[k], tuple(steps.mom[:, k]))
             for k in range(steps.offsets[e], steps.offsets[e + 1])] for e in range(len(events))]


CASES = [
    ({"algorithm": "AntiKt"}, {"p": -1.0}),
    ({"algorithm": "CA", "R": 1.0}, {"R": 1.0, "p": 0.0}),
    ({"algorithm": "Kt", "R": 0.7}, {"R": 0.7, "p": 1.0}),
    ({"algorithm": "GenKt", "p": -0.5, "R": 1.2}, {"R": 1.2, "p": -0.5}),
    ({"algorithm": "AntiKt", "R": 1.0, "scheme": "pt"}, {"R": 1.0, "p": -1.0, "scheme": "pt"}),
    ({"algorithm": "Kt", "R": 1.0, "scheme": "pt2_scheme"}, {"R": 1.0, "p": 1.0, "scheme": "pt2"}),
    ({"algorithm": "EEKt", "p": -1.0, "R": 1.0}, {"family": "EEKt", "R": 1.0, "p": -1.0}),
    ({"algorithm": "EEKt", "p": 1.0, "R": 4.0}, {"family": "EEKt", "R": 4.0, "p": 1.0}),
    ({"algorithm": "Durham"}, {"family": "Durham", "p": 1.0}),
    ({"algorithm": "AntiKt", "R": 0.6, "strategy": "N2Tiled"}, {"R": 0.6, "p": -1.0}),
    ({"algorithm": "CA", "R": 2.5, "strategy": "N2Tiled"}, {"R": 2.5, "p": 0.0}),
    ({"algorithm": "Kt", "R": 1.0, "strategy": "N2Tiled", "scheme": "pt"}, {"R": 1.0, "p": 1.0, "scheme": "pt"}),
]


@pytest.mark.parametrize("options, check", CASES)
def test_matches_all_pairs(options, check):
    events = random_events(3, [0, 1, 2, 3, 5, 17, 30, 8, 41])
    for event, got in zip(events, steps_of(events, **options)):
        want = brute.cluster(event, **check)
        assert [s[:2] for s in got] == [s[:2] for s in want]
        np.testing.assert_allclose([s[2] for s in got], [s[2] for s in want], rtol=1e-6, atol=1e-14)
        np.testing.assert_allclose([s[3] for s in got], [s[3] for s in want], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("R", [0.1, 0.4, 1.0, 3.0])
@pytest.mark.parametrize("algorithm", ["AntiKt", "CA", "Kt"])
def test_strategies_agree(algorithm, R):
    events = random_events(5, [300, 120, 400, 7, 260])
    plain = steps_of(events, algorithm=algorithm, R=R, strategy="N2Plain")
    assert plain == steps_of(events, algorithm=algorithm, R=R, strategy="N2Tiled")
    assert plain == steps_of(events, algorithm=algorithm, R=R, strategy="Best")


DEGENERATE = [
    [(1, 0, 0, 1)],
    [(1, 0, 0, 1), (2, 0, 0, 2)],                       # collinear
    [(1, 0, 0, 1), (1, 0, 0, 1), (1, 0, 0, 1)],         # identical
    [(1, 0, 0, 1), (-1, 0, 0, 1)],                      # back to back
    [(1, 0.01, 0, 1.1), (1, -0.01, 0, 1.1)],            # either side of phi = 0
    [(0, 0, 5, 5), (0, 0, -5, 5), (1, 1, 0, 1.5)],      # along the beam
    [(0, 0, 0, 0), (1, 0, 0, 1)],                       # no momentum
    [(3, 0, 1, 4), (3, 0, 1, 4), (0, 3, 1, 4), (0, 3, 1, 4)],
]


@pytest.mark.parametrize("strategy", ["N2Plain", "N2Tiled"])
@pytest.mark.parametrize("algorithm", ["AntiKt", "CA", "Kt"])
def test_degenerate_events(algorithm, strategy):
    power = {"AntiKt": -1.0, "CA": 0.0, "Kt": 1.0}[algorithm]
    events = [e for e in DEGENERATE if (0, 0, 0, 0) not in e]
    for event, got in zip(events, steps_of(events, algorithm=algorithm, strategy=strategy)):
        assert [s[:2] for s in got] == [s[:2] for s in brute.cluster(event, p=power)]
    for got, event in zip(steps_of(DEGENERATE, algorithm=algorithm, strategy=strategy), DEGENERATE):
        assert len(got) == len(event) and all(math.isfinite(x) for s in got for x in s[3])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-4, 4)] * 3), min_size=1, max_size=14), st.sampled_from(["N2Plain", "N2Tiled"]))
def test_every_step_takes_a_smallest_distance(points, strategy):
    """Momenta on a small grid give many equal distances, so the order is not unique."""
    event = [(x + 0.5, y + 0.5, z, math.sqrt((x + .5) ** 2 + (y + .5) ** 2 + z * z)) for x, y, z in points]
    objects = dict(enumerate(event))
    for step, (i, j, d, made) in enumerate(steps_of([event], algorithm="CA", R=1.0, strategy=strategy)[0]):
        ids = sorted(objects)
        smallest = min([1.0] + [
            (brute.rap(objects[a]) - brute.rap(objects[b])) ** 2 + brute.dphi(objects[a], objects[b]) ** 2
            for k, a in enumerate(ids) for b in ids[k + 1:]])
        assert d == pytest.approx(smallest, abs=1e-9)
        a = objects.pop(i)
        if j >= 0:
            b = objects.pop(j)
            assert made == pytest.approx(tuple(u + v for u, v in zip(a, b)))
            objects[len(event) + step] = made
    assert not objects


def test_momentum_is_conserved_and_order_does_not_matter():
    rng = np.random.default_rng(8)
    events = random_events(9, [60, 80])
    shuffled = [e[rng.permutation(len(e))] for e in events]
    for event, a, b in zip(events, steps_of(events, R=1.0), steps_of(shuffled, R=1.0)):
        jets_a = sorted(s[3] for s in a if s[1] == -1)
        jets_b = sorted(s[3] for s in b if s[1] == -1)
        np.testing.assert_allclose(np.sum(jets_a, axis=0), event.sum(axis=0), atol=1e-9)
        np.testing.assert_allclose(jets_a, jets_b, rtol=1e-9, atol=1e-9)


def test_rotation_in_azimuth():
    events = random_events(11, [50])
    turn = np.eye(4)
    turn[:2, :2] = [[math.cos(2.0), -math.sin(2.0)], [math.sin(2.0), math.cos(2.0)]]
    a = steps_of(events, R=0.8)[0]
    b = steps_of([events[0] @ turn.T], R=0.8)[0]
    assert [s[:2] for s in a] == [s[:2] for s in b]


def test_tiny_radius_keeps_every_particle():
    event = random_events(1, [40])[0]
    got = steps_of([event], R=1e-6)[0]
    assert all(s[1] == -1 for s in got) and len(got) == 40


def test_algorithms_merge_in_different_orders():
    """A hard particle, a soft one near it, and a close soft pair further away."""
    event = [(100, 0, 0, 100), (math.cos(0.3), math.sin(0.3), 0, 1), (math.cos(0.5), math.sin(0.5), 0, 1)]
    first = {a: steps_of([event], algorithm=a, R=1.0)[0][0][:2] for a in ("AntiKt", "CA", "Kt")}
    assert first["AntiKt"] == (0, 1) and first["CA"] == (1, 2) and first["Kt"] == (1, 2)


def test_one_step_only():
    mom, counts = flat(random_events(4, [0, 6, 9]))
    whole = kernel.cluster_batch(mom, counts, clustering.resolve())
    one = kernel.cluster_batch(mom, counts, clustering.resolve(), max_steps=1)
    for e in (1, 2):
        at = whole.offsets[e]
        assert one.parent1[at] == whole.parent1[at] and one.dij[at] == whole.dij[at]


@pytest.mark.parametrize("options", [
    {"algorithm": "Cone"}, {"strategy": "Fast"}, {"scheme": "Et"}, {"algorithm": "GenKt"},
    {"algorithm": "AntiKt", "p": 1.0}, {"R": 0.0}, {"algorithm": "EEKt", "p": 1.0, "R": 10.0}])
def test_bad_parameters(options):
    with pytest.raises(ValueError):
        clustering.resolve(**options)


TIED = [(6, 0, 40), (3, 1.5, -20), (6, 0, -40), (3, 1.5, 20)]  # pairs (0, 3) and (1, 2) are equally far, bit by bit


@pytest.mark.parametrize("algorithm", ["Kt", "AntiKt", "CA"])
@pytest.mark.parametrize("strategy", ["N2Plain", "N2Tiled"])
def test_equal_distances_go_by_number(algorithm, strategy):
    massless = [(x, y, z, math.sqrt(x * x + y * y + z * z)) for x, y, z in TIED]
    # A square of equal particles in azimuth, every neighbour equally far, and copies of one particle.
    ring = [(5.0 * x, 5.0 * y, 0.0, 5.0) for x, y in ((1, 0), (0, 1), (-1, 0), (0, -1))]
    events = [massless, ring, [(1.0, 2.0, 3.0, 5.0)] * 6, massless[::-1]]
    for R in (1.0, 2.0):
        for got, event in zip(steps_of(events, algorithm=algorithm, R=R, strategy=strategy), events):
            want = brute.cluster(event, R=R, p={"Kt": 1, "AntiKt": -1, "CA": 0}[algorithm])
            assert got[0][:2] == want[0][:2]
    if algorithm == "Kt":
        assert steps_of([massless], algorithm="Kt", R=1.0, strategy=strategy)[0][0][:2] == (0, 3)
