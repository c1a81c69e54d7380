"""Clustering by trying all pairs at every step; written apart from the kernel."""

import math


def rap(p):
    px, py, pz, e = p
    pt2 = px * px + py * py
    if e == abs(pz) and pt2 == 0:
        return math.copysign(1e5 + abs(pz), pz)
    m2 = max(0.0, (e + pz) * (e - pz) - pt2)
    y = 0.5 * math.log((pt2 + m2) / (e + abs(pz)) ** 2)
    return -y if pz > 0 else y


def phi(p):
    a = math.atan2(p[1], p[0])
    return a + 2 * math.pi if a < 0 else a


def pt(p):
    return math.hypot(p[0], p[1])


def dphi(a, b):
    d = abs(phi(a) - phi(b))
    return min(d, 2 * math.pi - d)


def angle(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v[:3])) for v in (a, b))
    return 1 - sum((x / na) * (y / nb) for x, y in zip(a[:3], b[:3]))


def merge(a, b, scheme):
    if scheme == "E":
        return tuple(x + y for x, y in zip(a, b))
    wa, wb = (pt(a), pt(b)) if scheme == "pt" else (pt(a) ** 2, pt(b) ** 2)
    turn = phi(b) - phi(a)
    turn -= 2 * math.pi * round(turn / (2 * math.pi))
    f = phi(a) + wb * turn / (wa + wb)
    y = (wa * rap(a) + wb * rap(b)) / (wa + wb)
    t = pt(a) + pt(b)
    return (t * math.cos(f), t * math.sin(f), t * math.sinh(y), t * math.cosh(y))


def cluster(particles, family="pp", R=0.4, p=-1.0, scheme="E"):
    """List of (parent1, parent2 or -1, dij, momentum of the merged object or beam jet)."""
    if scheme != "E":
        particles = [(x, y, z, math.sqrt(x * x + y * y + z * z)) for x, y, z, _ in particles]
    objects = dict(enumerate(map(tuple, particles)))
    n, steps = len(objects), []

    def weight(v):
        size = v[0] ** 2 + v[1] ** 2 if family == "pp" else v[3] ** 2
        return max(size, 1e-300) ** p

    def pair(a, b):
        low = min(weight(a), weight(b))
        if family == "pp":
            return low * ((rap(a) - rap(b)) ** 2 + dphi(a, b) ** 2) / R ** 2
        if family == "Durham":
            return 2 * low * angle(a, b)
        return low * angle(a, b) / (1 - math.cos(R) if R < math.pi else 3 + math.cos(R))

    while objects:
        ids = sorted(objects)
        found = [(pair(objects[i], objects[j]), i, j) for x, i in enumerate(ids) for j in ids[x + 1:]]
        if family != "Durham" or len(ids) == 1:
            scale = 4.0 if family == "Durham" else 1.0
            found += [(scale * weight(objects[i]), i, math.inf) for i in ids]
        d, i, j = min(found)
        if j is math.inf:
            steps.append((i, -1, d, objects.pop(i)))
        else:
            made = merge(objects.pop(i), objects.pop(j), scheme)
            objects[n + len(steps)] = made
            steps.append((i, j, d, made))
    return steps
