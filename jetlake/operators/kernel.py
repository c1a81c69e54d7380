"""Sequential recombination of a batch of events, as NumPy array steps.

This is the one piece of per-event arithmetic that Spark's own expressions
cannot state: a loop whose every step depends on the previous one.  All events
of a batch advance together, one recombination per step, so the interpreter
cost is paid per step and not per event.  Events are laid out as rows of a
(event, slot) array, longest first: the events still running at step ``s`` are
then always a prefix of the rows.

Slots hold objects in creation order.  ``near`` is the distance of each object
to its geometric nearest neighbour ``nn`` (slot, -1 for none within reach); the
smallest ``weight * near`` over the slots is the smallest d_ij of the event,
because the smallest d_ij always joins geometric nearest neighbours.
"""

import numpy as np

FAR = 1e20
TWO_PI = 2.0 * np.pi
TINY_KT2 = 1e-300
# Work per chunk of events: small enough for the arrays of a step to stay in cache.
CHUNK_SLOTS, CHUNK_EVENTS = 100_000, 800


class Spec:
    """Resolved clustering parameters (see ``clustering.resolve``)."""

    def __init__(self, family, R, power, scheme="E", strategy="Best"):
        self.family, self.R, self.power = family, R, power
        self.scheme, self.strategy = scheme, strategy
        if family == "pp":
            self.reach, self.scale = R * R, 1.0 / (R * R)
        elif family == "Durham":
            # 1 - cos(theta) never reaches 4, so nothing meets the beam early.
            self.reach, self.scale = 4.0, 2.0
        else:
            self.reach = 1.0 - np.cos(R) if R < np.pi else 3.0 + np.cos(R)
            self.scale = 1.0 / self.reach


def rapidity(pt2, pz, e):
    """Rapidity, with the convention +-(1e5 + |pz|) for E = |pz| and pt = 0."""
    az = np.abs(pz)
    total = e + az
    part = np.maximum((e + pz) * (e - pz), pt2)
    if part.all():
        return np.copysign(0.5 * np.log(part / (total * total)), pz)
    flat = part <= 0
    y = 0.5 * np.log(np.where(flat, 1.0, part) / np.where(flat, 1.0, total * total))
    return np.copysign(np.where(flat, 1e5 + az, y), pz)


def azimuth(px, py):
    phi = np.arctan2(py, px)
    phi[phi < 0] += TWO_PI
    phi[phi >= TWO_PI] = 0.0
    return phi


def place(mom, spec):
    """Coordinates (first axis) and weight of objects with momenta ``mom``."""
    px, py, pz, e = mom
    if spec.family == "pp":
        pt2 = px * px + py * py
        size, pos = pt2, np.stack([rapidity(pt2, pz, e), azimuth(px, py)])
    else:
        p = np.sqrt(px * px + py * py + pz * pz)
        unit = np.where(p > 0, p, 1.0)
        size, pos = e * e, np.stack([px / unit, py / unit, pz / unit, np.ones_like(p)])
    if spec.power == 0:
        return pos, np.ones_like(size)
    return pos, np.power(np.maximum(size, TINY_KT2), spec.power)


def distance(a, b, spec):
    """Squared (y, phi) distance, or 1 - cos(theta), of points ``a`` from ``b``."""
    if spec.family == "pp":
        dphi = np.subtract(a[1], b[1])
        np.abs(dphi, out=dphi)
        np.minimum(dphi, TWO_PI - dphi, out=dphi)
        np.multiply(dphi, dphi, out=dphi)
        dy = np.subtract(a[0], b[0])
        np.multiply(dy, dy, out=dy)
        return np.add(dy, dphi, out=dy)
    dot = a[0] * b[0]
    dot += a[1] * b[1]
    dot += a[2] * b[2]
    return np.subtract(a[3], dot, out=dot)


def _headroom(width):
    """Slots kept free for new objects before gaps are closed."""
    return width if width <= 32 else width // 2


def _where(mask):
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def recombine(a, b, scheme):
    if scheme == "E":
        return a + b
    pts = np.hypot(a[0], a[1]), np.hypot(b[0], b[1])
    wa, wb = pts if scheme == "pt" else (pts[0] ** 2, pts[1] ** 2)
    total = np.where(wa + wb > 0, wa + wb, 1.0)
    phi_a, phi_b = azimuth(a[0], a[1]), azimuth(b[0], b[1])
    turn = phi_b - phi_a
    turn = np.where(turn > np.pi, turn - TWO_PI, np.where(turn < -np.pi, turn + TWO_PI, turn))
    phi = phi_a + wb * turn / total
    y = (wa * rapidity(pts[0] ** 2, a[2], a[3]) + wb * rapidity(pts[1] ** 2, b[2], b[3])) / total
    pt = pts[0] + pts[1]
    return np.stack([pt * np.cos(phi), pt * np.sin(phi), pt * np.sinh(y), pt * np.cosh(y)])


class Steps:
    """Recombination steps of a batch, one flat entry per step (event-major)."""

    def __init__(self, counts):
        self.counts = counts
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        total = int(self.offsets[-1])
        self.parent1 = np.full(total, -1, np.int32)
        self.parent2 = np.full(total, -1, np.int32)
        self.dij = np.zeros(total)
        self.max_dij = np.zeros(total)
        # Momentum of the merged object, or of the jet that meets the beam.
        self.mom = np.zeros((4, total))


def cluster_batch(mom, counts, spec, max_steps=None):
    """Cluster events given as flat momenta (4, sum(counts)), event after event."""
    if spec.scheme != "E":
        mom = mom.copy()
        mom[3] = np.sqrt(mom[0] ** 2 + mom[1] ** 2 + mom[2] ** 2)
    steps = Steps(counts)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    at = 0
    while at < len(order):
        width = int(counts[order[at]])
        rows = order[at:at + max(1, min(CHUNK_EVENTS, CHUNK_SLOTS // width))]
        at += len(rows)
        n = counts[rows]
        slot = np.arange(width)
        filled = slot < n[:, None]
        source = np.where(filled, steps.offsets[rows][:, None] + slot, 0)
        start = np.where(filled, mom[:, source], 0.0)
        search = _tiled if _use_tiles(start, n, spec) else _lockstep
        search(start, n, spec, steps, steps.offsets[rows], width if max_steps is None else min(width, max_steps))
    return steps


def _use_tiles(start, n, spec):
    """Whether to look for neighbours in tiles of the (y, phi) plane only.

    Worth it when the tiles around an object hold a small part of its event.
    """
    if spec.family != "pp" or spec.strategy == "N2Plain":
        return False
    if spec.strategy == "N2Tiled":
        return True
    if start.shape[2] < 350:
        return False
    tiles = Tiles(len(n), spec.R)
    event, slot = np.nonzero(np.arange(start.shape[2]) < n[:, None])
    tile = tiles.locate(event, *place(start[:, event, slot], spec)[0])
    tiles.count = np.bincount(tile, minlength=len(tiles.count))
    return 12 * tiles.crowd(tile).sum() < (n * n).sum()


class Tiles:
    """Objects of many events by (y, phi) tile.

    A tile is at least R wide, so whatever is within R of an object lies in its
    own tile or one next to it.  ``members`` lists the objects of each tile;
    the last, always empty, tile stands in for neighbours beyond the edge.
    """

    MAX_Y = 10.0
    MIN_SIZE = 0.3

    def __init__(self, events, R):
        size = max(R, self.MIN_SIZE)
        self.ny = max(1, int(2 * self.MAX_Y / size))
        self.nphi = max(1, int(TWO_PI / size))
        self.per_event = self.ny * self.nphi
        iy, iphi = np.divmod(np.arange(self.per_event), self.nphi)
        turns = sorted({t % self.nphi for t in (-1, 0, 1)}) if self.nphi < 3 else (-1, 0, 1)
        self.empty = events * self.per_event
        self.steps = []
        for dy in (-1, 0, 1):
            for dphi in turns:
                to = (iy + dy) * self.nphi + (iphi + dphi) % self.nphi
                self.steps.append(np.where((iy + dy >= 0) & (iy + dy < self.ny), to, -1))
        self.steps = np.stack(self.steps, axis=1)
        self.members = np.full((self.empty + 1, 4), -1, np.int64)
        self.count = np.zeros(self.empty + 1, np.int64)

    def locate(self, event, y, phi):
        iy = ((np.clip(y, -self.MAX_Y, self.MAX_Y) + self.MAX_Y) * (self.ny / (2 * self.MAX_Y))).astype(np.int64)
        iphi = (phi * (self.nphi / TWO_PI)).astype(np.int64)
        return event * self.per_event + np.minimum(iy, self.ny - 1) * self.nphi + np.minimum(iphi, self.nphi - 1)

    def _room(self, needed):
        width = self.members.shape[1]
        if needed > width:
            more = np.full((len(self.members), max(needed, width + width // 2) - width), -1, np.int64)
            self.members = np.concatenate([self.members, more], axis=1)

    def fill(self, tile, ident):
        """Enter many objects at once."""
        order = np.argsort(tile, kind="stable")
        tile, ident = tile[order], ident[order]
        place = np.arange(len(tile)) - np.searchsorted(tile, tile)
        self._room(2 * int(place.max()) + 2)
        self.members[tile, place] = ident
        self.count = np.bincount(tile, minlength=len(self.count))

    def add(self, tile, ident):
        """Enter objects into tiles that are all different."""
        place = self.count[tile]
        self._room(int(place.max(initial=0)) + 1)
        self.members[tile, place] = ident
        self.count[tile] = place + 1

    def remove(self, tile, ident):
        last = self.count[tile] - 1
        place = (self.members[tile] == ident[:, None]).argmax(axis=1)
        self.members[tile, place] = self.members[tile, last]
        self.members[tile, last] = -1
        self.count[tile] = last

    def _beside(self, tile):
        event, own = np.divmod(tile, self.per_event)
        near = self.steps[own]
        return np.where(near < 0, self.empty, near + (event * self.per_event)[:, None])

    def crowd(self, tile):
        """How many objects ``around`` would list for each tile."""
        return self.count[self._beside(tile)].sum(axis=1)

    def around(self, tile):
        """Members of the tiles at and next to each given one, query by query.

        Returns the number of members per query, and for each member its query
        and object number.
        """
        near = self._beside(tile)
        counts = self.count[near]
        per_query = counts.sum(axis=1)
        flat = counts.reshape(-1)
        ends = np.cumsum(flat)
        cell = np.repeat(np.arange(len(flat)), flat)
        place = np.arange(len(cell)) - (ends - flat)[cell]
        return per_query, cell // near.shape[1], self.members[near.reshape(-1)[cell], place]


def _earliest(cost, mate_of, facts, spec):
    """The slot of each row's next step: of equal costs the one of least (distance, first, second).

    ``mate_of`` gives the neighbour's slot for rows and slots (negative for the
    beam), ``facts`` their weight, reach and name.
    """
    if spec.power == 0:
        # Equal weights: partners of equal cost are both in the tie, so its first slot has the least numbers.
        return cost.argmin(axis=1)
    row, slot = _where(cost == cost.min(axis=1)[:, None])
    if len(row) == len(cost):
        return slot
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    counts = np.diff(starts, append=len(row))
    chosen = slot[starts]
    # Two slots that have each other are one step.
    open_ = counts > 1
    two = starts[counts == 2]
    one = (mate_of(row[two], slot[two]) == slot[two + 1]) & (mate_of(row[two], slot[two + 1]) == slot[two])
    open_[row[two[one]]] = False
    if not open_.any():
        return chosen
    seen = open_[row]
    row, slot = row[seen], slot[seen]
    mate, (w, near, name) = mate_of(row, slot), facts(row, slot)
    beam = mate < 0
    mate_w, _, mate_name = facts(row, np.where(beam, slot, mate))
    d = np.where(beam, w, spec.scale * near * np.minimum(w, mate_w))
    mate_name = np.where(beam, np.inf, mate_name)
    order = np.lexsort((np.maximum(name, mate_name), np.minimum(name, mate_name), d, row))
    chosen[open_] = slot[order[np.flatnonzero(np.diff(row[order], prepend=-1))]]
    return chosen


def _tiled(start, n, spec, steps, base, total_steps):
    """As ``_lockstep``, looking for neighbours only in the tiles around an object.

    Objects are numbered over all events, event by event in creation order.
    """
    events, width = start.shape[1:]
    reach = np.nextafter(spec.reach, np.inf)
    span = 2 * width
    total = events * span
    # One more entry is the object that stands for "none": out of everyone's reach.
    y, phi = np.full(total + 1, FAR), np.zeros(total + 1)
    weight, near = np.full(total + 1, np.inf), np.full(total + 1, reach)
    nn, tile = np.full(total + 1, -1, np.int64), np.zeros(total + 1, np.int64)
    mom = np.zeros((4, total))
    cost = np.full((events, span), np.inf)
    flat_cost = cost.reshape(-1)
    tiles = Tiles(events, spec.R)
    running = np.searchsorted(-n, -np.arange(width + 1), side="left")

    def search(ident):
        """Nearest neighbour within reach of each object; and what was looked at."""
        per_query, q, found = tiles.around(tile[ident])
        d = distance((y[found], phi[found]), (y[ident][q], phi[ident][q]), spec)
        d[found == ident[q]] = FAR
        starts = np.cumsum(per_query) - per_query  # an object sees itself, so no query is empty
        best = np.minimum.reduceat(d, starts)
        at_best = np.flatnonzero(d == best[q])
        first = np.full(len(ident), total)
        np.minimum.at(first, q[at_best], found[at_best])
        seen = best < reach
        return np.where(seen, best, reach), np.where(seen, first, -1), q, found, d

    def settle(ident, best, neighbour):
        near[ident], nn[ident] = best, neighbour
        flat_cost[ident] = weight[ident] * best

    event, slot = np.nonzero(np.arange(width) < n[:, None])
    ident = event * span + slot
    mom[:, ident] = start[:, event, slot]
    pos, weight[ident] = place(mom[:, ident], spec)
    y[ident], phi[ident] = pos
    tile[ident] = tiles.locate(event, *pos)
    tiles.fill(tile[ident], ident)
    for part in np.array_split(ident, max(1, len(ident) // 4000)):
        settle(part, *search(part)[:2])

    def mate_of(row, slot):
        mate = nn[row * span + slot]
        return np.where(mate < 0, -1, mate - row * span)

    def facts(row, slot):
        at = row * span + slot  # slots are in the order of creation, as are the names
        return weight[at], near[at], slot

    worst = np.zeros(events)
    for step in range(total_steps):
        k = running[step]
        r = np.arange(k)
        i = _earliest(cost[:k, :width + step], mate_of, facts, spec) + r * span
        j = nn[i]
        beam = j < 0
        j = np.where(beam, i, j)
        pair = ~beam
        w = np.minimum(weight[i], weight[j])
        d = np.where(beam, w, spec.scale * near[i] * w)
        worst[:k] = np.maximum(worst[:k], d)
        first, second = np.minimum(i, j), np.maximum(i, j)
        if spec.scheme == "E":
            merged = mom[:, i] + pair * mom[:, j]
        else:
            merged = np.where(beam, mom[:, i], recombine(mom[:, first], mom[:, second], spec.scheme))

        def name(ident):
            s = ident - r * span
            return np.where(s < width, s, s - width + n[:k])

        out = base[:k] + step
        steps.parent1[out] = name(first)
        steps.parent2[out] = np.where(beam, -1, name(second))
        steps.dij[out], steps.max_dij[out] = d, worst[:k]
        steps.mom[:, out] = merged

        tiles.remove(tile[i], i)
        gone_j = j[pair]
        tiles.remove(tile[gone_j], gone_j)
        flat_cost[i] = flat_cost[j] = np.inf

        if pair.any():
            new = (r * span + width + step)[pair]
            mom[:, new] = merged[:, pair]
            pos, weight[new] = place(merged[:, pair], spec)
            y[new], phi[new] = pos
            tile[new] = tiles.locate(r[pair], *pos)
            tiles.add(tile[new], new)
            best, neighbour, q, found, d = search(new)
            settle(new, best, neighbour)
            closer = np.flatnonzero(d < near[found])
            closer = closer[found[closer] != new[q[closer]]]
            settle(found[closer], d[closer], new[q[closer]])

        # Objects whose neighbour has gone are around the place it had.
        gone = np.concatenate([i, gone_j])
        _, q, found = tiles.around(tile[gone])
        stale = found[nn[found] == gone[q]]
        if len(stale):
            settle(stale, *search(stale)[:2])


def _lockstep(start, n, spec, steps, base, total_steps):
    events, width = start.shape[1:]
    # A distance equal to the reach still counts as a pair, ahead of the beam.
    reach = np.nextafter(spec.reach, np.inf)

    pos, weight = place(start, spec)
    last = 4 + len(pos)
    P, (COST, WEIGHT, NEAR, NAME) = slice(4, last), range(last, last + 4)
    # A slot nobody can see or choose: out of reach and infinitely costly.
    dead = np.zeros((last + 4, 1))
    dead[4 if spec.family == "pp" else 7] = FAR
    dead[[COST, WEIGHT, NEAR]] = [[np.inf], [np.inf], [reach]]

    size = width + _headroom(width)
    state = np.empty((last + 4, events, size))
    state[:, :, width:] = dead[:, :, None]
    state[:4, :, :width], state[P, :, :width], state[WEIGHT, :, :width] = start, pos, weight
    state[NEAR, :, :width], state[NAME, :, :width] = reach, np.arange(width)
    empty = np.nonzero(np.arange(width) >= n[:, None])
    state[:, empty[0], empty[1]] = dead
    if spec.family == "pp":  # keeps empty slots out of each other's reach
        state[4, empty[0], empty[1]] = FAR * (1.0 + empty[1])
    neighbour = np.full((events, size), -1, np.int16 if 2 * width < 32_000 else np.int32)
    running = np.searchsorted(-n, -np.arange(width + 1), side="left")  # events longer than i

    rows = np.arange(events)
    for i in range(1, width):
        k = running[i]
        d = distance(state[P, :k, :i], state[P, :k, i:i + 1], spec)
        q, s = _where(d < state[NEAR, :k, :i])
        state[NEAR, q, s], neighbour[q, s] = d[q, s], i
        j = d.argmin(axis=1)
        best = d[rows[:k], j]
        state[NEAR, :k, i] = np.minimum(best, reach)
        neighbour[:k, i] = np.where(best < reach, j, -1)
    state[COST] = state[WEIGHT] * state[NEAR]

    worst = np.zeros(events)
    fill = n.copy()  # where the next object of each event goes
    used = width
    for step in range(total_steps):
        k, c = running[step], used
        r = rows[:k]
        i = _earliest(state[COST, :k, :c], lambda row, slot: neighbour[row, slot].astype(np.intp),
                      lambda row, slot: state[WEIGHT:, row, slot], spec)
        one = state[:, r, i]
        j = neighbour[r, i].astype(np.intp)
        beam = j < 0
        pairs = np.flatnonzero(~beam)
        j = np.where(beam, i, j)
        two = state[:, pairs, j[pairs]]
        w, merged, name = one[WEIGHT], one[:4], one[NAME]
        d = w * (4.0 if spec.family == "Durham" else 1.0)
        other = np.full(k, -1.0)
        if len(pairs):
            lead = one[:, pairs]
            d[pairs] = spec.scale * lead[NEAR] * np.minimum(lead[WEIGHT], two[WEIGHT])
            swap = lead[NAME] > two[NAME]
            if spec.scheme == "E":
                made = lead[:4] + two[:4]
            else:
                made = recombine(np.where(swap, two[:4], lead[:4]), np.where(swap, lead[:4], two[:4]), spec.scheme)
            merged[:, pairs] = made
            other[pairs], name[pairs] = np.maximum(lead[NAME], two[NAME]), np.minimum(lead[NAME], two[NAME])
        worst[:k] = np.maximum(worst[:k], d)
        out = base[:k] + step
        steps.parent1[out], steps.parent2[out] = name, other
        steps.dij[out], steps.max_dij[out] = d, worst[:k]
        steps.mom[:, out] = merged
        state[:, r, i], neighbour[r, i] = dead, -1

        if len(pairs):
            state[:, pairs, j[pairs]], neighbour[pairs, j[pairs]] = dead, -1
            pos, weight = place(made, spec)
            view = slice(0, k) if len(pairs) == k else pairs
            d = distance(state[P, view, :c], pos[:, :, None], spec)
            q, s = _where(d < state[NEAR, view, :c])
            at = fill[pairs]
            closer, q_row = d[q, s], pairs[q]
            state[NEAR, q_row, s], neighbour[q_row, s] = closer, at[q]
            state[COST, q_row, s] = state[WEIGHT, q_row, s] * closer
            a = d.argmin(axis=1)
            best = d[np.arange(len(pairs)), a]
            near = np.minimum(best, reach)
            state[:, pairs, at] = np.concatenate(
                [made, pos, [weight * near, weight, near, n[pairs] + step]])
            neighbour[pairs, at] = np.where(best < reach, a, -1)
            fill[pairs] += 1
            used = max(used, int(fill[:k].max()))

        # Objects whose neighbour has gone look for a new one.
        seen = neighbour[:k, :used]
        gone_i, gone_j = i.astype(seen.dtype)[:, None], j.astype(seen.dtype)[:, None]
        q, s = _where((seen == gone_i) | (seen == gone_j) if len(pairs) else seen == gone_i)
        if len(q):
            d = distance(state[P, q, :used], state[P, q, s][:, :, None], spec)
            m = np.arange(len(q))
            d[m, s] = FAR
            a = d.argmin(axis=1)
            best = d[m, a]
            neighbour[q, s] = np.where(best < reach, a, -1)
            best = np.minimum(best, reach)
            state[NEAR, q, s], state[COST, q, s] = best, state[WEIGHT, q, s] * best

        if used == state.shape[2] and step + 1 < total_steps:
            # Close the gaps, keeping creation order; drop finished events.
            k = running[step + 1]
            live = np.isfinite(state[WEIGHT, :k])
            fill = live.sum(axis=1)
            used = int(fill.max())
            size = used + _headroom(used)
            q, s = _where(live)
            to = np.cumsum(live, axis=1) - 1
            packed = np.empty((last + 4, k, size))
            packed[:] = dead[:, :, None]
            packed[:, q, to[q, s]] = state[:, q, s]
            old = neighbour[q, s].astype(np.intp)
            neighbour = np.full((k, size), -1, neighbour.dtype)
            neighbour[q, to[q, s]] = np.where(old >= 0, to[q, np.maximum(old, 0)], -1)
            state = packed
