"""Sequential geometry in numpy, for one building at a time inside grouped Arrow functions."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable

import numpy as np


def face_checks(ring: list[tuple], thick: float, degrees: float, same: float = 0.01, touch: float = 0.001) -> tuple:
    """(ring without doubled corners, doubled, repaired, zero area, non-plane, crossings, touches) of a face in space."""
    p = np.asarray(ring, float).reshape(-1, 3)
    double = (np.abs(p - np.roll(p, 1, 0)) < same).all(1) if len(p) > 1 else np.zeros(len(p), bool)
    doubled, p = int(double.sum()), p[~double]
    if len(p) < 3:
        return p.tolist(), doubled, False, False, False, 0, 0
    zero, uneven, crossings, touches = (x[0].item() for x in shape_checks(p[None], thick, degrees, touch))
    return p.tolist(), doubled, True, zero, uneven, crossings, touches


def shape_checks(p: np.ndarray, thick: float, degrees: float, touch: float = 0.001) -> tuple[np.ndarray, ...]:
    """(zero area, non-plane, crossings, touches) of many rings with equally many corners: faces x corners x 3."""
    n = p.shape[1]
    step = np.roll(p, -1, 1) - p
    turns = np.cross(np.roll(step, -1, 1), step)
    normal = turns.sum(1)
    size = np.linalg.norm(normal, axis=1)
    zero = size <= 1e-12
    unit = normal / np.where(zero, 1, size)[:, None]
    along = np.einsum("fnk,fk->fn", p, unit)
    lengths = np.linalg.norm(turns, axis=2)
    cosine = np.abs(np.einsum("fnk,fk->fn", turns, unit)) / np.where(lengths > 0, lengths, 1)
    bend = np.where(lengths > 0, np.degrees(np.arccos(np.clip(cosine, 0, 1))), 0).max(1)
    uneven = (n > 3) & ~zero & ((np.ptp(along, axis=1) > thick) | (bend > degrees))
    # the plane in which the face is largest
    drop = np.abs(normal).argmax(1)
    axes = np.array([[1, 2], [0, 2], [0, 1]])[drop]
    q = np.take_along_axis(p, axes[:, None, :], 2)
    e = np.roll(q, -1, 1) - q
    cross2 = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    crossings, touches = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for i in range(n):
        for j in range(n):
            if j in (i, (i - 1) % n):
                continue
            gap = q[:, j] - q[:, i]
            if j > i and j != (i + 1) % n:
                d = cross2(e[:, i], e[:, j])
                safe = np.where(d == 0, 1, d)
                s, t = cross2(gap, e[:, j]) / safe, cross2(gap, e[:, i]) / safe
                crossings += (d != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1)
            at = np.clip(-(gap * e[:, j]).sum(1) / np.maximum((e[:, j] ** 2).sum(1), 1e-300), 0, 1)
            touches += np.linalg.norm(gap + at[:, None] * e[:, j], axis=1) <= touch
    return zero, uneven, np.where(zero, 0, crossings), np.where(zero, 0, touches)


def flattened(ring: np.ndarray) -> np.ndarray:
    """A ring in space as seen along its normal's largest axis; counter-clockwise where the normal points that way."""
    p = np.asarray(ring, float)
    step = np.roll(p, -1, 0) - p
    normal = np.cross(step, np.roll(step, -1, 0)).sum(0)
    return np.delete(p, int(np.abs(normal).argmax()), 1)


def triangles(ring: list[tuple]) -> np.ndarray:
    """The triangles (n x 3 x 3) of a simple ring in space, by ear clipping; they keep its winding."""
    p = np.asarray(ring, float).reshape(-1, 3)
    if len(p) < 3:
        return np.empty((0, 3, 3))
    q = flattened(p)
    found = ear_clipped([tuple(v) for v in q])
    x, y = q[:, 0], q[:, 1]
    if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:  # the clipper works counter-clockwise
        found = [t[::-1] for t in found]
    return p[np.array(found, int).reshape(-1, 3)]


def triangles_of_all(rings: np.ndarray) -> np.ndarray:
    """triangles() of rings of equally many corners (m x n x 3) at once: m x (n - 2) x 3 x 3."""
    m, n = rings.shape[:2]
    step = np.roll(rings, -1, 1) - rings
    normal = np.cross(step, np.roll(step, -1, 1)).sum(1)
    kept = np.array([(1, 2), (0, 2), (0, 1)])[np.abs(normal).argmax(1)]
    q = np.take_along_axis(rings, np.broadcast_to(kept[:, None], (m, n, 2)), 2)
    most = max(1, 2_000_000 // (n * n))
    found = np.concatenate([ears_clipped(q[k : k + most]) for k in range(0, m, most)] or [np.empty((0, n - 2, 3), int)])
    x, y = q[..., 0], q[..., 1]
    back = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) < 0
    found[back] = found[back][..., ::-1]
    return rings[np.arange(m)[:, None, None], found]


def triangles_cross(t: np.ndarray, o: np.ndarray, same: float = 0.001, flat: float = 1e-6) -> np.ndarray:
    """For pairs of triangles (n x 3 x 3 each): whether an edge of one goes through the inside of the other.

    Pairs with a common edge, or with a triangle of no area, do not cross; nor do those that only touch.
    """
    near = (np.abs(t[:, :, None] - o[:, None]) < same).all(3)
    common = np.zeros(len(t), bool)
    for i in range(3):
        for j in range(3):
            k, m = (i + 1) % 3, (j + 1) % 3
            common |= near[:, i, j] & near[:, k, m] | near[:, i, m] & near[:, k, j]
    size = lambda x: np.linalg.norm(np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]), axis=1)
    possible = ~common & (size(t) > 1e-12) & (size(o) > 1e-12)
    return possible & (_through(t, o, flat) | _through(o, t, flat))


def _through(t: np.ndarray, o: np.ndarray, flat: float) -> np.ndarray:
    """Whether an edge of o goes through the inside of t."""
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    n = n / np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
    far = np.einsum("nkc,nc->nk", o - t[:, None, 0], n)
    far[np.abs(far) < flat] = 0
    out = np.zeros(len(t), bool)
    for i in range(3):
        a, b = far[:, i], far[:, (i + 1) % 3]
        through = a * b < 0
        s = a / np.where(through, a - b, 1)
        hit = o[:, i] + s[:, None] * (o[:, (i + 1) % 3] - o[:, i])
        sides = [np.einsum("nc,nc->n", np.cross(t[:, (k + 1) % 3] - t[:, k], hit - t[:, k]), n) for k in range(3)]
        out |= through & (sides[0] > flat) & (sides[1] > flat) & (sides[2] > flat)
    return out


def open_rings(faces: Iterable[list[tuple]], snap: float = 0.001) -> list[list[tuple]]:
    """The openings of a solid's faces, each as a ring that closes it (against the direction of the open edges).

    Edges that run against each other cancel; the edges left on one line are cut at each other's ends, so that an edge
    that stands against two shorter ones cancels too; what is left is joined where it runs straight on, and walked.
    """
    return rings_of_edges([(p, q) for ring in faces for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)], snap)


def rings_of_edges(lines: list[tuple[tuple, tuple]], snap: float = 0.001) -> list[list[tuple]]:
    """As open_rings(), from directed edges (p, q)."""
    names: dict[tuple, int] = {}
    points: list[np.ndarray] = []

    def name(v) -> int:
        key = tuple(np.rint(np.asarray(v) / snap).astype(np.int64).tolist())
        if key not in names:
            names[key] = len(points)
            points.append(np.asarray(v, float))
        return names[key]

    left = cancelled((a, b) for a, b in ((name(p), name(q)) for p, q in lines) if a != b)
    left = cancelled(part for a, b in left for part in _cut_at(a, b, {v for e in left for v in e}, points, snap))
    return [[tuple(points[v].tolist()) for v in reversed(_straightened(ring, points))] for ring in edge_rings(left)]


def cancelled(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Directed edges without the pairs that run against each other."""
    count: dict[tuple[int, int], int] = {}
    for a, b in edges:
        if count.get((b, a)):
            count[b, a] -= 1
        else:
            count[a, b] = count.get((a, b), 0) + 1
    return [e for e, n in count.items() for _ in range(n)]


def _cut_at(a: int, b: int, ends: set[int], points: list[np.ndarray], snap: float) -> list[tuple[int, int]]:
    """An edge cut at the ends of others that lie on it."""
    u = points[b] - points[a]
    length = float(np.linalg.norm(u))
    on = []
    for v in sorted(ends - {a, b}):
        t = float((points[v] - points[a]) @ u) / length**2
        if 0 < t < 1 and np.linalg.norm(points[v] - points[a] - t * u) < snap:
            on.append((t, v))
    row = [a, *(v for _, v in sorted(on)), b]
    return list(zip(row, row[1:], strict=False))


def _straightened(ring: list[int], points: list[np.ndarray], least: float = 1e-6) -> list[int]:
    """A ring without the corners at which it runs straight on."""
    out = list(ring)
    k = 0
    while k < len(out) and len(out) > 3:
        p, q, r = (points[out[(k + d) % len(out)]] for d in (-1, 0, 1))
        u, v = q - p, r - q
        if np.linalg.norm(np.cross(u, v)) < least * np.linalg.norm(u) * np.linalg.norm(v) and u @ v > 0:
            out.pop(k)
            k = 0
        else:
            k += 1
    return out


def element_of(ring: list[tuple], tolerance: float = 2.0) -> str | None:
    """GROUND, WALL or ROOF from the angle between a ring's reversed normal and straight down; None without area."""
    p = np.asarray(ring, float)
    step = np.roll(p, -1, 0) - p
    normal = np.cross(np.roll(step, -1, 0), step).sum(0)
    size = float(np.linalg.norm(normal))
    if size <= 1e-12:
        return None
    tilt = math.degrees(math.acos(max(-1.0, min(1.0, -float(normal[2]) / size))))
    return "GROUND" if tilt < tolerance else "WALL" if 90 - tilt < tolerance else "ROOF"


def ear_clipped(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles (indexes) of a simple ring; what cannot be clipped is fanned."""
    p = np.asarray(ring, float)
    turn = lambda a, b, c: (p[b, 0] - p[a, 0]) * (p[c, 1] - p[a, 1]) - (p[b, 1] - p[a, 1]) * (p[c, 0] - p[a, 0])
    x, y = p[:, 0], p[:, 1]
    left = list(range(len(p)))
    if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
        left.reverse()
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if turn(a, b, c) <= 0:
                continue
            if not any(turn(a, b, v) >= 0 and turn(b, c, v) >= 0 and turn(c, a, v) >= 0 for v in left if v not in (a, b, c)):
                out.append((a, b, c))
                left.pop(k)
                break
        else:
            return out + [(left[0], left[k], left[k + 1]) for k in range(1, len(left) - 1)]
    return out + [tuple(left)] if len(left) == 3 else out


def ears_clipped(rings: np.ndarray) -> np.ndarray:
    """ear_clipped() of rings of equally many corners (m x n x 2) at once: m x (n - 2) x 3."""
    m, n = rings.shape[:2]
    x, y = rings[..., 0], rings[..., 1]
    left = np.tile(np.arange(n), (m, 1))
    back = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) < 0
    left[back] = left[back][:, ::-1]
    out = np.empty((m, n - 2, 3), int)
    rows = np.arange(m)
    turn = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    for size in range(n, 3, -1):
        b = rings[rows[:, None], left]
        a, c = np.roll(b, 1, 1), np.roll(b, -1, 1)
        v, e, f, g = b[:, None], a[:, :, None], b[:, :, None], c[:, :, None]
        within = (turn(e, f, v) >= 0) & (turn(f, g, v) >= 0) & (turn(g, e, v) >= 0)
        at = np.arange(size)
        for d in (-1, 0, 1):
            within[:, at, (at + d) % size] = False
        ear = ~(turn(a, b, c) <= 0) & ~within.any(2)
        some, k = ear.any(1), ear.argmax(1)
        stuck = left[~some]
        for i in range(size - 2):
            out[rows[~some], n - size + i] = stuck[:, [0, i + 1, i + 2]]
        rows, left, k = rows[some], left[some], k[some]
        own = np.arange(len(rows))
        out[rows, n - size] = np.stack([left[own, k - 1], left[own, k], left[own, (k + 1) % size]], 1)
        left = left[np.arange(size) != k[:, None]].reshape(-1, size - 1)
    out[rows, n - 3] = left
    return out


def triangulated(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """The triangulation of a simple ring with the least total length of diagonals: O(n**3) by intervals."""
    p = np.asarray(ring, float)
    n = len(p)
    far = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    inner = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i + 2, n):
            inner[i, j] = (i, j) == (0, n - 1) or _diagonal(p, i, j)
    cost, split = np.full((n, n), np.inf), np.zeros((n, n), int)
    for i in range(n - 1):
        cost[i, i + 1] = 0
    for span in range(2, n):
        for i in range(n - span):
            j = i + span
            if not inner[i, j]:
                continue
            ks = np.arange(i + 1, j)
            total = cost[i, ks] + cost[ks, j] + np.where(ks > i + 1, far[i, ks], 0) + np.where(ks < j - 1, far[ks, j], 0)
            best = int(np.argmin(total))
            cost[i, j], split[i, j] = total[best], ks[best]
    out, todo = [], [(0, n - 1)]
    while todo:
        i, j = todo.pop()
        if j - i >= 2 and np.isfinite(cost[i, j]):
            k = int(split[i, j])
            out.append((i, k, j))
            todo += [(i, k), (k, j)]
    return sorted(out)


def _diagonal(p: np.ndarray, i: int, j: int) -> bool:
    n = len(p)
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for k in range(n):
        m = (k + 1) % n
        if {k, m} & {i, j}:
            continue
        if side(p[i], p[j], p[k]) * side(p[i], p[j], p[m]) < 0 and side(p[k], p[m], p[i]) * side(p[k], p[m], p[j]) < 0:
            return False
    return inside(p, (p[i] + p[j]) / 2)


def inside(p: np.ndarray, q: np.ndarray) -> bool:
    a, b = p, np.roll(p, -1, 0)
    over = (a[:, 1] > q[1]) != (b[:, 1] > q[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (q[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool(np.count_nonzero(over & (q[0] < at)) % 2)


def simplified(ring: list, least: float = 1e-4) -> list:
    """The ring without corners whose turn has a sine under least, until none is left."""
    p = [np.asarray(v, float) for v in ring]
    while len(p) > 3:
        for k in range(len(p)):
            u, v = p[k] - p[k - 1], p[(k + 1) % len(p)] - p[k]
            size = np.linalg.norm(u) * np.linalg.norm(v)
            if size == 0 or abs(u[0] * v[1] - u[1] * v[0]) / size < least:
                p.pop(k)
                break
        else:
            break
    return [tuple(v) for v in p]


def mean_shift(values: np.ndarray, weights: np.ndarray, band: float) -> np.ndarray:
    """Label of each value: flat-kernel mean shift in one dimension, seeded by bins of the bandwidth.

    values are distinct and carry weights, so a histogram does as well as the points. Modes closer than the band are
    one, the heavier stays; labels follow the modes' weight, heaviest first.
    """
    order = np.argsort(values)
    v, total = values[order], np.concatenate([[0.0], np.cumsum(weights[order])])
    moment = np.concatenate([[0.0], np.cumsum(weights[order] * v)])
    modes = []
    for seed in np.unique(np.round(v / band)) * band:
        for _ in range(300):
            a, b = np.searchsorted(v, [seed - band, seed + band], side="left")
            b = np.searchsorted(v, seed + band, side="right")
            if total[b] == total[a]:
                break
            mean = (moment[b] - moment[a]) / (total[b] - total[a])
            if abs(mean - seed) < 1e-3 * band:
                modes.append((total[b] - total[a], mean))
                break
            seed = mean
    kept: list[float] = []
    for _, mode in sorted(modes, key=lambda m: (-m[0], m[1])):
        if all(abs(mode - k) >= band for k in kept):
            kept.append(mode)
    return np.abs(values[:, None] - np.array(kept or [0.0])[None]).argmin(1)


def seed_merged(means: Iterable[float], most: float) -> list[int]:
    """Group number of each cluster: in order, a free cluster takes all free ones closer than most to its own mean."""
    means, group, n = list(means), [], 0
    group = [-1] * len(means)
    for i, m in enumerate(means):
        if group[i] < 0:
            for j in range(i, len(means)):
                if j == i or group[j] < 0 and abs(means[j] - m) < most:
                    group[j] = n
            n += 1
    return group


def mode_height(z: np.ndarray) -> float | None:
    """Mid of the fullest bin of the lower half: about one metre wide, two bins at least, the last one closed."""
    if not len(z):
        return None
    low, high = float(z.min()), float(z.min() + z.max()) / 2
    part = z[(z >= low) & (z <= high)]
    top = float(part.max())
    n = max(2, math.floor(top - low + 0.5))
    counts, borders = np.histogram(part, bins=n, range=(low, top if top > low else low + 1))
    k = int(counts.argmax())
    return float(borders[k] + borders[k + 1]) / 2


def mask_components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected parts of a mask, in scan order; 0 is outside."""
    labels, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if labels[start]:
            continue
        n += 1
        todo = [start]
        labels[start] = n
        while todo:
            r, c = todo.pop()
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not labels[q]:
                    labels[q] = n
                    todo.append(q)
    return labels


def planar_faces(points: list[tuple[float, float]], edges: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Faces of a plane graph: from each directed edge, on to the next edge clockwise; the outer one runs clockwise."""
    near: dict[int, list[int]] = {}
    for a, b in {(a, b) for x, y in edges if x != y for a, b in ((x, y), (y, x))}:
        near.setdefault(a, []).append(b)
    for a, others in near.items():
        others.sort(key=lambda b, a=a: math.atan2(points[b][1] - points[a][1], points[b][0] - points[a][0]))
    free = {(a, b) for a, others in near.items() for b in others}
    out = []
    for start in sorted(free):
        if start not in free:
            continue
        face, edge = [], start
        while edge in free:
            free.discard(edge)
            face.append(edge[0])
            a, b = edge
            edge = b, near[b][near[b].index(a) - 1]
        out.append(face)
    return out


def edge_rings(edges: Iterable[tuple]) -> list[list]:
    """Closed loops of directed edges, each edge used once; a loop starts at its first edge."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    out = []
    for a in list(after):
        while after.get(a):
            ring, at = [a], after[a].pop(0)
            while at != a and after.get(at):
                ring.append(at)
                at = after[at].pop(0)
            if at == a:
                out.append(ring)
    return out


def without_straight_nodes(points: dict[int, tuple[float, float]], edges: set[tuple[int, int]], degrees: float) -> set[tuple[int, int]]:
    """Edges after nodes of degree 2 that turn by less than degrees are taken out, smallest node first."""
    edges = {tuple(sorted(e)) for e in edges}
    for node in sorted(points):
        own = [e for e in edges if node in e]
        if len(own) != 2:
            continue
        a, b = (e[0] if e[1] == node else e[1] for e in own)
        u, v = (np.subtract(points[node], points[a]), np.subtract(points[b], points[node]))
        bend = abs(math.degrees(math.atan2(u[0] * v[1] - u[1] * v[0], float(np.dot(u, v)))))
        if a != b and bend < degrees:
            edges -= set(own)
            edges.add(tuple(sorted((a, b))))
    return edges


def local_labels(data: np.ndarray, smooth: float, rounds: int = 5) -> np.ndarray:
    """Labels of a grid that lower sum(data) + smooth * (unequal neighbours), by iterated conditional modes.

    data: rows x columns x labels. Starts from the cheapest label of each cell; ties go to the smaller label.
    """
    labels = data.argmin(2)
    for _ in range(rounds):
        before = labels.copy()
        for parity in (0, 1):  # a chessboard: cells of one colour do not touch
            unequal = np.zeros_like(data)
            for axis, shift in ((0, 1), (0, -1), (1, 1), (1, -1)):
                other = np.roll(labels, shift, axis)
                edge = np.ones(labels.shape, bool)
                index = [slice(None)] * 2
                index[axis] = 0 if shift == 1 else -1
                edge[tuple(index)] = False
                unequal += (other[..., None] != np.arange(data.shape[2])) & edge[..., None]
            best = (data + smooth * unequal).argmin(2)
            r, c = np.indices(labels.shape)
            labels = np.where((r + c) % 2 == parity, best, labels)
        if (labels == before).all():
            break
    return labels


def grid_energy(data: np.ndarray, labels: np.ndarray, smooth: float) -> float:
    own = np.take_along_axis(data, labels[..., None], 2).sum()
    return float(own + smooth * ((labels[1:] != labels[:-1]).sum() + (labels[:, 1:] != labels[:, :-1]).sum()))


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 projective map of four points onto four points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def shelf_packed(sizes: list[tuple[int, int]], width: int) -> tuple[list[tuple[int, int]], int, int]:
    """Places of rectangles on shelves of a page, tallest first, and the page's size: powers of two."""
    places: list = [None] * len(sizes)
    x = y = shelf = used = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][1], -sizes[i][0], i)):
        w, h = sizes[i]
        if x and x + w > width:
            x, y, shelf = 0, y + shelf, 0
        places[i] = x, y
        x, shelf = x + w, max(shelf, h)
        used = max(used, x)
    power = lambda n: 1 << max(0, (n - 1).bit_length())
    return places, power(used), power(y + shelf)


def bottom_left_packed(rects: list[tuple[str, int, int]], most: int) -> list[tuple[int, int, int] | None]:
    """(page, x, y) of rectangles (building, w, h) on pages of at most most by most; a building stays on one page.

    Corners that placed rectangles leave are tried lowest first, then leftmost. A building that fits no open page
    starts a new one; a rectangle that no page can hold, or that fills one exactly, is None (it keeps its own image).
    """
    groups: dict[str, list[int]] = {}
    for i, (building, w, h) in enumerate(rects):
        if w <= most and h <= most and (w, h) != (most, most):
            groups.setdefault(building, []).append(i)
    order = lambda members: sorted(members, key=lambda i: (-rects[i][2], -rects[i][1], i))
    whole = all(rects[i][1] > 0 and rects[i][2] > 0 for members in groups.values() for i in members)
    placed, empty = (_on_rows, lambda: ([0] * most, [(0, 0)], most * most)) if whole else (_among, lambda: ([], [(0, 0)], math.inf))
    out: list = [None] * len(rects)
    pages: list[tuple] = []
    for members in groups.values():
        members = order(members)
        sizes = [(int(w), int(h)) for _, w, h in (rects[i] for i in members)]
        need = sum(w * h for w, h in sizes)
        for k in range(len(pages) + 1):
            page = pages[k] if k < len(pages) else empty()
            if (need <= page[2] or not whole) and (found := placed(page, sizes, most)):
                pages[k : k + 1] = [(*found[:2], page[2] - need)]
                for i, (x, y) in zip(members, found[2], strict=True):
                    out[i] = k, x, y
                break
    return out


def _on_rows(page: tuple, sizes: list[tuple[int, int]], most: int) -> tuple[list[int], list, list] | None:
    """Places of rectangles (tallest first, then widest) on a page: (rows, corners, places), or None if one finds no place.

    rows are bits of what is taken, corners (y, x) sorted. A corner that is taken holds nothing any more; one that a
    rectangle did not fit into does not hold an equal one later.
    """
    rows, corners, places = list(page[0]), list(page[1]), []
    last, start = None, 0
    for w, h in sizes:
        start, last = (start if last == (w, h) else 0), (w, h)
        bits = (1 << w) - 1
        for k in range(start, len(corners)):
            y, x = corners[k]
            if x + w <= most and y + h <= most:
                mask = bits << x
                for row in rows[y : y + h]:
                    if row & mask:
                        break
                else:
                    break
        else:
            return None
        places.append((x, y))
        for i in range(y, y + h):
            rows[i] |= mask
        for corner in ((y, x + w), (y + h, x)):
            at = bisect.bisect_left(corners, corner)
            if corner[0] < most and corner[1] < most and not rows[corner[0]] >> corner[1] & 1 and corners[at : at + 1] != [corner]:
                corners.insert(at, corner)
        # only corners in the rectangle's own rows can have been taken
        low, high = bisect.bisect_left(corners, (y, x)), bisect.bisect_left(corners, (y + h, -1))
        corners[low:high] = [c for c in corners[low:high] if not rows[c[0]] >> c[1] & 1]
        start = low
    return rows, corners, places


def _among(page: tuple, sizes: list[tuple[int, int]], most: int) -> tuple[list, list, list] | None:
    """As _on_rows(), for rectangles of which some have no area; rows are the rectangles placed."""
    taken, corners, places = list(page[0]), list(page[1]), []
    for w, h in sizes:
        for y, x in sorted(corners):
            if x + w <= most and y + h <= most and not any(x < a + c and a < x + w and y < b + d and b < y + h for a, b, c, d in taken):
                break
        else:
            return None
        places.append((x, y))
        taken.append((x, y, w, h))
        corners += [(y, x + w), (y + h, x)]
    return taken, corners, places


def page_size(width: int, height: int, need_width: int, need_height: int) -> tuple[int, int]:
    """A page grown by doubling its shorter side (equal sides: the width) until it holds what is needed."""
    while width < need_width or height < need_height:
        if width <= height:
            width *= 2
        else:
            height *= 2
    return width, height


def local_2d(ring: np.ndarray) -> np.ndarray:
    """A face in its own plane: the first corner is the origin, the x axis points to the corner farthest from it."""
    p = np.asarray(ring, float)
    step = np.roll(p, -1, 0) - p
    normal = np.cross(np.roll(step, -1, 0), step).sum(0)
    gap = p - p[0]
    x = gap[int(np.linalg.norm(gap, axis=1).argmax())]
    if np.linalg.norm(normal) < 1e-12 or np.linalg.norm(x) < 1e-12:
        return p[:, :2]
    x, z = x / np.linalg.norm(x), normal / np.linalg.norm(normal)
    y = np.cross(z, x)
    y /= np.linalg.norm(y)
    return np.column_stack([gap @ np.cross(y, z), gap @ y])


def turned_to_xz(ring: np.ndarray) -> np.ndarray:
    """A face turned so that its right-hand normal points along y: first about the z axis, then about the x axis."""
    p = np.asarray(ring, float)
    step = np.roll(p, -1, 0) - p
    n = np.cross(step, np.roll(step, -1, 0)).sum(0)
    n = n / np.linalg.norm(n)
    flat = math.hypot(n[0], n[1])
    c, s = (n[1] / flat, n[0] / flat) if flat > 0 else (1.0, 0.0)
    about_z = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    n = about_z @ n
    about_x = np.array([[1, 0, 0], [0, n[1], n[2]], [0, -n[2], n[1]]])
    return p @ (about_x @ about_z).T


def clipped(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex ring inside another convex one, both counter-clockwise."""
    out = [tuple(v) for v in subject]
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        side = lambda v: (b[0] - a[0]) * (v[1] - a[1]) - (b[1] - a[1]) * (v[0] - a[0])  # noqa: B023, E731
        row, out = out, []
        for p, q in zip(row, row[1:] + row[:1], strict=True):
            u, v = side(p), side(q)
            if u >= 0:
                out.append(p)
            if u * v < 0:
                t = u / (u - v)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return np.array(out, float).reshape(-1, 2)


def signed_area(ring: np.ndarray) -> float:
    x, y = np.asarray(ring, float).reshape(-1, 2).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def overlap_area(p: np.ndarray, q: np.ndarray) -> float:
    """Common area of two simple rings: their triangles are clipped against each other."""
    total = 0.0
    others = [np.asarray(q, float)[list(t)] for t in ear_clipped([tuple(v) for v in q])]
    others = [o if signed_area(o) > 0 else o[::-1] for o in others]
    for t in ear_clipped([tuple(v) for v in p]):
        own = np.asarray(p, float)[list(t)]
        own = own if signed_area(own) > 0 else own[::-1]
        for o in others:
            if (own.min(0) < o.max(0)).all() and (o.min(0) < own.max(0)).all():
                found = clipped(own, o)
                total += signed_area(found) if len(found) > 2 else 0.0
    return total


def segment_gaps(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distance of each point from a ring's line."""
    a, b = np.asarray(ring, float), np.roll(np.asarray(ring, float), -1, 0)
    u = b - a
    t = ((points[:, None] - a) * u).sum(2) / np.maximum((u * u).sum(1), 1e-300)
    foot = a + np.clip(t, 0, 1)[..., None] * u
    return np.linalg.norm(points[:, None] - foot, axis=2).min(1)


def ring_gap(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two rings' lines that do not cross."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    return float(min(segment_gaps(p, q).min(), segment_gaps(q, p).min()))


def with_missing_vertices(ring: list[tuple], candidates: Iterable[tuple], most: float = 0.001) -> list[tuple]:
    """ring with each candidate put into the edge that it lies on: the nearest edge closer than most, not at its ends.

    Candidates come one after the other, and later ones see the corners that earlier ones have become.
    """
    out = [tuple(map(float, v)) for v in ring]
    if len(out) < 3:
        return out
    for c in candidates:
        p = np.array(out)
        u = np.roll(p, -1, 0) - p
        size = (u * u).sum(1)
        t = ((np.asarray(c, float) - p) * u).sum(1) / np.where(size > 0, size, 1)
        gap = np.linalg.norm(np.asarray(c, float) - p - t[:, None] * u, axis=1)
        gap[(size == 0) | (t <= 0) | (t >= 1) | (gap >= most)] = np.inf
        k = int(gap.argmin())
        if np.isfinite(gap[k]):
            out.insert(k + 1, tuple(map(float, c)))
    return out


def mean_shift_nd(values: np.ndarray, weights: np.ndarray, band: float) -> np.ndarray:
    """Label of each of some distinct points with weights: flat-kernel mean shift, seeded by bins of the bandwidth.

    Modes closer than the band are one, the heavier stays; labels follow the modes' weight, heaviest first.
    """
    modes = []
    for seed in np.unique(np.round(values / band), axis=0) * band:
        at = seed
        for _ in range(300):
            near = np.linalg.norm(values - at, axis=1) <= band
            if not near.any():
                break
            mean = np.average(values[near], axis=0, weights=weights[near])
            if np.linalg.norm(mean - at) < 1e-3 * band:
                modes.append((float(weights[near].sum()), tuple(mean)))
                break
            at = mean
    kept: list[np.ndarray] = []
    for _, mode in sorted(set(modes), key=lambda m: (-m[0], m[1])):
        if all(np.linalg.norm(np.array(mode) - k) >= band for k in kept):
            kept.append(np.array(mode))
    if not kept:
        return np.zeros(len(values), int)
    return np.linalg.norm(values[:, None] - np.array(kept)[None], axis=2).argmin(1)


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (indexes) of distinct points in the plane whose circles hold no other point, one point at a time."""
    p = np.asarray(points, float)
    if len(p) < 3:
        return []
    low, high = p.min(0), p.max(0)
    span = max(float((high - low).max()), 1e-9)
    middle = (low + high) / 2
    far = np.array([middle + span * np.array(v) for v in ((-1e4, -1e4), (1e4, -1e4), (0, 1e4))])
    q = np.vstack([p, far])
    n = len(p)
    tri = np.array([[n, n + 1, n + 2]])
    circles = np.array([_circle(*q[tri[0]])])
    for i in np.lexsort((p[:, 1], p[:, 0])):
        bad = ((q[i] - circles[:, :2]) ** 2).sum(1) < circles[:, 2] * (1 - 1e-12)
        border: dict[tuple[int, int], int] = {}
        for a, b, c in tri[bad].tolist():
            for e in ((a, b), (b, c), (c, a)):
                if border.pop((e[1], e[0]), None) is None:
                    border[e] = 1
        new = np.array([(a, b, int(i)) for a, b in border])
        keep = ~bad
        tri = np.vstack([tri[keep], new])
        circles = np.vstack([circles[keep], [_circle(*q[t]) for t in new]])
    return [tuple(t) for t in tri.tolist() if max(t) < n]


def _circle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[float, float, float]:
    """Centre and squared radius of the circle through three points; without bounds where they are in line."""
    u, v = b - a, c - a
    d = 2 * (u[0] * v[1] - u[1] * v[0])
    if abs(d) < 1e-300:
        return float(a[0]), float(a[1]), math.inf
    x = (v[1] * (u @ u) - u[1] * (v @ v)) / d
    y = (u[0] * (v @ v) - v[0] * (u @ u)) / d
    return float(a[0] + x), float(a[1] + y), float(x * x + y * y)


def alpha_shape(points: np.ndarray, alpha: float) -> list[list[tuple[float, float]]]:
    """Outer rings, counter-clockwise, of the triangles whose circle has a radius under 1 / alpha; none for few points."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    kept = [t for t in delaunay(p) if _circle(*p[list(t)])[2] < 1 / alpha**2]
    turned = [t if signed_area(p[list(t)]) > 0 else t[::-1] for t in kept]
    left = cancelled((a, b) for t in turned for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))
    rings = [[tuple(p[i].tolist()) for i in ring] for ring in edge_rings(sorted(left))]
    return [r for r in rings if signed_area(np.array(r)) > 0]


def rectangles(mask: np.ndarray, least: int, deepest: int = 10) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1; ends excluded) that make up a mask: each 4-connected part's bounding box, less the boxes
    of what the part leaves of it, and so on; parts of fewer than least pixels are passed over.

    A box at an even depth adds, one at an odd depth takes away; the list is in breadth-first order.
    """
    out, todo = [], [(mask.astype(bool), 0, 0, 0)]
    while todo:
        area, x, y, depth = todo.pop(0)
        labels = mask_components(area)
        for k in range(1, labels.max(initial=0) + 1):
            rows, cols = np.nonzero(labels == k)
            if len(rows) < least:
                continue
            y0, y1, x0, x1 = rows.min(), rows.max() + 1, cols.min(), cols.max() + 1
            out.append((int(x + x0), int(y + y0), int(x + x1), int(y + y1)))
            if depth + 1 < deepest:
                rest = labels[y0:y1, x0:x1] != k
                if rest.any():
                    todo.append((rest, x + int(x0), y + int(y0), depth + 1))
    return out


def outline_pixels(mask: np.ndarray) -> np.ndarray:
    """The pixels of a mask that miss one of their eight neighbours."""
    grown = np.pad(mask.astype(bool), 1)
    full = np.ones(mask.shape, bool)
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            full &= grown[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return mask.astype(bool) & ~full


def bridged(outer: list[tuple], hole: list[tuple]) -> list[tuple]:
    """An outline with a hole as one ring: it runs from the outline's corner to the hole's that is nearest to it, around
    the hole, and back. The hole runs against the outline."""
    a, b = np.asarray(outer, float), np.asarray(hole, float)
    if (signed_area(a[:, :2]) > 0) == (signed_area(b[:, :2]) > 0):
        b = b[::-1]
    gap = ((a[:, None, :2] - b[None, :, :2]) ** 2).sum(2)
    i, j = np.unravel_index(int(gap.argmin()), gap.shape)
    around = np.vstack([b[j:], b[: j + 1]])
    return [tuple(v) for v in np.vstack([a[: i + 1], around, a[i:]]).tolist()]


def coplanar_groups(rings: list[list[tuple]], degrees: float, apart: set[tuple[int, int]] = frozenset()) -> list[int]:
    """Group number of each face: in order, faces that share an edge and whose normals differ by less than degrees join,
    unless a forbidden pair would come together."""
    normals, edges = [], {}
    for k, ring in enumerate(rings):
        p = np.asarray(ring, float)
        step = np.roll(p, -1, 0) - p
        n = np.cross(step, np.roll(step, -1, 0)).sum(0)
        normals.append(n / max(np.linalg.norm(n), 1e-300))
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            edges.setdefault(tuple(sorted((tuple(a), tuple(b)))), []).append(k)
    group = list(range(len(rings)))
    for pair in sorted({tuple(sorted(v)) for v in edges.values() if len(v) == 2 and v[0] != v[1]}):
        i, j = pair
        if group[i] == group[j] or float(normals[i] @ normals[j]) < math.cos(math.radians(degrees)):
            continue
        mine, other = ({k for k, g in enumerate(group) if g == group[x]} for x in pair)
        if any((min(a, b), max(a, b)) in apart for a in mine for b in other):
            continue
        low = min(group[i], group[j])
        for k in mine | other:
            group[k] = low
    return group


def snapped(points: Iterable[tuple], limit: float) -> list[int]:
    """For each point in order the index of the first earlier kept one within limit that is nearest; itself if none is."""
    kept: list[int] = []
    rows = [np.asarray(p, float) for p in points]
    out = []
    for i, p in enumerate(rows):
        gaps = [float(np.linalg.norm(p - rows[k])) for k in kept]
        if gaps and min(gaps) <= limit:
            out.append(kept[int(np.argmin(gaps))])
        else:
            kept.append(i)
            out.append(i)
    return out


def nearest_filled(cols: np.ndarray, rows: np.ndarray, width: int, height: int) -> np.ndarray:
    """Index of the nearest point for each pixel of a raster (height x width), the smallest index of equals."""
    y, x = np.indices((height, width))
    out = np.zeros((height, width), int)
    best = np.full((height, width), np.inf)
    for k, (c, r) in enumerate(zip(cols, rows, strict=True)):
        gap = (x - c) ** 2 + (y - r) ** 2
        less = gap < best
        best[less], out[less] = gap[less], k
    return out


def triangulated_3d(ring: list[tuple]) -> list[tuple[int, int, int]]:
    """The triangulation of a ring in space, simple from above, whose triangles bend least against each other.

    The cost of two triangles with a common diagonal is the angle between their normals; it is summed over all
    diagonals, O(n**4) by intervals with the triangle over the interval's chord.
    """
    p = np.asarray(ring, float)
    n = len(p)
    if n < 3:
        return []
    inner = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i + 2, n):
            inner[i, j] = (i, j) == (0, n - 1) or _diagonal(p[:, :2], i, j)
    side = lambda i, j: j == i + 1 or inner[i, j]

    def normal(i: int, k: int, j: int) -> np.ndarray:
        v = np.cross(p[k] - p[i], p[j] - p[i])
        return v / max(np.linalg.norm(v), 1e-300)

    best: dict[tuple[int, int, int], tuple[float, int, int]] = {}
    for span in range(2, n):
        for i in range(n - span):
            j = i + span
            if not inner[i, j]:
                continue
            for k in range(i + 1, j):
                if not (side(i, k) and side(k, j)):
                    continue
                own, cost, via = normal(i, k, j), 0.0, []
                for a, b in ((i, k), (k, j)):
                    options = [(best[a, m, b][0] + math.acos(max(-1.0, min(1.0, float(own @ normal(a, m, b))))), m) for m in range(a + 1, b) if (a, m, b) in best]
                    if b > a + 1 and not options:
                        cost = math.inf
                        break
                    least = min(options, default=(0.0, -1))
                    cost += least[0]
                    via.append(least[1])
                if math.isfinite(cost):
                    best[i, k, j] = cost, *via
    tops = [(v[0], k) for k, v in best.items() if (k[0], k[2]) == (0, n - 1)]
    out, todo = [], [min(tops)[1]] if tops else []
    while todo:
        i, k, j = todo.pop()
        out.append((i, k, j))
        _, left, right = best[i, k, j]
        todo += [t for t in ((i, left, k), (k, right, j)) if t[1] >= 0]
    return sorted(out)


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): the places start, start + 1, ... of each range of n."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[owner]


def _in_turn(n: np.ndarray, most: int = 2_000_000) -> Iterable[slice]:
    """Slices of ranges of n each, which together hold about most at a time."""
    at = np.cumsum(n)
    k = 0
    while k < len(n):
        end = max(k + 1, int(np.searchsorted(at, (at[k - 1] if k else 0) + most, "right")))
        yield slice(k, end)
        k = end


def joined_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def tiles_clustered(ids: np.ndarray, p: np.ndarray, tiles: np.ndarray, size: float, halo: float, eps: float, least: int) -> tuple[np.ndarray, ...]:
    """(id, label, core, own, shared) of the cores and the own border points of tiles, each clustered alone.

    tiles: each row's tile, equal ones together; a tile's own points and those within halo of it. label: the smallest
    core of the tile's cluster; a border point has a row for each cluster in reach. shared: other tiles have the point.

    Cells have a diagonal of eps: a cell with least points holds cores of one cluster, and none of its pairs is made.
    Points of other cells, fewer than least in each, look into the cells around. Two full cells are compared only where
    nothing else has joined them, and only with the points that the other's box can reach.
    """
    axes = p.shape[1]
    side = eps / math.sqrt(axes)
    reach = math.isqrt(axes) + 1
    number = np.concatenate([[0], np.cumsum((tiles[1:] != tiles[:-1]).any(1))])
    cell = np.floor(p / side).astype(np.int64) - np.floor((tiles * size - halo) / side).astype(np.int64) + reach + 1
    wide = int(cell.max()) + reach + 2
    key = number
    for k in range(axes):
        key = key * wide + cell[:, k]
    order = np.argsort(key, kind="stable")
    ids, p, tiles, key = ids[order], p[order], tiles[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    cells, n = key[first], np.diff(np.concatenate([first, [len(key)]]))
    bounds = np.concatenate([first, [len(key)]])
    dense = n >= least
    of = np.repeat(np.arange(len(cells)), n)

    def gap(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = p[i] - p[j]
        total = d[:, 0] * d[:, 0]
        for k in range(1, axes):
            total = total + d[:, k] * d[:, k]
        return np.sqrt(total)

    steps = [0]
    for k in range(axes - 1):
        steps = [(s + d) * wide for s in steps for d in range(-reach, reach + 1)]
    # cells that follow each other along the last axis are one range
    sparse = np.flatnonzero(~dense[of])
    near, met = np.zeros(len(p), np.int64), []
    for step in steps:
        low = bounds[np.searchsorted(cells, key[sparse] + step - reach)]
        some = bounds[np.searchsorted(cells, key[sparse] + step + reach, "right")] - low
        full = np.flatnonzero(some)
        for part in _in_turn(some[full]):
            rows = full[part]
            owner, j = _spread(low[rows], some[rows])
            i = sparse[rows][owner]
            hit = gap(i, j) <= eps
            near += np.bincount(i[hit], minlength=len(p)) if hit.any() else 0
            met.append((i[hit], j[hit]))
    i, j = (np.concatenate([m[k] for m in met] or [np.empty(0, np.int64)]) for k in (0, 1))
    core = dense[of] | (near >= least)

    # a full cell is one node, its first point
    node = np.where(dense[of], first[of], np.arange(len(p)))
    both = core[i] & core[j]
    links = [(node[i[both]], node[j[both]])]
    full = np.flatnonzero(dense)
    if len(full):
        low = np.minimum.reduceat(p, first)
        high = np.maximum.reduceat(p, first)
        ahead = []
        for step in steps:
            for d in range(-reach, reach + 1):
                if step + d > 0:
                    at = np.searchsorted(cells, cells[full] + step + d)
                    there = (at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == cells[full] + step + d)
                    a, b = full[there], at[there]
                    ahead.append(np.stack([a, b])[:, dense[b]])
        a, b = np.concatenate(ahead, 1)
        apart = np.maximum(0.0, np.maximum(low[a] - high[b], low[b] - high[a]))
        could = np.sqrt((apart * apart).sum(1)) <= eps * (1 + 1e-9)
        a, b = a[could], b[could]
        sure = gap(first[a], first[b]) <= eps
        links.append((first[a[sure]], first[b[sure]]))
        label = joined_labels(len(p), *(np.concatenate([x[k] for x in links]) for k in (0, 1)))
        open_ = label[first[a]] != label[first[b]]
        for x, y in zip(a[open_], b[open_], strict=True):
            if label[first[x]] == label[first[y]]:
                continue
            rows = [np.arange(bounds[v], bounds[v + 1]) for v in (x, y)]
            for k, other in ((0, y), (1, x)):
                away = np.maximum(0.0, np.maximum(low[other] - p[rows[k]], p[rows[k]] - high[other]))
                rows[k] = rows[k][np.sqrt((away * away).sum(1)) <= eps * (1 + 1e-9)]
            step = max(1, 1_000_000 // max(1, len(rows[1])))
            if any((gap(np.repeat(u, len(rows[1])), np.tile(rows[1], len(u))) <= eps).any() for u in (rows[0][k : k + step] for k in range(0, len(rows[0]), step))):
                links.append((first[[x]], first[[y]]))
                one, two = sorted((label[first[x]], label[first[y]]))
                label[label == two] = one
    label = joined_labels(len(p), *(np.concatenate([x[k] for x in links]) for k in (0, 1)))[node]
    cores = np.flatnonzero(core)
    named = np.full(len(p), np.iinfo(np.int64).max)
    np.minimum.at(named, label[cores], ids[cores])

    own = (np.floor(p / size) == tiles).all(1)
    shared = ~own | (np.floor((p - halo) / size) != np.floor((p + halo) / size)).any(1)
    edge = own[i] & ~core[i] & core[j]
    border, at = (np.unique(np.stack([i[edge], label[j[edge]]]), axis=1)) if edge.any() else np.empty((2, 0), np.int64)
    rows = np.concatenate([cores, border])
    return ids[rows], named[np.concatenate([label[cores], at])], core[rows], own[rows], shared[rows]


def triangulated_3d_all(rings: np.ndarray) -> np.ndarray:
    """triangulated_3d() of rings of equally many corners (m x n x 3) at once: (ring, i, k, j) of each triangle, ring by ring."""
    m, n = rings.shape[:2]
    if n < 3 or not m:
        return np.empty((0, 4), int)
    flat = rings[..., :2]
    turn = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    side = {(i, i + 1): np.ones(m, bool) for i in range(n - 1)}
    for i in range(n):
        for j in range(i + 2, n):
            if (i, j) == (0, n - 1):
                side[i, j] = np.ones(m, bool)
                continue
            a, b = flat[:, i], flat[:, j]
            good, q, odd = np.ones(m, bool), (a + b) / 2, np.zeros(m, bool)
            for k in range(n):
                c, d = flat[:, k], flat[:, (k + 1) % n]
                if not {k, (k + 1) % n} & {i, j}:
                    good &= ~((turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0))
                over = (c[:, 1] > q[:, 1]) != (d[:, 1] > q[:, 1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    at = (d[:, 0] - c[:, 0]) * (q[:, 1] - c[:, 1]) / (d[:, 1] - c[:, 1]) + c[:, 0]
                odd ^= over & (q[:, 0] < at)
            side[i, j] = good & odd

    normals: dict[tuple[int, int, int], np.ndarray] = {}

    def normal(i: int, k: int, j: int) -> np.ndarray:
        if (i, k, j) not in normals:
            v = np.cross(rings[:, k] - rings[:, i], rings[:, j] - rings[:, i])
            normals[i, k, j] = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        return normals[i, k, j]

    # the cost of what lies beyond (i, k, j) and the corners chosen there; infinite where it is no triangle
    cost: dict[tuple[int, int, int], np.ndarray] = {}
    via: dict[tuple[int, int, int], list] = {}
    for span in range(2, n):
        for i in range(n - span):
            j = i + span
            for k in range(i + 1, j):
                total, chosen = np.where(side[i, j] & side[i, k] & side[k, j], 0.0, np.inf), []
                for a, b in ((i, k), (k, j)):
                    if b == a + 1:
                        chosen.append(None)
                        continue
                    own = normal(i, k, j)
                    bends = [cost[a, c, b] + np.arccos(np.clip((own * normal(a, c, b)).sum(1), -1.0, 1.0)) for c in range(a + 1, b)]
                    least = np.argmin(bends, 0)
                    total = total + np.take_along_axis(np.array(bends), least[None], 0)[0]
                    chosen.append(least + a + 1)
                cost[i, k, j], via[i, k, j] = total, chosen
    tops = np.array([cost[0, k, n - 1] for k in range(1, n - 1)])
    rows = np.flatnonzero(np.isfinite(tops.min(0)))
    todo, out = [(rows, np.zeros_like(rows), tops.argmin(0)[rows] + 1, np.full_like(rows, n - 1))], []
    while todo:
        rows, i, k, j = todo.pop()
        out.append(np.stack([rows, i, k, j], 1))
        for key in {*zip(i.tolist(), k.tolist(), j.tolist(), strict=True)}:
            own = rows[(i == key[0]) & (k == key[1]) & (j == key[2])]
            for (a, b), chosen in zip(((key[0], key[1]), (key[1], key[2])), via[key], strict=True):
                if chosen is not None:
                    todo.append((own, np.full_like(own, a), chosen[own], np.full_like(own, b)))
    out = np.concatenate(out)
    return out[np.lexsort(out.T[::-1])]
