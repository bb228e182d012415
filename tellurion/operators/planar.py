"""Kernels on planar coordinates: one arrangement serves overlay, repair, relations and faces.

A geometry here is a list of parts, a part a list of rings, a ring an (n, 2)
array. Segments are noded against each other on a fine grid, each edge is asked
what lies on its two sides, and the edges where the answer changes are walked into
rings. Everything is for one row or one group; tables bring rows together by
cells first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Parts = list
#: Grid step and side offset as shares of the extent.
GRID, SIDE = 2.0**-40, 2.0**-37


def ring_sum(r: np.ndarray) -> float:
    """Signed area; counter-clockwise is positive."""
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def closed(r) -> np.ndarray:
    r = np.asarray(r, float).reshape(-1, 2)
    return r if len(r) and (r[0] == r[-1]).all() else np.concatenate([r, r[:1]])


def rewound(parts: Parts) -> Parts:
    """Shells counter-clockwise, holes clockwise."""
    out = []
    for part in parts:
        rings = [closed(r) for r in part]
        out.append([r if (ring_sum(r) >= 0) == (i == 0) else r[::-1] for i, r in enumerate(rings)])
    return out


def area(parts: Parts) -> float:
    return sum(max(0.0, abs(ring_sum(closed(p[0]))) - sum(abs(ring_sum(closed(h))) for h in p[1:])) for p in parts)


def segments(rings: list[np.ndarray]) -> np.ndarray:
    """(m, 4) rows of ax, ay, bx, by without empty ones."""
    rows = [np.concatenate([r[:-1], r[1:]], axis=1) for r in rings if len(r) > 1]
    s = np.concatenate(rows) if rows else np.zeros((0, 4))
    return s[(s[:, :2] != s[:, 2:]).any(axis=1)]


def winding(points: np.ndarray, segs: np.ndarray) -> np.ndarray:
    """Winding number of the directed segments about each point."""
    out = np.zeros(len(points), int)
    for lo in range(0, len(points), 512):
        x, y = points[lo : lo + 512, 0][:, None], points[lo : lo + 512, 1][:, None]
        up, down = (segs[:, 1] <= y) & (segs[:, 3] > y), (segs[:, 3] <= y) & (segs[:, 1] > y)
        cross = (segs[:, 2] - segs[:, 0]) * (y - segs[:, 1]) - (x - segs[:, 0]) * (segs[:, 3] - segs[:, 1])
        out[lo : lo + 512] = (up & (cross > 0)).sum(1) - (down & (cross < 0)).sum(1)
    return out


def meeting_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of segments whose boxes meet, swept by x."""
    al, ah, bl, bh = np.minimum(a[:, :2], a[:, 2:]), np.maximum(a[:, :2], a[:, 2:]), np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:])
    order = np.argsort(bl[:, 0])
    i_out, j_out = [], []
    end = np.searchsorted(bl[order, 0], ah[:, 0], side="right")
    for i in range(len(a)):
        j = order[: end[i]]
        j = j[(bh[j, 0] >= al[i, 0]) & (bl[j, 1] <= ah[i, 1]) & (bh[j, 1] >= al[i, 1])]
        i_out.append(np.full(len(j), i))
        j_out.append(j)
    return (np.concatenate(i_out), np.concatenate(j_out)) if i_out else (np.zeros(0, int), np.zeros(0, int))


def crossings(a: np.ndarray, b: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and the points where segments meet, touching and ends of collinear overlaps included."""
    i, j = meeting_pairs(a, b)
    p, r, q, s = a[i, :2], a[i, 2:] - a[i, :2], b[j, :2], b[j, 2:] - b[j, :2]
    d = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    w = q - p
    safe = np.where(d == 0, 1.0, d)
    t, u = (w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / safe, (w[:, 0] * r[:, 1] - w[:, 1] * r[:, 0]) / safe
    lr, ls = np.hypot(*r.T), np.hypot(*s.T)
    slack_t, slack_u = tol / lr, tol / ls
    ok = (d != 0) & (np.abs(d) > 1e-14 * lr * ls) & (t >= -slack_t) & (t <= 1 + slack_t) & (u >= -slack_u) & (u <= 1 + slack_u)
    out_i, out_j, out_p = [i[ok]], [j[ok]], [p[ok] + np.clip(t[ok], 0, 1)[:, None] * r[ok]]
    # Ends that lie on the other segment: touching and collinear cases.
    for ends, base, vec, size in ((b[j, :2], p, r, lr), (b[j, 2:], p, r, lr), (a[i, :2], q, s, ls), (a[i, 2:], q, s, ls)):
        rel = ends - base
        along = (rel * vec).sum(1) / size
        off = np.abs(rel[:, 0] * vec[:, 1] - rel[:, 1] * vec[:, 0]) / size
        on = (off <= tol) & (along >= -tol) & (along <= size + tol)
        out_i.append(i[on])
        out_j.append(j[on])
        out_p.append(ends[on])
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_p)


def extent(*sets: np.ndarray) -> float:
    pts = np.concatenate([s.reshape(-1, 2) for s in sets if len(s)]) if any(len(s) for s in sets) else np.zeros((1, 2))
    size = max(np.ptp(pts[:, 0]), np.ptp(pts[:, 1]), np.abs(pts).max() * 1e-6, 1e-300)
    return 2.0 ** math.ceil(math.log2(size))  # a power of two, so that the grid holds round numbers exactly


def noded(segs: np.ndarray, grid: float | None = None) -> np.ndarray:
    """Distinct undirected edges after all segments are split where they meet; ends lie on the grid.

    Snapping moves edges a little, onto nodes that they missed before, so this is
    repeated until nothing is split any more.
    """
    if not len(segs):
        return segs
    grid = grid or extent(segs) * GRID
    for _ in range(6):
        before, segs = len(segs), _noded_once(segs, grid)
        if len(segs) == before:
            break
    return segs


def _noded_once(segs: np.ndarray, grid: float) -> np.ndarray:
    snap = lambda v: np.round(v / grid) * grid
    segs = snap(segs)
    segs = segs[(segs[:, :2] != segs[:, 2:]).any(axis=1)]
    i, j, p = crossings(segs, segs, grid * 2)
    once = i < j  # both segments of a pair get the very same point
    i, j, p = i[once], j[once], snap(p[once])
    every = np.arange(len(segs))
    own, cuts = np.concatenate([every, every, i, j]), np.concatenate([segs[:, :2], segs[:, 2:], p, p])
    d = segs[own, 2:] - segs[own, :2]
    t = ((cuts - segs[own, :2]) * d).sum(1) / (d * d).sum(1)
    order = np.lexsort((t, own))
    own, cuts = own[order], cuts[order]
    same = own[1:] == own[:-1]
    edges = np.concatenate([cuts[:-1][same], cuts[1:][same]], axis=1)
    edges = edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
    flip = (edges[:, 0] > edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3]))
    edges[flip] = edges[flip][:, [2, 3, 0, 1]]
    return np.unique(edges + 0.0, axis=0)


def sides(edges: np.ndarray, off: float) -> tuple[np.ndarray, np.ndarray]:
    """Points just left and right of each edge's middle."""
    mid, d = (edges[:, :2] + edges[:, 2:]) / 2, edges[:, 2:] - edges[:, :2]
    n = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
    return mid + n * off, mid - n * off


def walk(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed edges, each turning to the first edge clockwise from where it came."""
    starts: dict[tuple, list[int]] = {}
    for k, (x, y) in enumerate(edges[:, :2]):
        starts.setdefault((x, y), []).append(k)
    angle = np.arctan2(edges[:, 3] - edges[:, 1], edges[:, 2] - edges[:, 0])
    used, rings = np.zeros(len(edges), bool), []
    for k in range(len(edges)):
        if used[k]:
            continue
        ring, at = [], k
        while not used[at]:
            used[at] = True
            ring.append(edges[at, :2])
            ways = [w for w in starts.get((edges[at, 2], edges[at, 3]), []) if not used[w] or w == k]
            if not ways:
                break
            back = angle[at] + math.pi
            at = min(ways, key=lambda w: ((back - angle[w]) % (2 * math.pi)) or 2 * math.pi)
        if len(ring) > 2 and at == k:
            rings.append(closed(np.array(ring)))
    return rings


def straightened(r: np.ndarray, tol: float) -> np.ndarray:
    """A ring without positions that lie on the line of their neighbours."""
    p = r[:-1]
    while len(p) > 3:
        a, b = np.roll(p, 1, 0), np.roll(p, -1, 0)
        d = b - a
        off = np.abs((p[:, 0] - a[:, 0]) * d[:, 1] - (p[:, 1] - a[:, 1]) * d[:, 0]) / np.maximum(np.hypot(*d.T), 1e-300)
        bad = off <= tol
        # Of neighbours that could go, one at a time.
        bad &= ~np.roll(bad, 1) | (np.arange(len(p)) % 2 == 0)
        if not bad.any() or len(p) - bad.sum() < 3:
            break
        p = p[~bad]
    return closed(p)


def assembled(rings: list[np.ndarray], tol: float) -> Parts:
    """Shells with the holes that lie in them."""
    rings = [straightened(r, tol) for r in rings]
    shells = [[r] for r in rings if ring_sum(r) > tol * tol]
    for h in rings:
        if ring_sum(h) < -tol * tol:
            inside, _ = sides(np.concatenate([h[:1], h[1:2]], axis=1), -tol * 4)
            home = [s for s in shells if winding(inside, segments([s[0]]))[0] or winding(h[:1], segments([s[0]]))[0]]
            if home:
                min(home, key=lambda s: ring_sum(s[0])).append(h)
    return shells


def overlay(groups: list[Parts], rule: Callable[[list[np.ndarray]], np.ndarray], size: float | None = None, straight: float = 4.0) -> Parts:
    """The region where ``rule`` holds of the groups' insides; each group is filled by non-zero winding.

    ``size`` is the extent that the grid follows, the groups' own unless they are part of
    something larger; ``straight`` how many grid steps a position may stand off to be left out.
    """
    own = [segments([r for part in rewound(g) for r in part]) for g in groups]
    every = np.concatenate(own) if own else np.zeros((0, 4))
    if not len(every):
        return []
    size = size or extent(every)
    # Slivers thinner than the grid can leave a ring open; a coarser grid closes them.
    for coarse in (1, 2**4, 2**8, 2**12, 2**14, 2**16, 2**18, 2**20):
        grid = size * GRID * coarse
        edges = noded(every, grid)
        left, right = sides(edges, grid * SIDE / GRID)
        in_left, in_right = (np.asarray(rule([winding(p, s) != 0 for s in own])) for p in (left, right))
        keep = in_left != in_right
        edges, turn = edges[keep], ~in_left[keep]
        edges[turn] = edges[turn][:, [2, 3, 0, 1]]
        if balanced(edges):
            break
    return assembled(walk(edges), grid * straight)


def balanced(edges: np.ndarray) -> bool:
    """Whether as many edges leave each node as reach it."""
    nodes, at = np.unique(np.concatenate([edges[:, :2], edges[:, 2:]]), axis=0, return_inverse=True)
    at = at.ravel()
    n = len(edges)
    return bool((np.bincount(at[:n], minlength=len(nodes)) == np.bincount(at[n:], minlength=len(nodes))).all())


def union(*groups: Parts) -> Parts:
    return overlay([[p for g in groups for p in g]], lambda i: i[0])


def intersection(a: Parts, b: Parts) -> Parts:
    return overlay([a, b], lambda i: i[0] & i[1])


def difference(a: Parts, b: Parts) -> Parts:
    return overlay([a, b], lambda i: i[0] & ~i[1])


def symmetric_difference(a: Parts, b: Parts) -> Parts:
    return overlay([a, b], lambda i: i[0] ^ i[1])


def faces(lines: list[np.ndarray]) -> list[np.ndarray]:
    """The bounded faces of noded lines, counter-clockwise; holes are not assembled."""
    edges = noded(segments(lines))
    # Dangles bound nothing.
    while len(edges):
        ends, count = np.unique(np.concatenate([edges[:, :2], edges[:, 2:]]), axis=0, return_counts=True)
        lone = {tuple(e) for e in ends[count == 1]}
        keep = np.array([tuple(e[:2]) not in lone and tuple(e[2:]) not in lone for e in edges])
        if keep.all():
            break
        edges = edges[keep]
    both = np.concatenate([edges, edges[:, [2, 3, 0, 1]]])
    return [r for r in walk(both) if ring_sum(r) > 0]


# Relations.
def dimension(kind: str) -> int:
    return 0 if "Point" in kind else 1 if "Line" in kind else 2


def _locate(points: np.ndarray, kind: str, parts: Parts, tol: float) -> np.ndarray:
    """0 inside, 1 on the boundary, 2 outside."""
    dim, rings = dimension(kind), [np.asarray(r, float) for p in parts for r in p]
    if dim == 0:
        own = np.concatenate(rings)
        near = np.array([np.hypot(*(own - p).T).min() <= tol for p in points]) if len(points) else np.zeros(0, bool)
        return np.where(near, 0, 2)
    segs = segments([closed(r) for r in rings] if dim == 2 else rings)
    on = distances(points, segs) <= tol
    if dim == 1:
        ends = np.concatenate([r[[0, -1]] for r in rings])
        uniq, count = np.unique(ends, axis=0, return_counts=True)
        ends = uniq[count % 2 == 1]  # the mod-2 rule
        bound = np.array([len(ends) > 0 and np.hypot(*(ends - p).T).min() <= tol for p in points])
        return np.where(bound, 1, np.where(on, 0, 2))
    inside = winding(points, segments([r for p in rewound(parts) for r in p])) != 0
    return np.where(on, 1, np.where(inside, 0, 2))


def distances(points: np.ndarray, segs: np.ndarray) -> np.ndarray:
    """Least distance of each point to the segments."""
    out = np.full(len(points), np.inf)
    d = segs[:, 2:] - segs[:, :2]
    for lo in range(0, len(points), 256):
        p = points[lo : lo + 256, None, :]
        t = np.clip(((p - segs[:, :2]) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        if len(segs):
            out[lo : lo + 256] = np.hypot(*np.moveaxis(p - segs[:, :2] - t[..., None] * d, 2, 0)).min(1)
    return out


def relate(kind_a: str, a: Parts, kind_b: str, b: Parts) -> str:
    """The DE-9IM matrix, from samples of every node, edge and side of the common arrangement."""
    def lines(kind, parts):
        rings = [np.asarray(r, float) for p in parts for r in p]
        return [] if dimension(kind) == 0 else [closed(r) for r in rings] if dimension(kind) == 2 else rings

    pts = np.concatenate([np.asarray(r, float) for g in (a, b) for p in g for r in p])
    size = extent(pts)
    tol = size * GRID * 8
    segs = segments(lines(kind_a, a) + lines(kind_b, b))
    edges = noded(segs, size * GRID) if len(segs) else segs
    nodes = np.unique(np.concatenate([edges[:, :2], edges[:, 2:], pts]), axis=0)
    samples = [(0, nodes)]
    if len(edges):
        left, right = sides(edges, size * SIDE * 8)
        samples += [(1, (edges[:, :2] + edges[:, 2:]) / 2), (2, np.concatenate([left, right]))]
    best = np.full((3, 3), -1)
    for dim, points in samples:
        la, lb = _locate(points, kind_a, a, tol), _locate(points, kind_b, b, tol)
        if dim == 2:  # a side lies on no boundary, and in the inside of areas only
            la = np.where(la == 1, 2, la) if dimension(kind_a) == 2 else np.full(len(la), 2)
            lb = np.where(lb == 1, 2, lb) if dimension(kind_b) == 2 else np.full(len(lb), 2)
        for x in range(3):
            for y in range(3):
                if ((la == x) & (lb == y)).any():
                    best[x, y] = max(best[x, y], dim)
    best[2, 2] = 2
    return "".join("F" if v < 0 else str(v) for v in best.ravel())


# Hulls and triangles.
def convex_hull(p: np.ndarray) -> np.ndarray | None:
    """The hull's closed ring, or nothing for fewer than three positions or a line."""
    p = np.unique(np.asarray(p, float), axis=0)
    if len(p) < 3:
        return None

    def chain(q):
        out: list = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    ring = chain(p) + chain(p[::-1])
    return closed(np.array(ring)) if len(ring) > 2 else None


def clip_half(ring: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The part of a convex ring, not closed, where the linear value isn't positive."""
    out = []
    for k in range(len(ring)):
        a, b, va, vb = ring[k], ring[(k + 1) % len(ring)], value[k], value[(k + 1) % len(ring)]
        if va <= 0:
            out.append(a)
        if (va < 0 < vb) or (vb < 0 < va):
            out.append(a + (b - a) * (va / (va - vb)))
    return np.array(out).reshape(-1, 2)


def tesselate(part: list[np.ndarray]) -> list[np.ndarray]:
    """Triangles of one polygon: each trapezoid between neighbouring heights, cut in two."""
    rings = rewound([part])[0]
    segs = segments(rings)
    ys = np.unique(segs[:, [1, 3]])
    out = []
    for y0, y1 in zip(ys, ys[1:], strict=False):
        across = segs[(np.minimum(segs[:, 1], segs[:, 3]) <= y0) & (np.maximum(segs[:, 1], segs[:, 3]) >= y1)]
        at = lambda y, s=across: s[:, 0] + (s[:, 2] - s[:, 0]) * (y - s[:, 1]) / (s[:, 3] - s[:, 1])
        lo, hi = at(y0), at(y1)
        order = np.argsort(lo + hi, kind="stable")
        for k in range(0, len(order) - 1, 2):
            i, j = order[k], order[k + 1]
            quad = [(lo[i], y0), (lo[j], y0), (hi[j], y1), (hi[i], y1)]
            for t in ((quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])):
                r = closed(np.array(t))
                if abs(ring_sum(r)) > 0:
                    out.append(r)
    return out


# Lines.
def simplify(line: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker, with a stack."""
    keep, stack = np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        seg = np.array([[*line[i], *line[j]]])
        d = distances(line[i + 1 : j], seg)
        k = int(d.argmax())
        if d[k] > tol:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[keep]


def simplify_area(line: np.ndarray, tol: float, least: int = 2) -> np.ndarray:
    """Visvalingam: the position with the least triangle goes first, while under tol squared."""
    p = list(map(tuple, line))
    while len(p) > least:
        q = np.array(p)
        a, b, c = q[:-2], q[1:-1], q[2:]
        t = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
        if not len(t) or t.min() >= tol * tol:
            break
        del p[int(t.argmin()) + 1]
    return np.array(p)


def smooth(ring: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Chaikin's quarter points of a closed ring."""
    for _ in range(rounds):
        a, b = ring[:-1], ring[1:]
        ring = closed(np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], axis=1).reshape(-1, 2))
    return ring


def bezier(line: np.ndarray, sharpness: float = 0.85, steps: int = 16) -> np.ndarray:
    """Cubic pieces whose controls follow Catmull-Rom tangents, scaled by the sharpness."""
    p = np.concatenate([line[:1], line, line[-1:]])
    t = np.linspace(0, 1, steps + 1)[:, None]
    out = [line[:1]]
    for a, b, c, d in zip(p, p[1:], p[2:], p[3:], strict=False):
        c1, c2 = b + (c - a) * (sharpness / 6), c - (d - b) * (sharpness / 6)
        out.append(((1 - t) ** 3 * b + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * c)[1:])
    return np.concatenate(out)


def kinks(parts: Parts) -> np.ndarray:
    """Places where a geometry's segments meet other than as neighbours do."""
    segs = segments([np.asarray(r, float) for p in parts for r in p])
    size = extent(segs)
    i, j, p = crossings(segs, segs, size * GRID)
    ok = i < j
    end = np.array([bool((np.abs(segs[a].reshape(2, 2) - q).max(1) <= size * 1e-12).any() and (np.abs(segs[b].reshape(2, 2) - q).max(1) <= size * 1e-12).any()) for a, b, q in zip(i[ok], j[ok], p[ok], strict=True)], bool)
    found = p[ok][~end] if ok.any() else np.zeros((0, 2))
    return np.unique(np.round(found / (size * 1e-9)) * (size * 1e-9), axis=0)


def line_split(line: np.ndarray, cutters: list[np.ndarray], points: np.ndarray | None = None, near: float | None = None) -> list[np.ndarray]:
    segs, size = segments([line]), extent(line)
    cuts = [np.zeros((0, 2))]
    at = [np.zeros(0, int)]
    if cutters:
        i, _, p = crossings(segs, segments(cutters), size * GRID if near is None else near)
        at.append(i)
        cuts.append(p)
    if points is not None and len(points):
        for q in points:
            d = distances(q[None], segs)
            if d[0] <= 1e-12:
                k = int(np.argmin([distances(q[None], s[None])[0] for s in segs]))
                at.append(np.array([k]))
                cuts.append(q[None])
    at_, cut = np.concatenate(at), np.concatenate(cuts)
    t = np.hypot(*(cut - segs[at_, :2]).T)
    rows = sorted({(int(k), round(float(v), 12), *map(float, q)) for k, v, q in zip(at_, t, cut, strict=True)})
    out, own, k = [], [line[0]], 0
    for s in range(len(segs)):
        while k < len(rows) and rows[k][0] == s:
            q = np.array(rows[k][2:])
            if np.hypot(*(q - own[-1])) > size * 1e-12:
                own.append(q)
            if len(own) > 1:
                out.append(np.array(own))
            own, k = [q], k + 1
        if np.hypot(*(segs[s, 2:] - own[-1])) > size * 1e-12:
            own.append(segs[s, 2:])
    if len(own) > 1:
        out.append(np.array(own))
    return out


def clip_line(line: np.ndarray, box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """Pieces of a line in a box, by Liang-Barsky."""
    x0, y0, x1, y1 = box
    out: list[list] = []
    for a, b in zip(line, line[1:], strict=False):
        d, lo, hi = b - a, 0.0, 1.0
        for p, q in ((-d[0], a[0] - x0), (d[0], x1 - a[0]), (-d[1], a[1] - y0), (d[1], y1 - a[1])):
            if p == 0:
                hi = -1.0 if q < 0 else hi
            elif p < 0:
                lo = max(lo, q / p)
            else:
                hi = min(hi, q / p)
        if lo < hi:
            u, v = a + lo * d, a + hi * d
            if out and (out[-1][-1] == u).all():
                out[-1].append(v)
            else:
                out.append([u, v])
    return [np.array(o) for o in out]
