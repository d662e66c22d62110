"""Polygons as regions of the plane, in numpy: relations, distances and overlay of any simple rings.

A polygon is a list of rings, each an n x 2 array without a closing point; a place is inside if it lies in an odd number
of rings, so holes are rings like others. Coordinates are snapped to a grid of ``SNAP`` times the size of the inputs.
"""

from __future__ import annotations

import numpy as np

SNAP = 1e-12
NEAR = 8.0  # places of the grid that are no further apart than this are one, so that inputs rounded otherwise meet
Rings = list[np.ndarray]


def rings_of(parts) -> Rings:
    """From rows of Spark: rings of structs (or dicts) with x and y; rings of fewer than three points are left out."""
    out = [np.array([[p["x"], p["y"]] for p in ring], float).reshape(-1, 2) for ring in (parts if parts is not None else [])]
    return [r for r in out if len(r) > 2]


def parts_of(rings: Rings) -> list[list[dict]]:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def inside(rings: Rings, at: np.ndarray) -> np.ndarray:
    """Whether points are in an odd number of rings (points on a boundary either way)."""
    out = np.zeros(len(at), bool)
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        up = (a[:, 1] > at[:, 1:2]) != (b[:, 1] > at[:, 1:2])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (b[:, 0] - a[:, 0]) * (at[:, 1:2] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        out ^= (up & (at[:, 0:1] < x)).sum(1) % 2 == 1
    return out


def oriented(rings: Rings) -> Rings:
    """Outer rings counter-clockwise and holes clockwise, so that the inside is on the left of every side."""
    out = []
    for k, r in enumerate(rings):
        mids = (r + np.roll(r, -1, axis=0)) / 2  # rings don't cross, so most of them are on one side of another ring
        depth = sum(inside([o], mids).mean() > 0.5 for j, o in enumerate(rings) if j != k)
        out.append(r if (area(r) > 0) == (depth % 2 == 0) else r[::-1])
    return out


def _within(ring: np.ndarray) -> np.ndarray:
    """A point inside a ring."""
    a, b = ring, np.roll(ring, -1, axis=0)
    normal = np.stack([a[:, 1] - b[:, 1], b[:, 0] - a[:, 0]], 1) * (1e-6 if area(ring) > 0 else -1e-6)
    at = (a + b) / 2 + normal
    return at[inside([ring], at)][:1] if inside([ring], at).any() else ring.mean(0, keepdims=True)


def _sides(rings: Rings) -> np.ndarray:
    return np.concatenate([np.stack([r, np.roll(r, -1, axis=0)], 1) for r in rings]) if rings else np.zeros((0, 2, 2))


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def _point_gaps(at: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Distance of each point (row) from each side (column)."""
    a, d = sides[:, 0], sides[:, 1] - sides[:, 0]
    t = ((at[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300)
    return np.linalg.norm(at[:, None] - a - np.clip(t, 0, 1)[..., None] * d, axis=2)


def _properly_cross(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    turn = lambda p, q, r: np.sign(_cross(q - p, r - p))
    a, b, c, d = s[:, None, 0], s[:, None, 1], t[None, :, 0], t[None, :, 1]
    return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)


def distance(a: Rings, b: Rings) -> float:
    """Least distance of two regions; 0 if they have a point in common."""
    if not a or not b:
        return float("inf")
    if inside(b, a[0][:1])[0] or inside(a, b[0][:1])[0]:
        return 0.0
    s, t = _sides(a), _sides(b)
    if _properly_cross(s, t).any():
        return 0.0
    return float(min(_point_gaps(s[:, 0], t).min(), _point_gaps(t[:, 0], s).min()))


def _split(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of sides between places of a grid of whole numbers, cut where they meet, along common stretches too. A
    crossing is worked out once, and cuts both sides at the same place."""
    cuts: tuple[list[list], list[list]] = ([[] for _ in s], [[] for _ in t])
    for i, (p, q) in enumerate(s):
        d, a, e = q - p, t[:, 0], t[:, 1] - t[:, 0]
        den = _cross(d[None], e)
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = _cross(a - p, e) / den, _cross(a - p, d[None]) / den
        for j in np.flatnonzero((den != 0) & (u > 0) & (u < 1) & (v > 0) & (v < 1)).tolist():
            at = np.round(p + u[j] * d)
            cuts[0][i].append(at)
            cuts[1][j].append(at)
    for mine, others, own in ((s, t, cuts[0]), (t, s, cuts[1])):
        ends = np.unique(others.reshape(-1, 2), axis=0)
        for i, (p, q) in enumerate(mine):
            d = q - p
            n = max(float(d @ d), 1e-300)
            along = (ends - p) @ d / n
            own[i] += list(ends[(np.abs(_cross(d[None], ends - p)) <= NEAR * np.sqrt(n)) & (along > 0) & (along < 1)])
    out = []
    for sides, own in ((s, cuts[0]), (t, cuts[1])):
        rows = []
        for (p, q), more in zip(sides, own, strict=True):
            at = np.unique(np.array([p, q, *more]).astype(np.int64), axis=0)
            at = at[np.argsort((at - p) @ (q - p), kind="stable")]
            rows.append(np.stack([at[:-1], at[1:]], 1))
        out.append(np.concatenate(rows) if rows else np.zeros((0, 2, 2), np.int64))
    return out[0], out[1]


def _joined(sides: np.ndarray, held: dict) -> np.ndarray:
    """Sides whose ends are moved to the first place met within ``NEAR``; those that vanish are left out."""
    out = sides.copy()
    for row in out.reshape(-1, 2):
        cx, cy = row[0] // NEAR, row[1] // NEAR
        near = [o for i in (-1, 0, 1) for j in (-1, 0, 1) if (o := held.get((cx + i, cy + j))) and max(abs(o[0] - row[0]), abs(o[1] - row[1])) <= NEAR]
        if near:
            row[:] = near[0]
        else:
            held[cx, cy] = (row[0], row[1])
    return out[(out[:, 0] != out[:, 1]).any(1)]


def _pieces(a: Rings, b: Rings) -> tuple[float, list[tuple], list[tuple]]:
    """The unit, and the pieces of the boundaries of both as (from, to, place): place is in, out, same or back (on the
    other's boundary, in its direction or against it)."""
    a, b = oriented(a), oriented(b)
    s, t = _sides(a), _sides(b)
    both = np.concatenate([s, t])
    unit = 2.0 ** np.floor(np.log2(max(float(np.abs(both).max()), 1e-300) * SNAP))  # a power of two keeps short decimals as they are
    held: dict = {}
    s, t = (_joined(np.round(x / unit), held) for x in (s, t))
    cut = _split(s, t)
    known = [{(tuple(p), tuple(q)) for p, q in x.tolist()} for x in cut]
    out = []
    for x, theirs, region in ((cut[0], known[1], b), (cut[1], known[0], a)):
        mine = inside(region, x.mean(1) * unit) if len(x) else np.zeros(0, bool)
        rows = []
        for (p, q), within in zip(x.tolist(), mine, strict=True):
            p, q = tuple(p), tuple(q)
            rows.append((p, q, "same" if (p, q) in theirs else "back" if (q, p) in theirs else "in" if within else "out"))
        out.append(rows)
    return unit, *out


def relations(a: Rings, b: Rings) -> dict[str, bool]:
    """disjoint, intersects, touches, equals, within, contains, overlaps, crosses, covers of two regions."""
    names = ("disjoint", "intersects", "touches", "equals", "within", "contains", "overlaps", "crosses")
    if not a or not b:
        return dict.fromkeys(names, False) | {"disjoint": True}
    unit, x, y = _pieces(a, b)
    ours, theirs = {p[2] for p in x}, {p[2] for p in y}
    ends = {e for p in x for e in p[:2]} & {e for p in y for e in p[:2]}
    equal = ours == theirs == {"same"}
    interiors = equal or "in" in ours or "in" in theirs or "same" in ours
    meet = interiors or bool(ends) or "back" in ours
    within = interiors and "out" not in ours and "in" not in theirs and "back" not in ours
    contains = interiors and "out" not in theirs and "in" not in ours and "back" not in theirs
    return dict(zip(names, (not meet, meet, meet and not interiors, equal, within, contains, interiors and not within and not contains, False), strict=True))


def _stitched(pieces: list[tuple], unit: float) -> Rings:
    """Rings of directed pieces; at a place with several ways on, the sharpest turn to the left is taken."""
    ways: dict = {}
    for p, q in dict.fromkeys(pieces):
        ways.setdefault(p, []).append(q)
    out = []
    while ways:
        start = next(iter(ways))
        ring, here, before = [], start, None
        while True:
            options = ways.get(here)
            if not options:
                break
            if len(options) > 1 and before is not None:
                back = np.arctan2(before[1] - here[1], before[0] - here[0])
                turn = [(back - np.arctan2(q[1] - here[1], q[0] - here[0])) % (2 * np.pi) or 2 * np.pi for q in options]
                nxt = options.pop(int(np.argmin(turn)))
            else:
                nxt = options.pop()
            if not options:
                del ways[here]
            ring.append(here)
            before, here = here, nxt
            if here == start:
                break
        if here == start and len(ring) > 2:
            xy = np.array(ring, float)
            gap = _cross(xy - np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0) - xy)
            span = np.linalg.norm(xy - np.roll(xy, 1, axis=0), axis=1) * np.linalg.norm(np.roll(xy, -1, axis=0) - xy, axis=1)
            xy = xy[np.abs(gap) > 1e-7 * span]  # corners only
            if len(xy) > 2 and abs(area(xy)) > 0:
                out.append(xy * unit)
    return out


def overlay(a: Rings, b: Rings, how: str) -> Rings:
    """intersection, union, difference or symmetric_difference of two regions, as rings with the inside on the left."""
    if not a or not b:
        empty = {"intersection": [], "difference": a}.get(how, a or b)
        return oriented(empty) if empty else []
    if how == "symmetric_difference":
        return overlay(a, b, "difference") + overlay(b, a, "difference")
    keep = {"intersection": ("in", "same", "in", False), "union": ("out", "same", "out", False), "difference": ("out", "back", "in", True)}[how]
    unit, x, y = _pieces(a, b)
    kept = [(p, q) for p, q, place in x if place in keep[:2]]
    kept += [((q, p) if keep[3] else (p, q)) for p, q, place in y if place == keep[2]]
    return _stitched(kept, unit)


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a line whose removal would move it by more than ``tolerance`` (ends stay)."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        gap = _point_gaps(line[a + 1 : b], np.array([[line[a], line[b]]]))[:, 0]
        k = int(gap.argmax())
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def buffered(rings: Rings, distance_: float, quarter: int = 16) -> Rings:
    """The region grown by a distance, with circles of ``4 * quarter`` corners: the union of the region and of a box
    and two circles along each side."""
    if distance_ <= 0 or not rings:
        return rings
    turn = np.arange(4 * quarter) * (np.pi / 2 / quarter)
    circle = distance_ * np.stack([np.cos(turn), np.sin(turn)], 1)
    if len(rings) == 1 and (convex := _convex_buffered(rings[0], distance_, quarter)) is not None:
        return [convex]
    out = oriented(rings)
    for p, q in _sides(oriented(rings)):
        d = q - p
        n = np.linalg.norm(d)
        if n == 0:
            continue
        base = np.arctan2(d[1], d[0])
        first = np.arange(2 * quarter + 1) * (np.pi / 2 / quarter)
        cap = lambda c, a: c + distance_ * np.stack([np.cos(a + first), np.sin(a + first)], 1)  # noqa: E731, B023
        out = overlay(out, [np.concatenate([cap(q, base - np.pi / 2), cap(p, base + np.pi / 2)])], "union")
    return out if out else [p + circle for p in rings[0][:1]]


def _convex_buffered(ring: np.ndarray, distance_: float, quarter: int) -> np.ndarray | None:
    """The same for one convex ring, in closed form; None for another ring.

    At each corner the circles of both sides have corners of their own, counted from either side's normal. Where a chord of one
    crosses a chord of the other is halfway between two neighboring corners."""
    r = ring[(ring != np.roll(ring, 1, axis=0)).any(1)]
    if len(r) < 3:
        return None
    r = r if area(r) > 0 else r[::-1]
    d = np.roll(r, -1, axis=0) - r
    base = np.arctan2(d[:, 1], d[:, 0])
    turns = (base - np.roll(base, 1) + np.pi) % (2 * np.pi) - np.pi  # at the first point of each side
    if (turns < -1e-12).any() or (turns > np.pi * 0.99).any() or abs(turns.sum() - 2 * np.pi) > 1e-6:
        return None
    step, out = np.pi / 2 / quarter, []
    for at, turn, end in zip(r, turns, base - np.pi / 2, strict=True):
        if turn < 1e-9:  # not a corner
            continue
        k = np.arange(int(np.floor(turn / step + 1e-9)) + 1) * step
        angles = np.sort(np.concatenate([k, turn - k]))
        angles = angles[np.concatenate([[True], np.diff(angles) > 1e-9])]
        gaps = np.diff(angles)
        spread = np.cos(step / 2) / np.cos((step - gaps) / 2)
        cross = gaps < step - 1e-9
        every = np.concatenate([angles, ((angles[1:] + angles[:-1]) / 2)[cross]])
        far = np.concatenate([np.ones(len(angles)), spread[cross]])
        order = np.argsort(every, kind="stable")
        a = end - turn + every[order]
        out.append(at + (distance_ * far[order])[:, None] * np.stack([np.cos(a), np.sin(a)], 1))
    return np.concatenate(out)


def is_simple(ring: np.ndarray) -> bool:
    """Whether a ring has three corners, no repeated one, and no two sides that cross or touch but at their common end."""
    n = len(ring)
    if n < 3 or len({tuple(p) for p in ring.tolist()}) < n:
        return False
    s = _sides([ring])
    if _properly_cross(s, s).any():
        return False
    gaps = _point_gaps(s[:, 0], s) <= 1e-12 * max(float(np.abs(ring).max()), 1e-300)
    k = np.arange(n)
    gaps[k, k] = gaps[k, (k - 1) % n] = False
    return not gaps.any()
