"""Boundaries of unions and intersections of polygons within one cell.

Coordinates are whole numbers of a unit that is a power of two, so that a point
is the same wherever it is worked out. Edges are split where they meet, and at
the cell's border; then every piece is either the same as another or meets it at
ends only. A piece bounds the result if the result holds on one of its sides.
Which polygons hold at a side follows from those that hold at the cell's corner
and the edges crossed on the way. Only pieces of given edges come out, never the
cell's border, so the pieces of neighbouring cells join without seams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np

#: Cells with more edges are quartered, at most this many times.
MANY, DEEPEST = 400, 10
#: Cells with at most so many edges are worked out together, until their pairs of edges are this many.
FEW, TOGETHER = 64, 200_000


def _canonical(edges: np.ndarray) -> np.ndarray:
    """Edges upwards, level ones to the right."""
    flip = (edges[:, 1] > edges[:, 3]) | ((edges[:, 1] == edges[:, 3]) & (edges[:, 0] > edges[:, 2]))
    return np.where(flip[:, None], edges[:, [2, 3, 0, 1]], edges)


def _touching(edges: np.ndarray, box: Sequence[float]) -> np.ndarray:
    """Which edges may meet a closed box."""
    x0, y0, x1, y1 = box
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    near = (lo[:, 0] <= x1) & (hi[:, 0] >= x0) & (lo[:, 1] <= y1) & (hi[:, 1] >= y0)
    dx, dy = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    sides = [dx * (y - edges[:, 1]) - dy * (x - edges[:, 0]) for x in (x0, x1) for y in (y0, y1)]
    slack = 2 * (np.abs(dx) + np.abs(dy))
    return near & (np.min(sides, 0) <= slack) & (np.max(sides, 0) >= -slack)


def _split(edges: np.ndarray, box: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of canonical edges between all points where they meet, and the edge of each."""
    n = len(edges)
    p, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    points = [edges[:, :2], edges[:, 2:]]
    i, j = np.triu_indices(n, 1)
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    near = ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all(1)
    i, j = i[near], j[near]
    cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    i, j, cross = i[cross != 0], j[cross != 0], cross[cross != 0]
    q = p[j] - p[i]
    t = (q[:, 0] * d[j, 1] - q[:, 1] * d[j, 0]) / cross
    u = (q[:, 0] * d[i, 1] - q[:, 1] * d[i, 0]) / cross
    met = (t > 0) & (t < 1) & (u > 0) & (u < 1)
    points.append(np.rint(p[i[met]] + t[met, None] * d[i[met]]))
    points = np.unique(np.concatenate(points), axis=0)
    # Points on a side of the box are for the edges that cross it, so that no edge next to it is bent.
    x0, y0, x1, y1 = box
    crossing = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for axis, v in ((0, x0), (0, x1), (1, y0), (1, y1)):
            share = (v - p[:, axis]) / d[:, axis]
            some = (share > 0) & (share < 1)
            at = np.rint(p[some] + share[some, None] * d[some])
            at[:, axis] = v
            crossing.append((some, at))
    # Every edge is split at every point that lies on it, or is the rounded place of one.
    length2 = (d**2).sum(1)
    starts, stops, owners = [], [], []
    for k in range(n):
        own = np.concatenate([points, *(at for some, at in crossing if some[k])])
        r = own - p[k]
        along = r @ d[k]
        away = np.abs(r[:, 0] * d[k, 1] - r[:, 1] * d[k, 0])
        on = (along >= 0) & (along <= length2[k]) & (away <= 0.75 * np.sqrt(length2[k]))
        on |= (own == edges[k, :2]).all(1) | (own == edges[k, 2:]).all(1)  # whatever the products round to
        some = own[on][np.argsort(along[on], kind="stable")]
        some = some[np.r_[True, (some[1:] != some[:-1]).any(1)]]
        starts.append(some[:-1])
        stops.append(some[1:])
        owners.append(np.full(len(some) - 1, k))
    return np.hstack([np.concatenate(starts), np.concatenate(stops)]), np.concatenate(owners)


def _crossed(edges: np.ndarray, x: np.ndarray, y: np.ndarray, x0: float, y0: float, own: np.ndarray | None = None) -> np.ndarray:
    """Whether each edge (columns) is crossed an odd number of times on the way from (x0, y0) up and then right to each (x, y).

    ``own`` marks edges that (x, y) lies on: the way ends before them.
    """
    ax, ay, bx, by = (edges[None, :, k] for k in range(4))
    x, y = x[:, None], y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at_y = ay + (x0 - ax) * (by - ay) / (bx - ax)
        up = ((ax > x0) != (bx > x0)) & (at_y > y0) & (at_y <= y)
        at_x = ax + (y - ay) * (bx - ax) / (by - ay)
        right = ((ay > y) != (by > y)) & (at_x > x0) & (at_x <= x)
    return up ^ (right if own is None else right & ~own)


def boundary(
    edges: np.ndarray, owner: np.ndarray, corner: np.ndarray, box: Sequence[float], holds: Callable[[np.ndarray], np.ndarray], depth: int = 0
) -> np.ndarray:
    """Directed pieces, the result on their left, of its boundary in a half-open box.

    ``edges`` are those of all polygons that touch the box, ``owner`` the polygon of each, ``corner`` whether
    each polygon holds at the lower left corner. ``holds`` says for rows of polygons that hold whether the
    result does. A polygon holds where its edges are crossed an odd number of times.
    """
    x0, y0, x1, y1 = box
    if len(edges) == 0:
        return np.empty((0, 4))
    if len(edges) > MANY and depth < DEEPEST and x1 - x0 >= 4 and y1 - y0 >= 4:
        mx, my = np.floor((x0 + x1) / 2), np.floor((y0 + y1) / 2)
        out = []
        for quarter in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)):
            some = _touching(edges, quarter)
            crossed = _crossed(edges, np.array([quarter[0]]), np.array([quarter[1]]), x0, y0)[0]
            inner = corner ^ (np.bincount(owner[crossed], minlength=len(corner)) % 2 == 1)
            out.append(boundary(edges[some], owner[some], inner, quarter, holds, depth + 1))
        return np.concatenate(out)
    edges = _canonical(edges)
    order = np.lexsort(edges.T[::-1])
    edges, owner = edges[order], owner[order]
    pieces, parent = _split(edges, box)
    pieces = _canonical(pieces)
    mx, my = (pieces[:, 0] + pieces[:, 2]) / 2, (pieces[:, 1] + pieces[:, 3]) / 2
    inside = (mx >= x0) & (mx < x1) & (my >= y0) & (my < y1)
    if not inside.any():
        return np.empty((0, 4))
    distinct, which = np.unique(pieces[inside], axis=0, return_inverse=True)
    which = which.reshape(-1)
    own = np.zeros((len(distinct), len(edges)), bool)
    own[which, parent[inside]] = True
    mx, my = (distinct[:, 0] + distinct[:, 2]) / 2, (distinct[:, 1] + distinct[:, 3]) / 2
    belongs = np.zeros((len(edges), len(corner)), np.float32)
    belongs[np.arange(len(edges)), owner] = 1
    odd = lambda crossed: (crossed.astype(np.float32) @ belongs).astype(np.int64) % 2 == 1
    # The way comes from the left, or for level pieces from above: the left side of a canonical piece. But the corner
    # is just within the box, so pieces on its left side are met from the right.
    met = corner[None, :] ^ odd(_crossed(edges, mx, my, x0, y0, own))
    other = met ^ odd(own)
    border = (mx == x0)[:, None]
    left, right = np.where(border, other, met), np.where(border, met, other)
    held_left, held_right = holds(left), holds(right)
    forth, back = distinct[held_left & ~held_right], distinct[held_right & ~held_left]
    return np.concatenate([forth, back[:, [2, 3, 0, 1]]])


def _firsts(sizes: np.ndarray) -> np.ndarray:
    """Where each of several runs begins."""
    return np.cumsum(sizes) - sizes


def _pairs(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the ``n`` things of a group and its ``m`` others, group by group, as places among all things and all others."""
    per = np.repeat(m, n)  # partners of each thing
    left = np.repeat(np.arange(len(per)), per)
    shift = np.repeat(np.repeat(_firsts(m), n) - _firsts(per), per)
    return left, np.arange(len(left)) + shift


def _distinct(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows of each group, in order, and for every row which of them it is."""
    order = np.lexsort((*rows.T[::-1], group))
    some, at = rows[order], group[order]
    new = np.r_[True, (at[1:] != at[:-1]) | (some[1:] != some[:-1]).any(1)][: len(rows)]
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def boundaries(
    edges: np.ndarray, owner: np.ndarray, cell: np.ndarray, corner: np.ndarray, boxes: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`boundary` gives for each of many cells, and the cell of each piece.

    ``cell`` ascends; ``corner`` and ``boxes`` have a row per cell. Cells of few edges are worked out
    together, so that their number and not that of the calls counts.
    """
    sizes = np.bincount(cell, minlength=len(boxes))
    first = _firsts(sizes)
    pieces, at = [np.empty((0, 4))], [np.empty(0, np.int64)]
    few = sizes <= FEW
    for k in np.flatnonzero(~few):
        some = slice(first[k], first[k] + sizes[k])
        pieces.append(boundary(edges[some], owner[some], corner[k], boxes[k], holds))
        at.append(np.full(len(pieces[-1]), k))
    turn = np.cumsum(np.where(few, sizes**2, 0)) // TOGETHER
    stops = np.flatnonzero(np.diff(turn)) + 1 if len(turn) else []
    for a, b in zip([0, *stops], [*stops, len(boxes)]):
        own = np.arange(first[a], first[b - 1] + sizes[b - 1]) if b > a else np.empty(0, np.int64)
        own = own[few[cell[own]]]
        if len(own):
            made, which = _boundaries(edges[own], owner[own], cell[own] - a, corner[a:b], boxes[a:b], holds)
            pieces.append(made)
            at.append(which + a)
    return np.concatenate(pieces), np.concatenate(at)


def _boundaries(edges, owner, cell, corner, boxes, holds):
    """:func:`boundary` and :func:`_split` step by step, over the edges of several cells."""
    edges = _canonical(edges)
    order = np.lexsort((*edges.T[::-1], cell))
    edges, owner, cell = edges[order], owner[order], cell[order]
    n = np.bincount(cell, minlength=len(boxes))
    p, d, box = edges[:, :2], edges[:, 2:] - edges[:, :2], boxes[cell]
    # Where edges of a cell meet.
    i, j = _pairs(n, n)
    some = i < j
    i, j = i[some], j[some]
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    near = ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all(1)
    i, j = i[near], j[near]
    cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    i, j, cross = i[cross != 0], j[cross != 0], cross[cross != 0]
    q = p[j] - p[i]
    t = (q[:, 0] * d[j, 1] - q[:, 1] * d[j, 0]) / cross
    u = (q[:, 0] * d[i, 1] - q[:, 1] * d[i, 0]) / cross
    met = (t > 0) & (t < 1) & (u > 0) & (u < 1)
    points = np.concatenate([edges[:, :2], edges[:, 2:], np.rint(p[i[met]] + t[met, None] * d[i[met]])])
    of = np.concatenate([cell, cell, cell[i[met]]])
    some, _ = _distinct(points, of)
    points, of = points[some], of[some]
    # Points on edges: those of the cell, then the edge's own ones on the sides of the box.
    on_edge, on_point = _pairs(n, np.bincount(of, minlength=len(boxes)))
    e, xy, tie = [on_edge], [points[on_point]], [on_point]
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, (axis, side) in enumerate(((0, 0), (0, 2), (1, 1), (1, 3))):
            share = (box[:, side] - p[:, axis]) / d[:, axis]
            some = np.flatnonzero((share > 0) & (share < 1))
            at = np.rint(p[some] + share[some, None] * d[some])
            at[:, axis] = box[some, side]
            e.append(some)
            xy.append(at)
            tie.append(np.full(len(some), len(points) + k))
    e, xy, tie = map(np.concatenate, (e, xy, tie))
    r, along_edge = xy - p[e], d[e]
    along = r[:, 0] * along_edge[:, 0] + r[:, 1] * along_edge[:, 1]
    away = np.abs(r[:, 0] * along_edge[:, 1] - r[:, 1] * along_edge[:, 0])
    length2 = (d[:, 0] ** 2 + d[:, 1] ** 2)[e]
    on = (along >= 0) & (along <= length2) & (away <= 0.75 * np.sqrt(length2))
    on |= (xy == edges[e, :2]).all(1) | (xy == edges[e, 2:]).all(1)
    e, xy, tie, along = e[on], xy[on], tie[on], along[on]
    order = np.lexsort((tie, along, e))
    e, xy = e[order], xy[order]
    new = np.r_[True, (e[1:] != e[:-1]) | (xy[1:] != xy[:-1]).any(1)][: len(e)]
    e, xy = e[new], xy[new]
    follows = e[1:] == e[:-1]
    pieces, parent = _canonical(np.hstack([xy[:-1], xy[1:]])[follows]), e[1:][follows]
    # Pieces of the half-open box, each once, and the edges that hold them.
    x0, y0, x1, y1 = boxes[cell[parent]].T
    mx, my = (pieces[:, 0] + pieces[:, 2]) / 2, (pieces[:, 1] + pieces[:, 3]) / 2
    inside = (mx >= x0) & (mx < x1) & (my >= y0) & (my < y1)
    pieces, parent = pieces[inside], parent[inside]
    if not len(pieces):
        return pieces, parent
    some, which = _distinct(pieces, cell[parent])
    pieces, of = pieces[some], cell[parent[some]]
    mx, my = (pieces[:, 0] + pieces[:, 2]) / 2, (pieces[:, 1] + pieces[:, 3]) / 2
    piece, edge = _pairs(np.bincount(of, minlength=len(boxes)), n)
    own = np.zeros(len(piece), bool)
    own[(_firsts(n[of]) - _firsts(n)[of])[which] + parent] = True
    # Which polygons hold on either side: see boundary.
    x0, y0 = boxes[of, 0], boxes[of, 1]
    ax, ay, bx, by = edges[edge].T
    x, y, left, low = mx[piece], my[piece], x0[piece], y0[piece]
    with np.errstate(divide="ignore", invalid="ignore"):
        at_y = ay + (left - ax) * (by - ay) / (bx - ax)
        up = ((ax > left) != (bx > left)) & (at_y > low) & (at_y <= y)
        at_x = ax + (y - ay) * (bx - ax) / (by - ay)
        right = ((ay > y) != (by > y)) & (at_x > left) & (at_x <= x)
    owners = corner.shape[1]
    slot = piece * owners + owner[edge]
    odd = lambda some: (np.bincount(slot[some], minlength=len(pieces) * owners) % 2 == 1).reshape(-1, owners)
    met = corner[of] ^ odd(up ^ (right & ~own))
    other = met ^ odd(own)
    border = (mx == x0)[:, None]
    held_left, held_right = holds(np.where(border, other, met)), holds(np.where(border, met, other))
    forth, back = held_left & ~held_right, held_right & ~held_left
    return np.concatenate([pieces[forth], pieces[back][:, [2, 3, 0, 1]]]), np.concatenate([of[forth], of[back]])


def union(held: np.ndarray) -> np.ndarray:
    return held.any(1)


def intersection(held: np.ndarray) -> np.ndarray:
    return held.all(1)


def chain(paths: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Paths, each of points by row, joined end to start: closed rings, without their first point at the end, and what stays open.

    Where several paths go on, the one that turns left most does, so that rings touch but do not cross.
    """
    leaving, entering = defaultdict(list), defaultdict(int)
    rings, opened, used = [], [], [False] * len(paths)
    for k, path in enumerate(paths):
        a, b = tuple(path[0].tolist()), tuple(path[-1].tolist())
        if a == b:
            used[k] = True
            rings.append(path[:-1])
            continue
        leaving[a].append(k)
        entering[b] += 1

    def follow(first: int) -> None:
        made, at = [paths[first]], tuple(paths[first][0].tolist())
        start, k = at, first
        used[first] = True
        while True:
            at = tuple(paths[k][-1].tolist())
            if at == start:
                rings.append(np.concatenate([p[:-1] for p in made]))
                return
            ahead = [m for m in leaving[at] if not used[m]]
            if not ahead:
                opened.append(np.concatenate([made[0], *(p[1:] for p in made[1:])]))
                return
            if len(ahead) > 1:
                came = paths[k][-1] - paths[k][-2]
                turn = lambda m: _turn(came, paths[m][1] - paths[m][0])
                k = max(ahead, key=turn)
            else:
                k = ahead[0]
            used[k] = True
            made.append(paths[k])

    for point, some in list(leaving.items()):  # open ends first
        for k in some[: max(0, len(some) - entering[point])]:
            if not used[k]:
                follow(k)
    for k in range(len(paths)):
        if not used[k]:
            follow(k)
    return rings, opened


def _turn(a: np.ndarray, b: np.ndarray) -> float:
    """How far left ``b`` turns from ``a``; straight back counts as right."""
    angle = np.arctan2(a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1])
    return -np.pi if angle >= np.pi else float(angle)


def plain(ring: np.ndarray) -> np.ndarray:
    """A ring without points on the line of their neighbours, up to a unit or two."""
    while len(ring) > 2:
        before, after = np.roll(ring, 1, 0), np.roll(ring, -1, 0)
        a, b = ring - before, after - ring
        away = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
        ahead = (a * b).sum(1) >= 0.999 * np.hypot(*a.T) * np.hypot(*b.T)  # a corner next to a point stays
        flat = (away <= 3 * np.hypot(*(after - before).T)) & ahead
        # Of points in a row only every other goes at a time.
        flat &= ~(np.roll(flat, 1) & (np.arange(len(ring)) % 2 == 1))
        if len(ring) % 2 and flat[0] and flat[-1]:
            flat[-1] = False
        if not flat.any():
            break
        ring = ring[~flat]
    return ring if len(ring) > 2 else ring[:0]


def area(ring: np.ndarray) -> float:
    """Twice the signed area; counter-clockwise is positive."""
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _holds_point(ring: np.ndarray, x: float, y: float) -> bool:
    nxt = np.roll(ring, -1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = ring[:, 0] + (y - ring[:, 1]) * (nxt[:, 0] - ring[:, 0]) / (nxt[:, 1] - ring[:, 1])
    return bool((((ring[:, 1] > y) != (nxt[:, 1] > y)) & (x < at)).sum() % 2)


def nested(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Outer rings, counter-clockwise and largest first, each followed by its holes; closed. Rings without area are left out."""
    sized = [(area(r), r) for r in map(plain, rings) if len(r) > 2]
    outer = sorted(((a, r) for a, r in sized if a > 0), key=lambda s: (-s[0], s[1][:, 0].min(), s[1][:, 1].min()))
    holes = defaultdict(list)
    for a, ring in sized:
        if a >= 0:
            continue
        # Just inside the hole, next to its first edge; the result is on the other side.
        p, d = ring[0], ring[1] - ring[0]
        x, y = p + d / 2 + np.array([d[1], -d[0]]) / np.hypot(*d) * 0.5
        around = [k for k, (b, r) in enumerate(outer) if b >= -a and _holds_point(r, x, y)]
        holes[around[-1] if around else 0].append(ring)
    out = []
    for k, (_, ring) in enumerate(outer):
        out += [np.vstack([r, r[:1]]) for r in (ring, *holes[k])]
    return out


def _plain_rings(points: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`plain` of many rings: their points, and the ring of each, which ascends."""
    while len(points):
        sizes = np.bincount(ring)
        first, size = _firsts(sizes)[ring], sizes[ring]
        at = np.arange(len(ring)) - first
        before, after = first + (at - 1) % size, first + (at + 1) % size
        a, b = points - points[before], points[after] - points
        away = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
        ahead = (a * b).sum(1) >= 0.999 * np.hypot(*a.T) * np.hypot(*b.T)
        flat = (size > 2) & (away <= 3 * np.hypot(*(points[after] - points[before]).T)) & ahead
        flat &= ~(flat[before] & (at % 2 == 1))
        flat &= ~((at == size - 1) & (size % 2 == 1) & flat[first])
        if not flat.any():
            some = size > 2
            return points[some], ring[some]
        points, ring = points[~flat], ring[~flat]
    return points, ring


def _cycles(after: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The cycles of a permutation of at most ``longest``: the smallest member of each member's, and how far behind it the member is."""
    head, ahead = np.arange(len(after)), after
    rounds = int(longest).bit_length()
    for _ in range(rounds):
        head, ahead = np.minimum(head, head[ahead]), ahead[ahead]
    before = np.empty(len(after), np.int64)
    before[after] = np.arange(len(after))
    first = head == np.arange(len(after))
    before[first] = np.flatnonzero(first)
    behind = np.where(first, 0, 1)
    for _ in range(rounds):
        behind, before = behind + behind[before], before[before]
    return head, behind


def outlines(pieces: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the outlines of many shapes as rings: what :func:`chain` and :func:`nested` give for each shape.

    ``shape`` ascends. Returns points, the ring of each point, the shape of each ring and whether the ring is an
    outer one. Rings are closed, in the order of their shapes. Where just one piece goes on from every end, all
    shapes are put together at once; others go by themselves.
    """
    pieces = pieces + 0.0  # no negative zeros
    n, shapes = len(pieces), int(shape[-1]) + 1 if len(shape) else 0
    _, node = _distinct(np.concatenate([pieces[:, :2], pieces[:, 2:]]), np.concatenate([shape, shape]))
    starts, ends = node[:n], node[n:]
    nodes = int(node.max()) + 1 if n else 0
    leaving, entering = np.bincount(starts, minlength=nodes), np.bincount(ends, minlength=nodes)
    odd = (leaving != 1) | (entering != 1)
    hard = np.zeros(shapes, bool)
    hard[shape[odd[starts] | odd[ends]]] = True
    easy = np.flatnonzero(~hard[shape])
    leads = np.empty(nodes, np.int64)
    leads[starts[easy]] = np.arange(len(easy))
    longest = int(np.bincount(shape[easy]).max()) if len(easy) else 0
    head, behind = _cycles(leads[ends[easy]], longest)
    order = np.lexsort((behind, head))
    points, ring = pieces[easy[order], :2], np.cumsum(np.r_[True, np.diff(head[order]) != 0][: len(order)]) - 1
    of = shape[easy][order][np.r_[True, np.diff(ring) != 0][: len(order)]]
    points, ring = _plain_rings(points, ring)
    kept, ring = np.unique(ring, return_inverse=True)
    of, ring = of[kept], ring.reshape(-1)
    sizes = np.bincount(ring, minlength=len(of))
    first = _firsts(sizes)
    at = np.arange(len(ring)) - first[ring]
    rel = points - points[first[ring]]
    nxt = rel[first[ring] + (at + 1) % sizes[ring]]
    areas = np.bincount(ring, rel[:, 0] * nxt[:, 1] - nxt[:, 0] * rel[:, 1], minlength=len(of))
    outer = areas > 0
    n_outer = np.bincount(of[outer], minlength=shapes)
    # Holes of the only outer ring are its own; several outer rings are asked one by one.
    asked = (n_outer > 1) & (np.bincount(of[areas < 0], minlength=shapes) > 0)
    good = np.flatnonzero((areas != 0) & (n_outer[of] > 0) & ~asked[of])
    least = np.minimum.reduceat(points, first) if len(of) else points
    by = np.lexsort((np.where(outer, least[:, 1], 0)[good], np.where(outer, least[:, 0], 0)[good], np.where(outer, -areas, 0)[good], ~outer[good], of[good]))
    good = good[by]
    long = sizes[good] + 1
    start = np.repeat(first[good], long)
    step = np.arange(len(start)) - np.repeat(_firsts(long), long)
    made = [(points[start + step % np.repeat(sizes[good], long)], long, of[good], outer[good])]
    for k in np.flatnonzero(hard | asked):
        if hard[k]:
            a, b = np.searchsorted(shape, [k, k + 1])
            closed, opened = chain(list(pieces[a:b].reshape(-1, 2, 2)))
            rings = nested([*closed, *opened])
        else:
            rings = nested([points[first[r] : first[r] + sizes[r]] for r in np.flatnonzero(of == k)])
        if rings:
            made.append((np.concatenate(rings), np.array([len(r) for r in rings]), np.full(len(rings), k), np.array([area(r) > 0 for r in rings])))
    points, long, of, outer = (np.concatenate(c) for c in zip(*made))
    by = np.argsort(of, kind="stable")
    first = _firsts(long)[by]
    points = points[np.repeat(first, long[by]) + np.arange(len(points)) - np.repeat(_firsts(long[by]), long[by])]
    return points, np.repeat(np.arange(len(by)), long[by]), of[by], outer[by]


def edges_of(rings: Sequence[np.ndarray]) -> np.ndarray:
    """Edges of closed or open rings."""
    out = [np.empty((0, 4))]
    for r in rings:
        if len(r) > 1:
            closed = r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]])
            out.append(np.hstack([closed[:-1], closed[1:]]))
    edges = np.concatenate(out)
    return edges[(edges[:, :2] != edges[:, 2:]).any(1)]


def overlay_rings(polygons: Sequence[Sequence[np.ndarray]], holds: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Closed rings of what several polygons make together, in whole units; each polygon is a list of rings."""
    edges = [edges_of([np.rint(np.asarray(r, float)) for r in rings]) for rings in polygons]
    owner = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    every = np.concatenate(edges) if edges else np.empty((0, 4))
    if not len(every):
        return []
    lo, hi = every.reshape(-1, 2).min(0) - 2, every.reshape(-1, 2).max(0) + 2
    pieces = boundary(every, owner, np.zeros(len(edges), bool), (*lo, *hi), holds)
    rings, opened = chain([p.reshape(2, 2) for p in pieces])
    return nested([*rings, *opened])
