"""Exact nearest-face join of points with triangles, over all faces or within groups that points and faces share.

A group of at most TILE faces is solved at once. The faces of a larger one are dealt to tiles: runs of cells of a fine grid over
their centroids, along a curve that interleaves the bits of the cells' places, of some TILE faces each, whatever shape the group
has; a tile with a crowded cell is split into parts. Tiles have bounding boxes, and so have runs of 4 tiles, and so on up to one
box a group: a table of boxes by level (see box_tree).

A point goes down that hierarchy. On each level it meets the boxes in those boxes it still asks, keeps the least distance
by which some face must be near (a box touches a face on each of its sides), and drops boxes farther than that. The top
of the hierarchy, as many levels as hold at most TOP boxes, is broadcast; further levels are joined one by one, each box
met only by the points that ask its parent. Then a point is solved against the nearest tile, which gives it a distance,
and against the other tiles that are nearer than that, if any.

Tiles are solved where their points and faces meet: points are halved into ever smaller balls, and faces that cannot be
nearest to any point of a ball are left out on the way, large ones by their distance; the exact distance is taken to those
that may be nearest to a point. Points of a crowded place are dealt to several tasks, each with the tile's faces.

Ties go to the nearer centroid, then to the smaller (block, winding, row, col). A point whose group has no face, or whose
group is null, is near to none and gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlens.functions.vectors import sub, triangle_distance, triple, with_triangle_distance
from quadlens.operators.graph import cut, join_counted
from quadlens.operators.splits import running

TILE = 1 << 16  # faces of a tile, about
POINTS = 1 << 12  # points of a task
BITS = 12  # of a cell's place along an axis; tiles are runs of cells
TOP = 1 << 12  # boxes that are broadcast
SALT = 16  # tasks that the points which ask one box are dealt to
BLOCK = 32  # faces of a block
LEAF, STEP = 32, 1024  # points solved together; points that are measured against a few faces before
FEW, WIDE = 32, 1024  # faces that are not worth leaving out; faces at a time
PAIRS = 1 << 17  # pairs whose exact distances are taken at once
SLACK, TINY = 2e-9, 1e-300  # distances are compared to nine digits
FACE = ["winding", "row", "col", "block"]
TIES = ["_g", "face_block", "face_winding", "face_row", "face_col"]


def _best(pairs: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """keys, dist and keep of the best pair of each point."""
    rank = F.struct(F.round("dist", 9).alias("d"), *[F.col(c) for c in TIES], F.col("dist"), *[F.col(c) for c in keep])
    names = ["face_winding", "face_row", "face_col", "face_block"]
    return pairs.groupBy(*keys).agg(F.min(rank).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in ("dist", *names, *keep)])


def _faces_side(faces: DataFrame, keep: list[str]) -> DataFrame:
    corner = [f"{n}{a}" for n in "abcg" for a in "zyx"]
    return faces.select(*[F.col(c).alias(f"face_{c}") for c in FACE], *corner, "radius", *keep)


def nearest_brute(points: DataFrame, faces: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Every pair; for checks on small inputs."""
    keep = list(keep)
    pairs = points.select(*keys, "pz", "py", "px").crossJoin(F.broadcast(_faces_side(faces, keep)))
    d = sub(triple("p"), triple("g"))
    pairs = pairs.withColumn("_g", F.round(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], 6))
    return _best(with_triangle_distance(pairs), keys, keep)


def _array(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], 1) if table.num_rows else np.zeros((0, len(names)))


def _curve(p: np.ndarray, bits: int = 16) -> np.ndarray:
    """Order of points along a curve that interleaves the bits of their places."""
    span = np.ptp(p, axis=0).max() or 1.0
    cell = ((p - p.min(0)) / span * ((1 << bits) - 1)).astype(np.uint64)
    code = np.zeros(len(p), np.uint64)
    for b in range(bits):
        for axis in range(3):
            code |= (cell[:, axis] >> np.uint64(b) & np.uint64(1)) << np.uint64(3 * b + axis)
    return np.argsort(code, kind="stable")


def _dot(x, y):
    return x[0] * y[0] + x[1] * y[1] + x[2] * y[2]


class _Faces:
    """Triangles of one tile, a column each: corners, edges, normals and their products, from which _rough has distances by matrix
    products."""

    def __init__(self, corners: np.ndarray, centroid: np.ndarray, radius: np.ndarray):
        self.corners, self.g = corners, centroid
        a, b, c = corners[:, :3].T, corners[:, 3:6].T, corners[:, 6:].T
        ab, ac, bc = b - a, c - a, c - b
        n = np.cross(ab, ac, axis=0)
        ab2, abac, ac2, bc2, n2 = _dot(ab, ab), _dot(ab, ac), _dot(ac, ac), _dot(bc, bc), _dot(n, n)
        long = np.maximum(np.maximum(ab2, ac2), bc2)
        over = [1 / np.maximum(x, TINY) for x in (ab2, ac2, bc2, n2)]
        self.balls = np.ascontiguousarray(np.concatenate([centroid.T, radius[None]]))
        # blocks of faces that lie near each other along a curve, and their bounding balls
        good = np.flatnonzero(np.isfinite(corners).all(1))
        self.order = good[_curve(centroid[good])] if len(good) else good
        start = np.arange(0, len(self.order), BLOCK)
        self.size = np.diff(np.append(start, len(self.order)))
        self.start, ball = start, self.balls[:, self.order]
        mid = np.add.reduceat(ball[:3], start, axis=1) / self.size if len(start) else ball[:3]
        off = ball[:3] - np.repeat(mid, self.size, axis=1)
        self.blocks = np.concatenate([mid, np.maximum.reduceat(np.sqrt(_dot(off, off)) + ball[3], start)[None] if len(start) else ball[3:]])
        self.edges = np.concatenate([a, ab, ac, n, np.stack([ab2, abac, ac2, bc2, n2, *over, long, n2 <= 1e-4 * long**2, np.sqrt(n2 / np.maximum(long, TINY))])])

    def _rough(self, p: np.ndarray, mid: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, float, np.ndarray | None]:
        """Squared distances of points from faces; by how much they may be wrong; and, if some faces are thin, the height of each
        thin one (0 for others).

        Coordinates are taken from mid, so that rounding stays small. A thin face counts by its sides alone: what lies inside is
        nearer than these by its height at most.
        """
        e = self.edges[:, near]
        ab, ac, n = e[3:6], e[6:9], e[9:12]
        ab2, abac, ac2, bc2, n2, _ab2, _ac2, _bc2, _n2, long, thin, height = e[12:]
        p, a = p - mid, e[:3] - mid[:, None]
        a2, p2 = _dot(a, a), _dot(p.T, p.T)
        size = p2.max() + a2.max() + long.max()
        thin = (thin > 0) | (long <= 1e-7 * size)
        d1, d2 = p @ ab - _dot(a, ab), p @ ac - _dot(a, ac)

        def side(d, length2, over):
            t = d * over
            np.maximum(t, 0, out=t)
            np.minimum(t, 1, out=t)
            out = t * length2
            out -= d
            out -= d
            out *= t
            return out

        found = side(d2 - d1 + (ab2 - abac), bc2, _bc2)
        found += ab2
        found -= 2 * d1
        np.minimum(found, side(d1, ab2, _ab2), out=found)
        np.minimum(found, side(d2, ac2, _ac2), out=found)
        found += p @ (-2 * a) + a2
        found += p2[:, None]
        v, w = ac2 * d1 - abac * d2, ab2 * d2 - abac * d1
        inside = (v >= 0) & (w >= 0)
        v += w
        inside &= v <= n2
        if thin.any():
            inside &= ~thin
        up = p @ n - _dot(a, n)
        up *= up
        up *= _n2
        np.copyto(found, up, where=inside)
        return found, 1e-12 * size, np.where(thin, np.minimum(height, np.sqrt(long)), 0) if thin.any() else None

    def pairs(self, p: np.ndarray, most: np.ndarray):
        """Pairs of points and faces, those of a point side by side, that hold the nearest face of each point and all that tie with
        it. most: what each point's distance is at most, as far as that is known; a point that no face is so near to is in no pair.

        Points are halved until few are left. The points of a ball and the faces that can be nearest to one of them go down
        together: of these faces none is farther from the ball's middle than the nearest one by more than two radii.
        """
        def above(found, error):
            return np.sqrt(np.maximum(found.min(1), 0) + error) + SLACK

        def halves(own, q, near, whole):
            half = np.argpartition(q[:, np.ptp(q, axis=0).argmax()], len(own) // 2)
            return [(own[half[: len(own) // 2]], near, whole), (own[half[len(own) // 2 :]], near, whole)]

        most, work = most.copy(), [(np.flatnonzero(np.isfinite(p).all(1)), np.arange(len(self.size)), True)]
        while work:
            own, near, whole = work.pop()
            if not len(own) or not len(near):
                continue
            q = p[own]
            mid = (q.min(0) + q.max(0)) / 2
            reach = np.sqrt(_dot((q - mid).T, (q - mid).T).max())
            if whole:  # blocks of faces, until they are few or as large as the ball
                ball = self.blocks[:, near]
                to = ball[:3] - mid[:, None]
                to, r = np.sqrt(_dot(to, to)), ball[3]
                near = near[to - r <= min((to + r).min() + 2 * reach, most[own].max() + reach) + SLACK]
                if len(own) > LEAF and len(near) > WIDE // BLOCK and reach > r.mean() / 2:
                    work += halves(own, q, near, True)
                    continue
                n = self.size[near]
                near = self.order[np.repeat(self.start[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ball = self.balls[:, near]
            to = ball[:3] - mid[:, None]
            to, r = np.sqrt(_dot(to, to)), ball[3]
            limit = min(to.min(initial=np.inf) + 2 * reach, most[own].max() + reach) + SLACK  # centroids lie on their faces
            to -= r  # no point of a face is nearer to the middle than that
            at = np.flatnonzero(to <= limit)
            near, to = near[at], to[at]
            if len(near) > FEW and r[at].max() > reach / 4:  # faces as large as the ball
                found, error, height = self._rough(mid[None], mid, near)
                to = np.sqrt(np.maximum(found[0] - error, 0)) - (0 if height is None else height)
                at = np.flatnonzero(to <= min(limit, above(found, error)[0] + 2 * reach))
                near, to = near[at], to[at]
            if len(near) > FEW and len(own) <= STEP:  # what is near to the middle is not far from the points
                first = near[np.argpartition(to, FEW // 2)[: FEW // 2]]
                most[own] = np.minimum(most[own], above(*self._rough(q, mid, first)[:2]))
                at = np.flatnonzero(to <= most[own].max() + reach + SLACK)
                near, to = near[at], to[at]
            if not len(near):
                continue
            if len(own) > LEAF:
                work += halves(own, q, near, False)
                continue
            if len(near) > WIDE:
                near = near[np.argsort(to, kind="stable")]
            point, face, low = [], [], []
            for i in range(0, len(near), WIDE):
                found, error, height = self._rough(q, mid, near[i : i + WIDE])
                most[own] = np.minimum(most[own], above(found, error))
                limit = most[own][:, None] if height is None else most[own][:, None] + height
                x, y = np.nonzero(found <= limit * limit + error)
                point.append(x)
                face.append(near[i + y])
                low.append(np.sqrt(np.maximum(found[x, y] - error, 0)) - (0 if height is None else height[y]))
            point, face, low = np.concatenate(point), np.concatenate(face), np.concatenate(low)
            at = np.flatnonzero(low <= most[own][point] + SLACK)
            if len(near) > WIDE:
                at = at[np.argsort(point[at], kind="stable")]
            yield own[point[at]], face[at]

    def nearest(self, p: np.ndarray, ties: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
        """The points that have a face so near, of each the face, its distance and the squared distance of its centroid."""
        found, held = [], []

        def solved():
            point, face = (np.concatenate(x) for x in zip(*held))
            held.clear()
            g2 = ((p[point] - self.g[face]) ** 2).sum(1).round(6)
            dist = triangle_distance(p[point], *np.moveaxis(self.corners[face].reshape(-1, 3, 3), 1, 0))
            order = np.lexsort((*ties[face].T[::-1], g2, dist.round(9), point))
            first = order[np.concatenate([[True], point[order][1:] != point[order][:-1]])]
            found.append((point[first], face[first], dist[first], g2[first]))

        n = 0
        for pair in self.pairs(p, most):
            held.append(pair)
            n += len(pair[0])
            if n >= PAIRS:
                solved()
                n = 0
        if n:
            solved()
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _solver(names: list[str], keep: list[str]):
    """names: columns of the points that are passed on."""
    corners = [f"{n}{a}" for n in "abc" for a in "zyx"]
    out = [*names, "dist", *TIES, *keep]

    def solve(points: pa.Table, faces: pa.Table) -> pa.Table:
        p = _array(points, ["pz", "py", "px"])
        known = points.column("_dist").to_numpy() if "_dist" in points.column_names else np.full(len(p), np.inf)
        of, face, dist, g2 = (np.zeros(0, np.int64),) * 4
        if len(p) and faces.num_rows:
            tile = _Faces(_array(faces, corners), _array(faces, ["gz", "gy", "gx"]), faces.column("radius").to_numpy())
            p, own = np.unique(p + 0.0, axis=0, return_inverse=True)  # points of one place have one answer
            most = np.full(len(p), -np.inf)
            np.maximum.at(most, own.ravel(), known + SLACK)
            place, *found = tile.nearest(p, _array(faces, TIES[1:]), most)
            at = np.full(len(p), -1)
            at[place] = np.arange(len(place))
            of = np.flatnonzero(at[own.ravel()] >= 0)
            face, dist, g2 = (x[at[own.ravel()[of]]] for x in found)
        take = pa.array(face.astype(np.int64))
        own = [points.column(c).take(pa.array(of)) for c in names]
        return pa.table([*own, pa.array(dist.astype(float)), pa.array(g2.astype(float)), *(faces.column(c).take(take) for c in (*TIES[1:], *keep))], out)

    return solve


def _types(df: DataFrame, names: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f"`{c}` {kinds[c]}" for c in names]


def _solved(asked: DataFrame, faces: DataFrame, at: list[str], names: list[str], keep: list[str], tasks: int) -> DataFrame:
    """tasks: how many pairs of points and faces there are to solve, which bytes say little about; they are spread by number."""
    schema = ", ".join([*_types(asked, names), "dist double, _g double", *_types(faces, [*TIES[1:], *keep])])
    faces = faces.select(*[c for c in faces.columns if c not in at or c in keep], *[F.col(c).alias(f"_at_{c}") for c in at])
    n = max(1, min(4 * tasks, 8 * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    asked, faces, place = asked.repartition(n, *at), faces.repartition(n, *[f"_at_{c}" for c in at]), [f"_at_{c}" for c in at]
    return asked.groupBy(*at).cogroup(faces.groupBy(*place)).applyInArrow(_solver(names, keep), schema)


def _met(asked: DataFrame, faces: DataFrame, at: list[str], keys: list[str], names: list[str], keep: list[str]) -> DataFrame:
    """The best face of each point in each place it asks; asked and faces have the columns `at`. Faces nobody asks stay where they are."""
    tasks = cut(asked.groupBy(*at).agg(*_dealing()))
    many = F.broadcast(tasks.where("tasks > 1"))  # one row for some POINTS points
    faces = faces.join(tasks.select(*at, "tasks"), at).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    asked = asked.join(many, at, "left").withColumn("task", F.coalesce(_task(), F.lit(0))).drop("tasks", "_side")
    return _solved(asked, faces, [*at, "task"], names, keep, tasks.agg(F.sum("tasks")).first()[0] or 0)


def _dealing() -> list[Column]:
    """Aggregates of points: tasks, how many they are dealt to, and _side, of cells that hold some LEAF points each if they lie evenly."""
    n = F.count("*")
    span = F.greatest(*[F.max(c) - F.min(c) for c in ("pz", "py", "px")], F.lit(1e-9))
    return [F.ceil(n / POINTS).cast("int").alias("tasks"), (span / F.ceil(F.cbrt(n / LEAF))).alias("_side")]


def _task() -> Column:
    """The task of a point: points near each other share the faces they need."""
    return F.pmod(F.xxhash64(*[F.floor(F.col(c) / F.col("_side")) for c in ("pz", "py", "px")]), F.col("tasks")).cast("int")


# The hierarchy of boxes

CELL, LOW, HIGH = ["iz", "iy", "ix"], ["z0", "y0", "x0"], ["z1", "y1", "x1"]
FAN = 2  # bits of a cell's place that a level drops, on each axis


def box_tree(leaves: DataFrame, within: list[str], levels: int) -> DataFrame:
    """within, level, cell and box of every box: leaves (level 0) and what holds them, level by level."""
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = up.withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), FAN * F.col("level"))).cast("long") for c in CELL})
    return up.groupBy(*within, "level", *CELL).agg(*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH])


def _bounds(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared: how near a face in a box can be, and how near one must be (some face touches each side of the box)."""
    near = np.maximum(np.maximum(low - p, p - high), 0)
    a, b = np.abs(p - low), np.abs(p - high)
    side, far = np.minimum(a, b) ** 2, np.maximum(a, b) ** 2
    return (near**2).sum(-1), (far.sum(-1)[..., None] - far + side).min(-1)


def _column_bounds() -> tuple[Column, Column]:
    """The same for columns pz, py, px and a box."""
    near, side, far = [], [], []
    for p, low, high in zip(("pz", "py", "px"), LOW, HIGH):
        d = F.greatest(F.col(low) - F.col(p), F.col(p) - F.col(high), F.lit(0.0))
        a, b = F.abs(F.col(p) - F.col(low)), F.abs(F.col(p) - F.col(high))
        near.append(d * d)
        side.append(F.least(a, b) * F.least(a, b))
        far.append(F.greatest(a, b) * F.greatest(a, b))
    whole = far[0] + far[1] + far[2]
    return near[0] + near[1] + near[2], F.least(*(whole - f + s for f, s in zip(far, side)))


class BoxTop:
    """The levels of a hierarchy from `bottom` up, in memory: who may be near, level by level."""

    def __init__(self, boxes: pa.Table, within: list[str], bottom: int):
        level, cell = boxes.column("level").to_numpy(), _array(boxes, CELL).astype(np.int64)
        group = list(zip(*(boxes.column(c).to_pylist() for c in within))) if within else [()] * boxes.num_rows
        self.numbers = {}
        of = np.array([self.numbers.setdefault(g, len(self.numbers)) for g in group], np.int64)
        box = _array(boxes, LOW + HIGH)
        self.low, self.high, self.cell, self.first, self.size = [], [], [], [], []  # from the bottom up
        names = None
        for k in range(int(level.max()), bottom - 1, -1):
            own = np.flatnonzero(level == k)
            parent = list(zip(of[own].tolist(), *((cell[own] >> FAN).T.tolist())))
            above = {x: i for i, x in enumerate(names)} if names else {(g, *c): g for g, *c in parent}
            at = np.array([above[x] for x in parent], np.int64)
            order = np.argsort(at, kind="stable")
            own = own[order]
            n = len(names) if names else len(self.numbers)
            first = np.searchsorted(at[order], np.arange(n + 1))
            self.first.append(first[:-1])
            self.size.append(np.diff(first))
            self.low.append(box[own, :3])
            self.high.append(box[own, 3:])
            names = list(zip(of[own].tolist(), *cell[own].T.tolist()))
            self.cell = cell[own]

    def asks(self, p: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(point, box of the lowest level) pairs, and how many boxes were looked at."""
        point, at, seen = np.arange(len(p)), group, 0
        for first, size, low, high in zip(self.first, self.size, self.low, self.high):
            n = size[at]
            box = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            point = np.repeat(point, n)
            seen += len(box)
            near, must = _bounds(p[point], low[box], high[box])
            bound = np.full(len(p), np.inf)
            np.minimum.at(bound, point, must)
            kept = np.sqrt(near) <= np.sqrt(bound[point]) + SLACK
            point, at = point[kept], box[kept]
        return point, at, seen


def _descended(points: DataFrame, boxes: DataFrame, within: list[str], levels: int) -> DataFrame:
    """Every point with the tiles it asks (CELL), and the squared distance of their boxes (_near)."""
    counts = {r["level"]: r["count"] for r in boxes.groupBy("level").count().collect()}  # a row a level
    kept = points.columns
    bottom = next((k for k in range(levels + 1) if counts[k] <= TOP), None)
    asks = None
    if bottom is not None:
        top = points.sparkSession.sparkContext.broadcast(BoxTop(boxes.where(F.col("level") >= bottom).toArrow(), within, bottom))  # TOP boxes at the bottom, fewer above

        def run(batches):
            tree = top.value
            for b in batches:
                p = _array(b, ["pz", "py", "px"])
                group = list(zip(*(b.column(c).to_pylist() for c in within))) if within else [()] * len(p)
                group = np.array([tree.numbers.get(g, -1) for g in group], np.int64)
                some = np.flatnonzero(group >= 0)
                for i in range(0, len(some), STEP):
                    own = some[i : i + STEP]
                    point, box, _ = tree.asks(p[own], group[own])
                    near = _bounds(p[own][point], tree.low[-1][box], tree.high[-1][box])[0]
                    columns = [b.column(c).take(pa.array(own[point])) for c in kept]
                    yield pa.record_batch([*columns, *(pa.array(x) for x in tree.cell[box].T), pa.array(near)], [*kept, *CELL, "_near"])

        asks = points.mapInArrow(run, ", ".join([*_types(points, kept), "iz long, iy long, ix long, _near double"]))
    else:  # more groups than can be broadcast: their uppermost boxes are joined like any level
        bottom = levels + 1
        asks = points.withColumns({c: F.lit(0).cast("long") for c in CELL})
    salt = F.pmod(F.xxhash64(*kept), F.lit(SALT)).cast("int")
    for level in range(bottom - 1, -1, -1):
        near, must = _column_bounds()
        below = boxes.where(F.col("level") == level).drop("level")
        below = below.select(*within, *[F.floor(F.col(c) / (1 << FAN)).cast("long").alias(f"_{c}") for c in CELL], *[F.col(c).alias(f"_own_{c}") for c in CELL], *LOW, *HIGH, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
        asks = asks.select(*kept, *[F.col(c).alias(f"_{c}") for c in CELL]).withColumn("_salt", salt)
        met = asks.join(below, [*within, *[f"_{c}" for c in CELL], "_salt"]).withColumns({"_near": near, "_must": must})
        met = met.withColumn("_bound", F.min("_must").over(Window.partitionBy(*kept)))  # the boxes that one point asks
        met = met.where(F.sqrt("_near") <= F.sqrt("_bound") + SLACK)
        asks = cut(met.select(*kept, *[F.col(f"_own_{c}").alias(c) for c in CELL], "_near"))
    return asks


def _spread(c: Column) -> Column:
    """The twelve bits of c, two zeros after each."""
    for step, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
    return c


def _code(cells: list[Column]) -> Column:
    """The number of a cell (places below 2 ** BITS) along a curve that interleaves the bits of its places."""
    z, y, x = (_spread(F.least(c.cast("long"), F.lit((1 << BITS) - 1))) for c in cells)
    return F.shiftleft(z, 2).bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(x)


def _tiled(points: DataFrame, faces: DataFrame, groups: DataFrame, within: list[str], keys: list[str], names: list[str], keep: list[str]) -> DataFrame:
    """The same for groups (within, n, size of a cell and least centroid) of more than TILE faces."""
    faces = join_counted(faces, groups, within) if within else faces.crossJoin(F.broadcast(groups)).drop("n")  # without keys, one row
    faces = faces.withColumn("_code", _code([F.floor((F.col(f"g{a}") - F.col(f"_low_{a}")) / F.col("_cell")) for a in "zyx"])).drop("_cell", *[f"_low_{a}" for a in "zyx"])
    edge = lambda f, a: f(*[F.col(f"{n}{a}") for n in "abc"])
    boxes = [F.min(edge(F.least, a)).alias(c) for c, a in zip(LOW, "zyx")] + [F.max(edge(F.greatest, a)).alias(c) for c, a in zip(HIGH, "zyx")]
    counts = running(cut(faces.groupBy(*within, "_code").agg(F.count("*").alias("n"), *boxes)), F.col("n"), *within, "_code")
    if within:
        counts = join_counted(counts, counts.groupBy(*within).agg(F.min("before").alias("_first"), F.count("*").alias("_k")), within, "_k")
    tile = F.floor((F.col("before") - F.col("_first") if within else F.col("before")) / TILE)
    counts = cut(counts.withColumns({"iz": tile.cast("long"), "iy": F.lit(0).cast("long"), "ix": F.lit(0).cast("long")}))
    box = [F.min(c).alias(c) for c in LOW] + [F.max(c).alias(c) for c in HIGH]
    leaves = cut(counts.groupBy(*within, *CELL).agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / (2 * TILE)).cast("int").alias("parts"), *box))
    last = leaves.agg(F.max("iz")).first()[0]
    if last is None:
        return None
    levels = -(-last.bit_length() // FAN)
    tree = cut(box_tree(leaves.drop("parts", "n"), within, levels))
    own = F.pmod(F.xxhash64(*[f"face_{c}" for c in FACE]), F.col("parts")).cast("int")
    places = cut(join_counted(counts.select(*within, "_code", *CELL, "n"), leaves.select(*within, *CELL, "parts", F.col("n").alias("_n")), [*within, *CELL], "_n"))
    faces = join_counted(faces, places, [*within, "_code"]).withColumn("part", own).drop("parts", "_code")
    asks = cut(_descended(points, tree, within, levels))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_near", *CELL))  # the tiles that one point asks
    asks = cut(asks.withColumn("_nth", nth))
    each = leaves.select(*within, *CELL, "parts")
    place = [*within, *CELL, "part"]

    def parted(some):
        hit = some.join(each, [*within, *CELL])
        return hit.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    near = cut(_met(parted(asks.where("_nth = 1").drop("_nth", "_near")), faces, place, keys, names, keep))
    known = near.groupBy(*keys).agg(F.min("dist").alias("_dist"))
    rest = asks.where("_nth > 1").join(known, keys).where(F.sqrt("_near") <= F.col("_dist") + SLACK)
    rest = _met(parted(rest.drop("_nth", "_near")), faces, place, keys, names, keep)
    return _best(near.unionByName(rest), names, keep)


def nearest_faces(points: DataFrame, faces: DataFrame, keys: list[str], keep: list[str] = (), carry: list[str] = (), within: list[str] = ()) -> DataFrame:
    """keys, within and carry (columns of points), dist, face_winding, face_row, face_col, face_block and keep (columns of
    faces) of the face nearest to each point (pz, py, px), among the faces with the same values in the columns `within`."""
    within = list(within)
    keys = [*keys, *(c for c in within if c not in keys)]
    keep, names, place = list(keep), [*keys, *carry], ["pz", "py", "px"]
    points = cut(points.select(*names, *[F.col(c).cast("double").alias(c) for c in place if c not in names]))
    faces = _faces_side(faces, [*keep, *(c for c in within if c not in keep)])
    faces = cut(faces.dropna(subset=within) if within else faces)
    on = [*(c for c in within if c not in place), *place]
    spots = cut(points.groupBy(*on).agg(F.count("*").alias("_n")))
    if 2 * spots.count() > points.count():
        return _found(points, faces, keys, names, keep, within)
    found = _found(spots.drop("_n"), faces, on, on, keep, within)  # points of one place have one answer
    more = [c for c in keep if c not in on]
    found = found.select(*on, "dist", *TIES[1:], *[F.col(c).alias(f"_keep_{c}") for c in more])
    found = join_counted(points, cut(spots.join(found, on)), on, "_n")
    return found.select(*names, "dist", *[f"face_{c}" for c in ("winding", "row", "col", "block")], *[F.col(f"_keep_{c}" if c in more else c).alias(c) for c in keep if c not in names])


def _found(points: DataFrame, faces: DataFrame, keys: list[str], names: list[str], keep: list[str], within: list[str]) -> DataFrame:
    ends = [F.min(f"g{a}").alias(f"_low_{a}") for a in "zyx"]
    span = F.greatest(*[F.max(f"g{a}") - F.min(f"g{a}") for a in "zyx"], F.lit(1e-9))
    groups = faces.groupBy(*within).agg(F.count("*").alias("n"), *ends, (span * F.greatest(F.lit(0.5**BITS), F.sqrt(F.lit(TILE / 4096) / F.count("*")))).alias("_cell"))  # a surface has few faces in a cell
    groups = cut(groups)
    small, large = groups.agg(F.count_if(F.col("n") <= TILE), F.count_if(F.col("n") > TILE)).first()
    if not within:
        if not groups.first()["n"]:
            raise ValueError("no face to be near to")
        if small:
            dealing = cut(points.agg(*_dealing()))  # one row
            tasks = max(1, dealing.first()["tasks"])
            asked = points.crossJoin(F.broadcast(dealing)).withColumn("task", _task()).drop("tasks", "_side")
            dealt = faces.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
            return _solved(asked, dealt, ["task"], names, keep, tasks).drop("_g")
        return _tiled(points, faces, groups, within, keys, names, keep)
    found = []
    if small or not large:
        few = groups.where(F.col("n") <= TILE).select(*within)
        found.append(_met(points.join(few, within, "left_semi"), faces.join(few, within, "left_semi"), within, keys, names, keep).drop("_g"))
    if large:
        many = groups.where(F.col("n") > TILE)
        found.append(_tiled(points, faces, many, within, keys, names, keep))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
