"""Points in polygons with holes and in MultiPolygons, by a hierarchical cover of cells."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.plans.graph import written

#: Width of a cell of level 0 in degrees; each level halves it, so that all bounds are exact.
TOP_DEGREES = 8.0
MAX_LEVEL = 18
#: A border cell with more edges is split.
MAX_EDGES = 24
#: Edges this near to a cell count as its own.
NEAR = 1e-9
#: A cell with at least 1/HOT_PARTS of all points is hot: its part of the cover goes to all tasks.
HOT_PARTS = 1000
#: Covers of so many cells at most are broadcast as a whole.
BROADCAST_CELLS = 100_000
RING = "array<struct<x:double,y:double>>"
STATE = "struct<odd:boolean,steps:array<double>,edges:array<struct<x1:double,y1:double,x2:double,y2:double>>>"


def from_geojson(text: Column) -> Column:
    """The polygons (arrays of rings, the outer one first) of a GeoJSON Polygon or MultiPolygon; null for anything else."""
    kind, at = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.from_json(at, "array<array<array<double>>>")
    many = F.from_json(at, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(F.transform(one, ring))).when(kind == "MultiPolygon", F.transform(many, lambda p: F.transform(p, ring)))


class Ring:
    """What a cell knows of a ring: its own edges, and of all edges to its right whether an odd number of them spans a height: odd, changed at each of steps above it."""

    __slots__ = ("edges", "odd", "steps")

    def __init__(self, edges, odd, steps):
        self.edges, self.odd, self.steps = edges, odd, steps

    def inside(self, x0: float, y0: float, size: float) -> "Ring":
        """The same for a cell within this one.

        Edges that leave the cell's own go right of it or left of it as a whole. Of those on the right, an edge spans a
        height if just one of its ends is above; so ends are counted, and ends that two such edges share cancel.
        """
        e = self.edges
        low_x, low_y, high_x, high_y = x0 - NEAR, y0 - NEAR, x0 + size + NEAR, y0 + size + NEAR
        x1, y1, x2, y2 = e.T
        own = (np.minimum(x1, x2) <= high_x) & (np.maximum(x1, x2) >= low_x) & (np.minimum(y1, y2) <= high_y) & (np.maximum(y1, y2) >= low_y)
        sides = np.stack([(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (low_x, high_x) for y in (low_y, high_y)])
        own &= ~((sides > 0).all(axis=0) | (sides < 0).all(axis=0))
        rest = e[~own]
        bottom, top = np.maximum(np.minimum(rest[:, 1], rest[:, 3]), y0), np.minimum(np.maximum(rest[:, 1], rest[:, 3]), y0 + size)
        rest, middle = rest[bottom < top], ((bottom + top) / 2)[bottom < top]
        at = rest[:, 0] + (middle - rest[:, 1]) * (rest[:, 2] - rest[:, 0]) / (rest[:, 3] - rest[:, 1])
        right = rest[at > x0 + size / 2]
        value, times = np.unique(np.concatenate((self.steps, right[:, 1], right[:, 3])), return_counts=True)
        value = value[times % 2 == 1]
        above = value >= y0 + size
        return Ring(e[own], bool(self.odd ^ (int(above.sum()) % 2 == 1)), value[~above & (value > y0)])


def cover(polygons: list[list[np.ndarray]], max_edges: int = MAX_EDGES, max_level: int = MAX_LEVEL):
    """(level, ix, iy, polygons of Ring or None) of the cells that hold a geometry; None where all of the cell is inside.

    polygons: of each polygon the rings (rows x, y; closed or not), the outer one first. A point is inside if it is in some
    polygon's outer ring and in none of its holes, by the parity of edges to its right.
    """
    def edges(ring):
        after = np.roll(ring, -1, axis=0)
        e = np.concatenate((ring, after), axis=1)
        return Ring(e[e[:, 1] != e[:, 3]], False, np.zeros(0))  # level edges are never crossed

    rings = [[edges(np.asarray(r, float)) for r in p] for p in polygons if p and len(p[0])]
    if not rings:
        return
    every = np.concatenate([p[0].edges for p in rings])
    if not len(every):
        return
    low = every.reshape(-1, 2).min(axis=0)
    high = every.reshape(-1, 2).max(axis=0)
    level = 0
    while level < max_level and (high - low).max() < TOP_DEGREES / 2 ** (level + 1):
        level += 1
    size = TOP_DEGREES / 2**level
    first, last = np.floor(low / size).astype(int), np.floor(high / size).astype(int)
    todo = [(level, ix, iy, rings) for ix in range(first[0], last[0] + 1) for iy in range(first[1], last[1] + 1)]
    while todo:
        level, ix, iy, known = todo.pop()
        size = TOP_DEGREES / 2**level
        known = [[r.inside(ix * size, iy * size, size) for r in p] for p in known]
        left = []
        for outer, *holes in known:
            if not len(outer.edges) and not outer.odd or any(not len(h.edges) and h.odd for h in holes):
                continue  # no point of the cell is in this polygon
            left.append([outer, *[h for h in holes if len(h.edges)]])
        if any(not len(p[0].edges) and len(p) == 1 for p in left):
            yield level, ix, iy, None
        elif left:
            if level < max_level and sum(len(r.edges) for p in left for r in p) > max_edges:
                todo += [(level + 1, 2 * ix + a, 2 * iy + b, left) for a in (0, 1) for b in (0, 1)]
            else:
                yield level, ix, iy, left


def cells(units: DataFrame, max_edges: int = MAX_EDGES, max_level: int = MAX_LEVEL) -> DataFrame:
    """The written cover of units (unit, level, polygons): unit, unit_level, level, ix, iy, polygons (null: all of the cell is inside).

    Each geometry is covered where it stands. Null and empty geometries have no cells.
    """
    kind = units.schema["unit"].dataType.simpleString()
    state = pa.struct([("odd", pa.bool_()), ("steps", pa.list_(pa.float64())), ("edges", pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])))])

    def batches(it):
        for batch in it:
            for k in range(batch.num_rows):
                shape = batch.column(2)[k].as_py() or []
                shape = [[np.array([(p["x"], p["y"]) for p in r or []], float).reshape(-1, 2) for r in polygon or []] for polygon in shape]
                found = []
                for found_cell in cover(shape, max_edges, max_level):
                    found.append(found_cell)
                    if len(found) == 4096:
                        yield rows(batch, k, found)
                        found = []
                if found:
                    yield rows(batch, k, found)

    def rows(batch, k, found):
        told = [None if p is None else [[{"odd": r.odd, "steps": r.steps.tolist(), "edges": [dict(zip(("x1", "y1", "x2", "y2"), e)) for e in r.edges.tolist()]} for r in rings] for rings in p] for *_, p in found]
        same = lambda c: pa.array([batch.column(c)[k].as_py()] * len(found), batch.schema[c].type)
        return pa.RecordBatch.from_arrays([same(0), same(1), *[pa.array([f[i] for f in found], pa.int32()) for i in range(3)], pa.array(told, pa.list_(pa.list_(state)))], names=["unit", "unit_level", "level", "ix", "iy", "polygons"])

    rows_in = units.select("unit", F.col("level").cast("int").alias("unit_level"), "polygons")
    return written(rows_in.mapInArrow(batches, f"unit {kind}, unit_level int, level int, ix int, iy int, polygons array<array<{STATE}>>"), "unit-cells")


def _inside(polygons: Column, x: Column, y: Column) -> Column:
    spans = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    odd = lambda r: (r["odd"].cast("int") + F.size(F.filter(r["steps"], lambda s: s > y)) + F.size(F.filter(r["edges"], spans))) % 2 == 1
    return F.exists(polygons, lambda p: odd(p[0]) & ~F.exists(F.slice(p, 2, F.size(p)), odd))


def units_of_points(points: DataFrame, units: DataFrame, broadcast_cells: int = BROADCAST_CELLS, **cover_settings) -> DataFrame:
    """point_id, unit, level: every unit that holds a point.

    points: point_id, lat, lon; units: unit, level, polygons (array of polygons, each an array of rings of x, y; the first
    ring is the outer one, the others are holes). A point on a border is in by the rule of rays to the right (lower and left
    borders are inside, upper and right ones are not), so units that share a border share no point.

    Points meet the cover under the cells that hold them, one for each level that the cover has; inner cells decide at
    once, border cells by their own few edges. A cover of many cells is joined by cell; cells that hold many points are
    broadcast then (HOT_PARTS at most for each level), so a city's points are not one task's work. Points without a
    position are in no unit; repeated points are each found.
    """
    made = cells(units, **cover_settings)
    levels = sorted(r["level"] for r in made.select("level").distinct().collect())  # MAX_LEVEL + 1 at most
    at = points.filter("lat is not null and lon is not null")
    number = lambda c, level: F.floor(F.col(c) / F.lit(TOP_DEGREES / 2**level)).cast("int")
    at = at.select("point_id", "lat", "lon", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), number("lon", v).alias("ix"), number("lat", v).alias("iy")) for v in levels])).alias("c")) if levels else at.limit(0).select("point_id", "lat", "lon", F.struct(F.lit(0).alias("level"), F.lit(0).alias("ix"), F.lit(0).alias("iy")).alias("c"))
    at = at.select("point_id", "lat", "lon", "c.*")
    key = ["level", "ix", "iy"]
    if made.count() <= broadcast_cells:
        met = at.join(F.broadcast(made), key)
    else:
        sizes = written(at.join(made.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "points-of-cells")
        total = sizes.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(sizes.filter(F.col("n") * HOT_PARTS >= total).select(*key))
        met = at.join(F.broadcast(made.join(hot, key, "left_semi")), key).union(at.join(hot, key, "left_anti").join(made.join(hot, key, "left_anti"), key))
    inside = F.col("polygons").isNull() | _inside(F.col("polygons"), F.col("lon"), F.col("lat"))
    return met.filter(inside).select("point_id", "unit", F.col("unit_level").alias("level"))


def anchored(points: DataFrame, units: DataFrame, **settings) -> DataFrame:
    """points with unit: of the units that hold the point, the one of highest level (then the smallest unit); null if none does."""
    found = units_of_points(points, units, **settings)
    best = found.groupBy("point_id").agg(F.min_by("unit", F.struct(-F.col("level"), F.col("unit"))).alias("unit"))
    return points.join(best, "point_id", "left")


def in_unit(points: DataFrame, units: DataFrame, unit, **settings) -> DataFrame:
    """Those of points(point_id, lat, lon, ...) that lie in a unit."""
    inside = units_of_points(points, units.filter(F.col("unit") == unit), **settings)
    return points.join(inside.select("point_id").distinct(), "point_id", "left_semi")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
