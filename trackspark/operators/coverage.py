"""Which areas a track enters and how deep: lookups, coverage, passages, entry points.

Segments and areas meet on grid cells (an equi-join); the exact test then runs inside the joined row over the few
edges of the area that lie in that row of cells. Depth is measured in projected degrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edge_batches import Edges, covered, numbers, pieces, runs_of, slices
from ..functions.geo import METERS_PER_DEG, haversine_km
from ..functions.polygons import TOUCH, blocked_sql, edge_distance_sql, in_square_sql, inside_cell_sql, inside_sql, nearest_in_square_sql
from ..plans.chunks import spread, top_k, with_neighbors, with_previous
from ..plans.lineage import materialize
from ..plans.ranges import points_in_ranges
from .areas import cos_ref, geometry, with_deepest
from .tracks import cum_distance

# Fixed values.
AREA_DEPTHS_M = (200.0, 220.0)
TILE_DEPTHS_M = (50.0, 70.0)
DEPTH_FRACTION = 0.6
FIRST_ENTRY_M = 20.0
MERGE_KM, TRANSIT_KM, REANCHOR_KM = 0.03, 0.08, 25.0
REVISIT_GAP_KM = 10.0
HOLE_BUCKETS_KM = (3.0, 6.0, 15.0)
LONG_LEGS = 15
# Largest side of a grid cell, and cells per area that a finer grid may make on average.
CELL_DEG, CELLS_PER_AREA = 0.05, 9
# Cells times edges up to which an area is cut without quartering.
DIRECT = 2048
# Cells along the side of a block (a power of two, so that grid lines of both are the same numbers), segments of one part
# of a block, and edges of cells that a task holds at once.
BLOCK, PART_SEGMENTS, PART_EDGES = 32, 100_000, 400_000

CELL_FIELDS = ("cx", "cy", "x0", "y0", "x1", "y1", "edges", "corner_in", "left_x", "low_y", "is_context")
CORES = {"full": "0D", "credit": "credit_d", "deep": "deep_d"}


@dataclass(frozen=True)
class AreaIndex:
    """Areas prepared for lookups; the frames can be written once per pool and read back.

    ``geoms``: one row per area with all edges, box and depths. ``cells``: one row per (area, grid cell) that the area
    reaches, with the edges near that cell only and whether its lower left corner is inside; a cell deep inside has no
    edges. ``near``: the same cells with every edge that can be the nearest one to some point of the cell.
    """

    geoms: DataFrame
    cells: DataFrame
    near: DataFrame
    cos: Column
    cell: float

    def stored(self, near: bool = True) -> "AreaIndex":
        """The same index read back from written tables, for pools that several queries use; ``near`` serves depths only."""
        cells = self.cells if getattr(self.cells, "written_to", None) else materialize(self.cells, "cells", spread=True)
        return replace(self, cells=cells, near=materialize(self.near, "near", spread=True) if near else self.near)

    def inside(self, x: str, y: str) -> str:
        """Whether a point is inside, in a row joined with its cell of ``cells`` or ``near``."""
        return inside_cell_sql("edges", "corner_in", "left_x", "low_y", x, y)

    def in_core(self, x: str, y: str, d: str) -> str:
        """Whether a point is inside and farther than ``d`` (within the reach of the index) from every edge."""
        return f"({self.inside(x, y)} AND ({d} <= 0D OR coalesce({edge_distance_sql('edges', x, y)} > {d}, true)))"


def fitting_cell(geoms: DataFrame, pad: float) -> float:
    """Cell side for these areas: halved from ``CELL_DEG`` while the areas reach few cells each.

    So a cell holds few areas however many lie in the same land, and the table of cells grows with the number of areas.
    """
    w, h = F.col("x1") - F.col("x0") + 2 * pad, F.col("y1") - F.col("y0") + 2 * pad
    n, sides, sizes = geoms.agg(F.count("*"), F.sum(w + h), F.sum(w * h)).first()
    cell = CELL_DEG
    while n and cell > TOUCH * 1e3 and sizes / (cell / 2) ** 2 + sides / (cell / 2) + n <= CELLS_PER_AREA * n:
        cell /= 2
    return cell


def area_index(areas, area_vertices, depths_m=AREA_DEPTHS_M, cell: float | None = None, pad_deg: float = 0.0, fallback: bool = True) -> AreaIndex:
    """Build the index. ``areas`` may carry ``is_context``; such areas are never credited or found.

    An area with no point at the deep depth has its credit core as deep core, or with ``fallback=False`` none. Without
    ``cell`` the grid is as fine as suits the areas.
    """
    credit, deep = (m / METERS_PER_DEG for m in depths_m)
    if "is_context" not in areas.columns:
        areas = areas.withColumn("is_context", F.lit(False))
    cos = cos_ref(areas)
    geoms = geometry(areas.select("area_id", "is_context", "lng", "lat"), area_vertices, cos)
    geoms = geoms.withColumns({"_rx": F.col("lng") * F.col("_cos"), "_ry": F.col("lat")})
    geoms = geoms.withColumns({"_rd": F.expr(edge_distance_sql("edges", "_rx", "_ry")), "_in": F.expr(inside_sql("edges", "_rx", "_ry"))})
    # The deepest point is only searched where the given point does not already prove the core non-empty.
    geoms = with_deepest(geoms, deep / 8, name="_deepest", only=f"NOT (_in AND _rd >= {deep}D)" if fallback else "NOT _in")
    depth = F.coalesce(F.col("_deepest.d"), F.col("_rd"))
    wish = F.least(F.lit(credit), DEPTH_FRACTION * F.col("_rd"))
    geoms = geoms.withColumn("credit_d", F.when(wish <= depth, wish).otherwise(0.0))
    geoms = geoms.withColumn("deep_d", F.when(F.lit(deep) <= depth, F.lit(deep)).otherwise(F.col("credit_d")) if fallback else F.lit(deep))
    geoms = geoms.select("area_id", "is_context", "km2", "credit_d", "deep_d", "x0", "y0", "x1", "y1", "edges")
    geoms = materialize(geoms, "geoms", spread=True)
    reach = max(credit, deep, pad_deg) + TOUCH
    cell = fitting_cell(geoms, pad_deg) if cell is None else cell
    return AreaIndex(geoms, quartered(geoms, cell, reach, pad_deg), quartered(geoms, cell, reach, pad_deg, nearest=True), cos, cell)


def quartered(geoms: DataFrame, cell: float, reach: float, pad: float, nearest: bool = False) -> DataFrame:
    """Cells of every area by cutting its square into quarters down to the grid, each with the edges it still needs.

    A quarter keeps the edges within ``reach``, or with ``nearest`` those no farther from its centre than the nearest
    edge and its own diagonal, and learns from its parent's edges whether its corner is inside. Quarters without an edge
    outside the area are dropped at once. All in the row of the area: nothing is joined or shuffled. An area of few
    cells and edges is cut into its cells at once.
    """
    low = {a: F.floor((F.col(a + "0") - pad) / cell) - 1 for a in "xy"}
    span = F.greatest(*[F.floor((F.col(a + "1") + pad) / cell) + 2 - low[a] for a in "xy"])
    box = [c for c in geoms.columns if c not in ("area_id", "edges")]
    side_cells = {a: F.floor((F.col(a + "1") + pad) / cell) + 2 - low[a] for a in "xy"}
    few = side_cells["x"] * side_cells["y"] * F.size("edges") <= DIRECT
    start = geoms.where(~few).select("area_id", *box, "edges", low["x"].alias("cx"), low["y"].alias("cy"), F.ceil(F.log2(span)).cast("int").alias("_level"), F.lit(False).alias("corner_in"))
    rounds = start.agg(F.max("_level")).first()[0] or 0
    x, y, side = f"(q.x * {cell}D)", f"(q.y * {cell}D)", f"(_size * {cell}D)"
    own = in_square_sql(x, y, side, reach)
    mx, my = f"({x} + {side} / 2)", f"({y} + {side} / 2)"
    kept = nearest_in_square_sql("edges", mx, my, side, reach) if nearest else f"filter(edges, e -> {own})"
    corner = inside_cell_sql("edges", "corner_in", f"(cx * {cell}D)", f"(cy * {cell}D)", x, y)
    quarter = f"named_struct('cx', q.x, 'cy', q.y, 'corner_in', {corner}, 'meets', {f'exists(edges, e -> {own})' if nearest else 'true'}, 'edges', {kept})"
    in_box = f"{x} <= x1 + {pad}D AND {x} + {side} >= x0 - {pad}D AND {y} <= y1 + {pad}D AND {y} + {side} >= y0 - {pad}D"
    places = f"filter(transform(sequence(0, 3), k -> named_struct('x', cx + (k % 2) * _size, 'y', cy + (k div 2) * _size)), q -> {in_box})"
    parts = f"filter(transform({places}, q -> {quarter}), c -> c.corner_in OR c.meets AND size(c.edges) > 0)"
    same = "array(named_struct('cx', cx, 'cy', cy, 'corner_in', corner_in, 'meets', true, 'edges', edges))"
    for _ in range(rounds):
        sized = start.withColumn("_size", F.expr("shiftleft(1L, greatest(_level - 1, 0))"))
        cut = sized.select("area_id", *box, F.greatest(F.col("_level") - 1, F.lit(0)).alias("_level"), F.explode(F.expr(f"CASE WHEN _level = 0 THEN {same} ELSE {parts} END")).alias("c"))
        start = cut.select("area_id", *box, "_level", "c.cx", "c.cy", "c.corner_in", "c.edges")
    at_once = geoms.where(few).withColumns({"_size": F.lit(1), "cx": F.explode(F.sequence(low["x"], low["x"] + side_cells["x"] - 1))})
    at_once = at_once.withColumn("cy", F.explode(F.sequence(low["y"], low["y"] + side_cells["y"] - 1)))
    here = lambda e: F.expr(e.replace("q.x", "cx").replace("q.y", "cy"))
    at_once = at_once.where(here(in_box)).withColumns({
        "corner_in": here(inside_sql("edges", x, y)), "_meets": here(f"exists(edges, e -> {own})" if nearest else "true"), "edges": here(kept),
    })
    at_once = at_once.where("corner_in OR _meets AND size(edges) > 0").select("area_id", *box, "cx", "cy", "corner_in", "edges")
    return start.drop("_level").unionByName(at_once).withColumns({"left_x": F.col("cx") * cell, "low_y": F.col("cy") * cell})


def _projected(points: DataFrame, idx: AreaIndex) -> DataFrame:
    return points.withColumn("_cos", idx.cos).withColumns({"x": F.col("lng") * F.col("_cos"), "y": F.col("lat")}).drop("_cos")


def members(points: DataFrame, idx: AreaIndex, core: str = "full", also: dict[str, str] | None = None) -> DataFrame:
    """Every (point, area) pair with the point inside the area's full polygon or core; adds ``x, y`` and area fields.

    A point meets only the edges near its cell; in a cell deep inside the area it meets none. ``also`` names expressions
    over the same row and its edges.
    """
    at = _projected(points, idx).withColumns({"cx": F.floor(F.col("x") / idx.cell), "cy": F.floor(F.col("y") / idx.cell)})
    pairs = at.join(idx.cells.where("NOT is_context"), ["cx", "cy"])
    pairs = pairs.where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1").where(F.expr(idx.in_core("x", "y", CORES[core])))
    return pairs.withColumns({n: F.expr(e) for n, e in (also or {}).items()}).drop(*CELL_FIELDS)


def locate_points(points: DataFrame, keys: list[str], idx: AreaIndex, core: str = "full") -> DataFrame:
    """Smallest area holding each point: ``(*keys, area_id)``; points in no area are left out."""
    found = members(points.select(*keys, "lng", "lat"), idx, core)
    return found.groupBy(*keys).agg(F.min_by("area_id", F.struct("km2", "area_id")).alias("area_id"))


def cell_pieces(segments: DataFrame, cell: float) -> DataFrame:
    """Cut segments ``(.., x, y, vx, vy)`` at grid lines: adds ``cx, cy`` and the stretch ``t0..t1`` inside that cell."""

    def stretch(start, speed, lo, hi, line):
        """Part of [lo, hi] in which start + t * speed stays in the strip of that number."""
        a, b = (line * cell - start) / speed, ((line + 1) * cell - start) / speed
        moving = F.abs(speed) > 1e-300
        return (
            F.when(moving, F.greatest(lo, F.least(a, b))).otherwise(lo), F.when(moving, F.least(hi, F.greatest(a, b))).otherwise(hi),
        )

    def strips(u, w):
        return F.sequence(F.floor(F.least(u, w) / cell), F.floor(F.greatest(u, w) / cell))

    x, y, vx, vy = (F.col(c) for c in ("x", "y", "vx", "vy"))
    rows = segments.withColumn("cy", F.explode(strips(y, y + vy)))
    lo, hi = stretch(y, vy, F.lit(0.0), F.lit(1.0), F.col("cy"))
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).where("_hi >= _lo")
    rows = rows.withColumn("cx", F.explode(strips(x + F.col("_lo") * vx, x + F.col("_hi") * vx)))
    lo, hi = stretch(x, vx, F.col("_lo"), F.col("_hi"), F.col("cx"))
    return rows.withColumns({"t0": lo, "t1": hi}).where("t1 >= t0").drop("_lo", "_hi")


def track_segments(points: DataFrame, idx: AreaIndex) -> DataFrame:
    """Projected segments ``(track_id, seq, x, y, vx, vy)``; a one-point track gives one segment of no length."""
    near = with_neighbors(
        _projected(points.select("track_id", "seq", "lng", "lat"), idx), "track_id", "seq", prev={"px": "x", "py": "y"}, nxt={"nx": "x"}, heavy=True
    )
    lone = F.col("px").isNull() & F.col("nx").isNull()
    seg = near.where(F.col("px").isNotNull() | lone).withColumn("lone", lone)
    px, py = F.coalesce("px", "x"), F.coalesce("py", "y")
    dx, dy = F.col("x") - px, F.col("y") - py
    # A repeated vertex gets a length far below any tolerance, so that no formula divides by zero.
    still = (dx == 0) & (dy == 0)
    return seg.select("track_id", "seq", "lone", "lng", "lat", px.alias("x"), py.alias("y"), F.when(still, 1e-12).otherwise(dx).alias("vx"), dy.alias("vy"))


def area_coverage(points: DataFrame, idx: AreaIndex, mode: str = "credit") -> DataFrame:
    """Distinct ``(track_id, area_id)`` a track covers: ``credit``, ``deep`` or merely touched (``full``).

    A segment covers an area when some part of it lies inside and no nearer than the depth to any edge.
    One-point tracks count for the smallest area holding them (never ``deep``).
    """
    return area_coverages(points, idx, (mode,)).select("track_id", "area_id")


def area_coverages(points: DataFrame, idx: AreaIndex, modes: tuple[str, ...]) -> DataFrame:
    """Several modes of :func:`area_coverage` in one pass: one row per (track, area) covered in any, with a flag per mode."""
    key = ["track_id", "area_id"]
    seg = track_segments(points, idx)
    cells = idx.cells.where("NOT is_context").select(
        "area_id", *CELL_FIELDS[:-1], *[F.expr(CORES[m]).alias(f"d_{m}") for m in modes], *[F.floor(F.col("c" + a) / BLOCK).alias("b" + a) for a in "xy"]
    )
    met = in_blocks(seg.where("NOT lone").select("track_id", "seq", "x", "y", "vx", "vy"), cells, crowded_blocks(points, cells, idx), idx.cell)
    flags = T.StructType([*(met.schema[k] for k in key), *(T.StructField(m, T.BooleanType()) for m in modes)])
    hit = met.mapInArrow(_covered(modes, idx.cell), flags)
    if set(modes) != {"deep"}:
        lone = locate_points(seg.where("lone").select("track_id", "lng", "lat"), ["track_id"], idx)
        hit = hit.unionByName(lone.select(*key, *[F.lit(m != "deep").alias(m) for m in modes]))
    return hit.groupBy(*key).agg(*[F.max(m).alias(m) for m in modes])


def crowded_blocks(points: DataFrame, cells: DataFrame, idx: AreaIndex) -> DataFrame:
    """Blocks that need several tasks: in how many parts their segments (told by the points in them) and their areas are dealt."""
    side = idx.cell * BLOCK
    at = _projected(points.select("lng", "lat"), idx).groupBy(*[F.floor(F.col(a) / side).alias("b" + a) for a in "xy"])
    many = at.agg(F.ceil(F.count("*") / PART_SEGMENTS).alias("s_parts")).where("s_parts > 1")
    full = cells.groupBy("bx", "by").agg(F.ceil(F.sum(1 + F.size("edges")) / PART_EDGES).alias("c_parts")).where("c_parts > 1")
    return materialize(many.join(full, ["bx", "by"], "full").fillna(1, ["s_parts", "c_parts"]), "crowded")


def in_blocks(segments: DataFrame, cells: DataFrame, crowded: DataFrame, cell: float) -> DataFrame:
    """Segments and cells in one frame, dealt by block and in each block cells first; cell rows have no ``seq``.

    A segment comes once to every block it crosses. Cut at every cell line before it is shuffled, as many rows as cells
    would move, and those grow as the areas get smaller.
    """
    def parts(rows, own, other, by):
        rows = rows.join(crowded, ["bx", "by"], "left").fillna(1, ["s_parts", "c_parts"])
        rows = rows.withColumn(own[0] + "p", F.pmod(F.xxhash64(*by), F.col(own)))
        return rows.withColumn(other[0] + "p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).drop("s_parts", "c_parts")

    crossed = cell_pieces(segments, cell * BLOCK).drop("t0", "t1").withColumnsRenamed({"cx": "bx", "cy": "by"})
    crossed = parts(crossed, "s_parts", "c_parts", ["track_id", "seq"])
    both = parts(cells, "c_parts", "s_parts", ["area_id"]).unionByName(crossed, allowMissingColumns=True)
    deal = ["bx", "by", "sp", "cp"]
    return spread(both, *deal).sortWithinPartitions(*deal, F.col("seq").asc_nulls_first())


def _covered(modes: tuple[str, ...], cell: float):
    """Task of :func:`area_coverages`: holds the cells of a block, cuts the segments that follow into pieces and tests these."""
    names = ["track_id", "area_id", *modes]

    def tested(rows: pa.RecordBatch, held: pa.Table, block: tuple) -> Iterator[pa.RecordBatch]:
        keys = np.asarray(held.column("cx")) * 2**32 + np.asarray(held.column("cy"))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        x0, y0, x1, y1 = (np.asarray(held.column(n)) for n in ("x0", "y0", "x1", "y1"))
        depth = {m: np.asarray(held.column(f"d_{m}")) for m in modes}
        at = {n: numbers(rows, n) for n in ("x", "y", "vx", "vy")}
        for seg, cx, cy, t0, t1 in pieces(*at.values(), cell, BLOCK, *block):
            key = cx * 2**32 + cy
            for item, place in runs_of(np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")):
                of, s, a, b = order[place], seg[item], t0[item], t1[item]
                x, y, vx, vy = (v[s] for v in at.values())
                ends = (x + a * vx, x + b * vx), (y + a * vy, y + b * vy)
                # A core lies inside the area's box shrunk by the depth; most pairs of a cell end here.
                boxes = {
                    m: (np.maximum(*ends[0]) >= x0[of] + d[of]) & (np.minimum(*ends[0]) <= x1[of] - d[of])
                    & (np.maximum(*ends[1]) >= y0[of] + d[of]) & (np.minimum(*ends[1]) <= y1[of] - d[of]) for m, d in depth.items()
                }
                some = np.flatnonzero(np.logical_or.reduce(list(boxes.values())))
                if not len(some):
                    continue
                of = of[some]
                pairs = held.select(["area_id", "left_x", "low_y", "corner_in", "edges", *(f"d_{m}" for m in modes)]).take(pa.array(of))
                given = {"x": x, "y": y, "vx": vx, "vy": vy, "t0": a, "t1": b} | {f"box_{m}": v for m, v in boxes.items()}
                for n, v in given.items():
                    pairs = pairs.append_column(n, pa.array(v[some]))
                pairs = pairs.append_column("track_id", rows.column("track_id").take(pa.array(s[some])))
                for batch in (part for whole in pairs.combine_chunks().to_batches() for part in slices(whole)):
                    edges = Edges(batch)
                    hits = [covered(batch, edges, numbers(batch, f"box_{m}"), numbers(batch, f"d_{m}"), TOUCH) for m in modes]
                    found = np.logical_or.reduce(hits)
                    own = batch.select(names[:2]).filter(pa.array(found))
                    yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(h[found]) for h in hits]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, held = None, [], None
        for batch in batches:
            deal = np.stack([numbers(batch, n) for n in ("bx", "by", "sp", "cp")])
            is_cell = np.asarray(batch.column("seq").is_null())
            cuts = np.flatnonzero((deal[:, 1:] != deal[:, :-1]).any(axis=0) | (is_cell[1:] != is_cell[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                here, rows = tuple(deal[:, lo]), batch.slice(lo, hi - lo)
                if here != block:
                    block, kept, held = here, [], None
                if is_cell[lo]:
                    kept.append(rows)
                elif kept:
                    held = pa.Table.from_batches(kept).combine_chunks() if held is None else held
                    yield from tested(rows, held, here[:2])

    return run


def last_entries(ways: DataFrame, keys: list[str], idx: AreaIndex, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``ex, ey``: on a way ``(*keys, area_id, x, y, vx, vy, d)`` from outside to inside a core, where the core is last entered.

    Ways are cut at cell lines and meet the edges of their area's cells; the last edge zone left before the end decides.
    A way that meets none starts in the core. Columns of ``carry`` come along.
    """
    still = (F.col("vx") == 0) & (F.col("vy") == 0)
    ways = ways.withColumns({"_r": F.greatest(F.col("d"), F.lit(TOUCH)), "vx": F.when(still, 1e-12).otherwise(F.col("vx"))})
    rest = ["x", "y", "vx", "vy", *carry]
    pieces = cell_pieces(ways, idx.cell).select(*keys, "area_id", "cx", "cy", "_r", *rest)
    met = pieces.join(idx.cells.where("size(edges) > 0").select("area_id", "cx", "cy", "edges"), ["area_id", "cx", "cy"], "left")
    zones = blocked_sql("edges", "x", "y", "vx", "vy", "_r")
    last = F.expr(f"array_max(transform(filter({zones}, z -> z.lo < 1D AND z.hi > 0D), z -> least(1D, z.hi)))")
    left = met.withColumn("_t", last).groupBy(*keys, "area_id").agg(F.coalesce(F.max("_t"), F.lit(0.0)).alias("_t"), *[F.first(c).alias(c) for c in rest])
    at = {"ex": F.col("x") + F.col("_t") * F.col("vx"), "ey": F.col("y") + F.col("_t") * F.col("vy")}
    return left.withColumns(at).drop("_t")


def _around(points: DataFrame, idx: AreaIndex) -> DataFrame:
    near = with_neighbors(
        _projected(points.select("track_id", "seq", "lng", "lat"), idx), "track_id", "seq",
        prev={"px": "x", "py": "y"}, nxt={"nx": "x", "ny": "y"}, heavy=True,
    )
    return near.drop("_chunk", "x", "y")


def _km(ax, ay, bx, by) -> Column:
    return F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by)) * METERS_PER_DEG / 1000.0


def passages(points: DataFrame, idx: AreaIndex) -> DataFrame:
    """Runs of vertices in the deep core: ``(track_id, area_id, n, first_seq, entry, exit, chord_km)``.

    Entry and exit lie on the core's boundary; a run open at the track's end closes at its last vertex; runs less
    than 30 m apart are one passage. Every vertex is tested once, in its cell; a run starts or ends where the vertex
    before or after is not in the same core, which equi-joins on (track, area, seq) tell. Vertices in the middle of a
    run are dropped before anything is grouped.
    """
    key = ["track_id", "area_id"]
    here = members(_around(points, idx), idx, "deep").select(*key, "seq", "x", "y", "px", "py", "nx", "ny", F.col("deep_d").alias("d"))
    # Only vertices with neighbouring numbers matter, so gaps between runs do not.
    here = with_neighbors(here, key, "seq", prev={"p_seq": "seq"}, nxt={"n_seq": "seq"})
    ends = [
        F.when(inside.isNull() | (inside != F.col("seq") + step), F.struct(F.lit(step).alias("side"), F.col(x).alias("fx"), F.col(y).alias("fy")))
        for inside, step, x, y in ((F.col("p_seq"), -1, "px", "py"), (F.col("n_seq"), 1, "nx", "ny"))
    ]
    edge = here.select(*key, "seq", "x", "y", "d", F.explode(F.array_compact(F.array(*ends))).alias("w")).select(*key, "seq", "d", "w.*", F.col("x").alias("tx"), F.col("y").alias("ty"))
    ways = edge.where("fx IS NOT NULL").select(*key, "seq", "side", "d", F.col("fx").alias("x"), F.col("fy").alias("y"), (F.col("tx") - F.col("fx")).alias("vx"), (F.col("ty") - F.col("fy")).alias("vy"))
    crossed = last_entries(ways, ["track_id", "seq", "side"], idx).select(*key, "seq", "side", F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")).alias("at"))
    crossed = crossed.unionByName(edge.where("fx IS NULL").select(*key, "seq", "side", F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")).alias("at")))
    # Entries (-1) and exits (1) alternate.
    along = Window.partitionBy(*key).orderBy("seq", "side")
    runs = crossed.withColumns({"o": F.lead("at").over(along), "p_o": F.lag("at").over(along)}).where("side = -1").withColumnRenamed("at", "i")
    apart = F.coalesce(_km("p_o.x", "p_o.y", "i.x", "i.y") >= MERGE_KM, F.lit(True))
    runs = runs.withColumn("n", F.sum(apart.cast("int")).over(Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = runs.groupBy(*key, "n").agg(F.min("seq").alias("first_seq"), F.min_by("i", "seq").alias("i"), F.max_by("o", "seq").alias("o"))
    joined = joined.withColumn("_cos", idx.cos)
    lng = lambda c: F.col(c + ".x") / F.col("_cos")
    return joined.select(
        *key, F.col("n").cast("int").alias("n"), "first_seq", lng("i").alias("entry_lng"), F.col("i.y").alias("entry_lat"),
        lng("o").alias("exit_lng"), F.col("o.y").alias("exit_lat"), _km("i.x", "i.y", "o.x", "o.y").alias("chord_km"),
    )


def entry_points(points: DataFrame, idx: AreaIndex) -> DataFrame:
    """Where each track first enters each area: ``(track_id, area_id, lng, lat, level)``.

    The first crossing of the deep core; for areas never entered that deep the first crossing of the credit core,
    moved 20 m on along the track when that stays inside the core.
    """
    key = ["track_id", "area_id"]
    # The deep core lies inside the credit core, so one pass over the credit core finds both.
    found = members(_around(points, idx), idx, "credit", {"_deep": idx.in_core("x", "y", "deep_d")})
    row = F.struct("seq", "x", "y", "px", "py", "nx", "ny", "credit_d", "deep_d")
    both = found.groupBy(*key).agg(F.min_by(row, "seq").alias("credit"), F.min_by(row, F.when(F.col("_deep"), F.col("seq"))).alias("deep"))
    is_deep = F.col("deep").isNotNull()
    both = both.select(*key, F.when(is_deep, "deep").otherwise("credit").alias("level"), F.coalesce("deep", "credit").alias("v"))
    both = both.withColumn("d", F.when(F.col("level") == "deep", F.col("v.deep_d")).otherwise(F.col("v.credit_d")))
    fx, fy = F.coalesce("v.px", "v.x"), F.coalesce("v.py", "v.y")
    # A track's first vertex is its own way: no length, so it ends where it starts.
    ways = both.select(*key, "level", "v", "d", fx.alias("x"), fy.alias("y"), (F.col("v.x") - fx).alias("vx"), (F.col("v.y") - fy).alias("vy"))
    both = last_entries(ways, ["track_id"], idx, carry=("level", "v")).drop("x", "y", "vx", "vy")
    dx = F.when(F.col("v.px").isNotNull(), F.col("v.x") - F.col("v.px")).otherwise(F.col("v.nx") - F.col("v.x"))
    dy = F.when(F.col("v.py").isNotNull(), F.col("v.y") - F.col("v.py")).otherwise(F.col("v.ny") - F.col("v.y"))
    both = both.withColumns({"_dx": dx, "_dy": dy}).withColumn("_l", F.hypot("_dx", "_dy"))
    off = FIRST_ENTRY_M / METERS_PER_DEG
    moves = (F.col("level") == "credit") & (F.col("_l") > 1e-12)
    ahead = {n: F.when(moves, F.col("e" + n) + F.col("_d" + n) / F.col("_l") * off) for n in "xy"}
    both = both.withColumns({"a" + n: c for n, c in ahead.items()}).withColumns({"cx": F.floor(F.col("ax") / idx.cell), "cy": F.floor(F.col("ay") / idx.cell)})
    both = both.join(idx.cells.select("area_id", "cx", "cy", "corner_in", "left_x", "low_y", "edges"), ["area_id", "cx", "cy"], "left")
    still_in = F.coalesce(F.expr(idx.in_core("ax", "ay", "v.credit_d")), F.lit(False))
    x, y = (F.when(still_in, F.col("a" + n)).otherwise(F.col("e" + n)) for n in "xy")
    return both.withColumn("_cos", idx.cos).select(*key, (x / F.col("_cos")).alias("lng"), y.alias("lat"), "level")


def depths(points: DataFrame, keys: list[str], idx: AreaIndex) -> DataFrame:
    """Depth in metres of every point in every area holding it: ``(*keys, area_id, lng, lat, depth_m)``.

    A point meets only the edges that can be the nearest ones in its cell.
    """
    at = _projected(points.select(*keys, "lng", "lat"), idx).withColumns({"cx": F.floor(F.col("x") / idx.cell), "cy": F.floor(F.col("y") / idx.cell)})
    pairs = at.join(idx.near.where("NOT is_context"), ["cx", "cy"])
    pairs = pairs.where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1").where(F.expr(idx.inside("x", "y")))
    depth = F.expr(edge_distance_sql("edges", "x", "y")) * METERS_PER_DEG
    return pairs.select(*keys, "area_id", "lng", "lat", depth.alias("depth_m"))


def first_at_depth(points: DataFrame, idx: AreaIndex, min_depth_m: float) -> DataFrame:
    """First vertex of each track at least that deep in each area."""
    deep = depths(points, ["track_id", "seq"], idx).where(F.col("depth_m") >= min_depth_m)
    return deep.groupBy("track_id", "area_id").agg(F.min_by(F.struct("seq", "lng", "lat"), "seq").alias("p")).select("track_id", "area_id", "p.*")


def deepest_on_track(points: DataFrame, idx: AreaIndex) -> DataFrame:
    """Deepest vertex of each track in each area, the earliest on a tie."""
    best = F.max_by(F.struct("seq", "lng", "lat", "depth_m"), F.struct("depth_m", -F.col("seq")))
    return depths(points, ["track_id", "seq"], idx).groupBy("track_id", "area_id").agg(best.alias("p")).select("track_id", "area_id", "p.*")


def shallow_areas(touched: DataFrame, deep: DataFrame | None, anchors_deep: DataFrame) -> DataFrame:
    """Touched but not deeply entered, and with no anchor already deep inside; without ``deep`` those entered are left out of ``touched`` already."""
    key = ["track_id", "area_id"]
    shallow = touched if deep is None else touched.join(deep, key, "left_anti")
    return shallow.join(anchors_deep, key, "left_anti")


def visit_counts(points: DataFrame, idx: AreaIndex, gap_km: float = REVISIT_GAP_KM) -> DataFrame:
    """Visits per (track, area): a vertex opens a new visit when the last one there is more than ``gap_km`` back."""
    cum = cum_distance(points.select("track_id", "seq", "lng", "lat"))
    found = members(cum, idx).groupBy("track_id", "seq").agg(
        F.min_by("area_id", F.struct("km2", "area_id")).alias("area_id"), F.first("cum_m").alias("cum_m")
    )
    back = with_previous(found, ["track_id", "area_id"], "seq", {"p_m": "cum_m"})
    new = F.coalesce((F.col("cum_m") - F.col("p_m")) / 1000.0 > gap_km, F.lit(True))
    return back.groupBy("track_id", "area_id").agg(F.sum(new.cast("bigint")).alias("visits"))


def spur_report(crossed: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Transit or dead end per (track, area), and where its way-point should move.

    ``crossed`` is :func:`passages`; ``waypoints`` is ``(track_id, area_id, pos, lng, lat)``, located already. The
    target is the entry of the first passage at least 80 m long, else of the first; one farther than 25 km from the
    kept way-point is dropped.
    """
    key = ["track_id", "area_id"]
    entry = F.struct("entry_lng", "entry_lat")
    through = F.when(F.col("chord_km") >= TRANSIT_KM, F.col("n"))
    runs = crossed.groupBy(*key).agg(F.count("*").alias("passages"), F.min_by(entry, through).alias("t"), F.min_by(entry, "n").alias("f"))
    wps = waypoints.groupBy(*key).agg(F.count("*").alias("waypoints"), F.min_by(F.struct("lng", "lat"), "pos").alias("keep"))
    out = wps.join(runs, key, "left").withColumns({"transit": F.col("t").isNotNull(), "goal": F.coalesce("t", "f")})
    far = haversine_km("keep.lng", "keep.lat", "goal.entry_lng", "goal.entry_lat") > REANCHOR_KM
    goal = F.when(~far, F.col("goal"))
    kind = F.when(F.col("transit"), "TRANSIT").when(F.col("waypoints") >= 2, "MULTI").otherwise("SINGLE")
    return out.withColumn("goal", goal).select(
        *key, F.coalesce("passages", F.lit(0)).alias("passages"), "waypoints", "transit", kind.alias("kind"),
        F.col("goal.entry_lng").alias("target_lng"), F.col("goal.entry_lat").alias("target_lat"),
    )


def coverage_breakdown(coverage: DataFrame, labels: DataFrame) -> DataFrame:
    """Covered areas per track and label (category or level name)."""
    return coverage.join(labels, "area_id").groupBy("track_id", "label").agg(F.count("*").alias("areas"))


def coverage_rollup(coverage: DataFrame, areas: DataFrame) -> DataFrame:
    """Covered areas per (country, level), per country and in all."""
    out = coverage.join(areas.select("area_id", "country_id", "level_id"), "area_id")
    return out.rollup("country_id", "level_id").agg(F.count("*").alias("areas"))


def areas_without_waypoint(coverage: DataFrame, waypoints_in_core: DataFrame) -> DataFrame:
    return coverage.join(waypoints_in_core.select("track_id", "area_id"), ["track_id", "area_id"], "left_anti")


def duplicate_waypoints(located: DataFrame) -> DataFrame:
    """Areas holding more than one way-point of a track."""
    return located.groupBy("track_id", "area_id").agg(F.count("*").alias("waypoints")).where("waypoints > 1")


def coverage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Areas lost per track."""
    lost = before.join(after, ["track_id", "area_id"], "left_anti")
    return lost.groupBy("track_id").agg(F.count("*").alias("lost"))


def areas_lost(flags: DataFrame, before: str, after: str) -> DataFrame:
    """Areas of :func:`area_coverages` covered in mode ``before`` but not ``after``."""
    return flags.where(F.col(before) & ~F.col(after)).select("track_id", "area_id")


def coverage_sets(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``intersect`` or ``except`` of two coverage sets."""
    return a.intersect(b) if op == "intersect" else a.exceptAll(b)


def hole_report(missed: DataFrame, names: int | None = None) -> DataFrame:
    """Missed areas per plan by distance: input ``(plan_id, area_id, name, dist_km)``; ``names`` asks for so many first names."""
    a, b, c = HOLE_BUCKETS_KM
    d = F.col("dist_km")
    counts = missed.groupBy("plan_id").agg(
        F.count("*").alias("holes"), F.count_if(d <= a).alias("near"), F.count_if((d > a) & (d <= b)).alias("close"),
        F.count_if((d > b) & (d <= c)).alias("mid"), F.count_if(d > c).alias("far"),
    )
    if names is None:
        return counts
    label = F.concat(F.col("name"), F.lit("("), F.floor(d + 0.5).cast("string"), F.lit("km)"))
    first = top_k(missed.select("plan_id", "area_id", label.alias("label")), "plan_id", [F.col("area_id")], names)
    listed = first.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("l"))
    return counts.join(listed.select("plan_id", F.array_join(F.transform("l", lambda x: x["label"]), ",").alias("names")), "plan_id")


def long_legs(legs: DataFrame, leg_areas: DataFrame, k: int = LONG_LEGS) -> DataFrame:
    """The ``k`` longest legs per plan as the crow flies, with routed km and areas crossed (``leg_areas``: plan_id, pos, area_id)."""
    n = leg_areas.groupBy("plan_id", "pos").agg(F.count_distinct("area_id").alias("areas"))
    far = legs.select("plan_id", "pos", "km", haversine_km("a_lng", "a_lat", "b_lng", "b_lat").alias("hav_km"))
    best = top_k(far, "plan_id", [F.col("hav_km").desc(), F.col("pos")], k)
    return best.join(n, ["plan_id", "pos"], "left").fillna(0, ["areas"])


def leg_vertices(points: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Track vertices of every leg between consecutive way-points: ``(plan_id, pos, seq, lng, lat)``."""
    spans = with_neighbors(waypoints.select("plan_id", "pos", "seq"), "plan_id", "pos", prev={"from_seq": "seq"}).where("from_seq IS NOT NULL")
    spans = spans.select(F.col("plan_id").alias("track_id"), "pos", "from_seq", F.col("seq").alias("to_seq"))
    hit = points_in_ranges(points.select("track_id", "seq", "lng", "lat"), spans, ["track_id"], "seq", "from_seq", "to_seq")
    return hit.select(F.col("track_id").alias("plan_id"), "pos", "seq", "lng", "lat")
