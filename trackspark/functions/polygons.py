"""Polygon tests as higher-order SQL expressions over an array of edges.

An edge is ``struct(ax, ay, bx, by, ux, uy, len)`` in projected degrees (x = lng * cos, y = lat) with ``u`` its
unit direction. Everything works inside one row, so no test shuffles or multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_TYPE = "array<struct<ax:double,ay:double,bx:double,by:double,ux:double,uy:double,len:double>>"
TOUCH = 1e-9  # degrees, about 0.1 mm: stands in for "on the boundary"


def edge_struct(ax, ay, bx, by) -> Column:
    length = F.hypot(bx - ax, by - ay)
    return F.struct(
        ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"),
        ((bx - ax) / length).alias("ux"), ((by - ay) / length).alias("uy"), length.alias("len"),
    )


def inside_sql(edges: str, px: str, py: str) -> str:
    """Even-odd rule over all rings, so holes count as outside."""
    cross = f"(e.ay > {py}) <> (e.by > {py}) AND {px} < (e.bx - e.ax) * ({py} - e.ay) / (e.by - e.ay) + e.ax"
    return f"(size(filter({edges}, e -> {cross})) % 2 = 1)"


def inside_cell_sql(edges: str, corner_in: str, cx: str, cy: str, px: str, py: str) -> str:
    """Even-odd rule from a cell's corner (cx, cy), of which ``corner_in`` is known: up its left side, then across to p.

    Only edges that meet the cell are looked at, so any set of edges that has those will do. Corner and point are taken
    a hair to the right and above, as in :func:`inside_sql`.
    """
    left_y = f"e.ay + ({cx} - e.ax) * (e.by - e.ay) / (e.bx - e.ax)"
    up = f"(e.ax > {cx}) <> (e.bx > {cx}) AND {left_y} > {cy} AND {left_y} <= {py}"
    row_x = f"(e.bx - e.ax) * ({py} - e.ay) / (e.by - e.ay) + e.ax"
    across = f"(e.ay > {py}) <> (e.by > {py}) AND {row_x} > {cx} AND {row_x} <= {px}"
    return f"({corner_in} <> ((size(filter({edges}, e -> {up})) + size(filter({edges}, e -> {across}))) % 2 = 1))"


def in_square_sql(x: str, y: str, side: str, reach: float) -> str:
    """Whether edge ``e`` comes within ``reach`` of a square (or a little farther): boxes overlap, and so do the shadows across the edge."""
    return (
        f"least(e.ax, e.bx) <= {x} + {side} + {reach}D AND greatest(e.ax, e.bx) >= {x} - {reach}D AND "
        f"least(e.ay, e.by) <= {y} + {side} + {reach}D AND greatest(e.ay, e.by) >= {y} - {reach}D AND "
        f"abs(({x} + {side} / 2 - e.ax) * e.uy - ({y} + {side} / 2 - e.ay) * e.ux) <= (abs(e.ux) + abs(e.uy)) * {side} / 2 + {1.5 * reach}D"
    )


def edge_distance_sql(edges: str, px: str, py: str) -> str:
    """Distance to the nearest edge."""
    t = f"greatest(0D, least(e.len, ({px} - e.ax) * e.ux + ({py} - e.ay) * e.uy))"
    return f"array_min(transform({edges}, e -> hypot({px} - e.ax - e.ux * {t}, {py} - e.ay - e.uy * {t})))"


def nearest_in_square_sql(edges: str, mx: str, my: str, side: str, reach: float = 0.0) -> str:
    """The edges that can be nearest to some point of a square with centre (mx, my), and all within ``reach`` of it."""
    t = f"greatest(0D, least(e.len, ({mx} - e.ax) * e.ux + ({my} - e.ay) * e.uy))"
    far = f"greatest({edge_distance_sql(edges, mx, my)} + {side} * {2**0.5}D, {side} * {0.5**0.5}D + {reach}D)"
    return f"transform(array({far}), far -> filter({edges}, e -> hypot({mx} - e.ax - e.ux * {t}, {my} - e.ay - e.uy * {t}) <= far))[0]"


def blocked_sql(edges: str, px: str, py: str, vx: str, vy: str, d: str) -> str:
    """Per nearby edge the one interval of t in which p + t v is nearer than ``d`` to it: ``array<struct<lo, hi>>``.

    The zone around an edge is a slab and two discs; it is convex, so a line meets it in a single interval. Pass
    plain column names: they are read many times per edge.
    """
    tiny = "1e-300D"
    local = (
        f"named_struct('a', ({px} - e.ax) * e.ux + ({py} - e.ay) * e.uy, 'va', {vx} * e.ux + {vy} * e.uy, "
        f"'b', ({py} - e.ay) * e.ux - ({px} - e.ax) * e.uy, 'vb', {vy} * e.ux - {vx} * e.uy, 'len', e.len, "
        f"'s', {vx} * {vx} + {vy} * {vy})"
    )
    near = (
        f"(least(abs(s.b), abs(s.b + s.vb)) < {d} OR s.b * (s.b + s.vb) <= 0D) "
        f"AND least(s.a, s.a + s.va) < s.len + {d} AND greatest(s.a, s.a + s.va) > -{d}"
    )

    def disc(shift: str) -> tuple[str, str]:
        a = f"(s.a - {shift})"
        return f"-({a} * s.va + s.b * s.vb) / s.s", f"({d} * {d} - pow({a} * s.vb - s.b * s.va, 2) / s.s) / s.s"

    def safe(v: str) -> str:
        return f"(CASE WHEN abs({v}) < {tiny} THEN {tiny} ELSE {v} END)"

    (m0, h0), (m1, h1) = disc("0D"), disc("s.len")
    roots = (
        f"named_struct('m0', {m0}, 'h0', {h0}, 'm1', {m1}, 'h1', {h1}, 'p', (-{d} - s.b) / {safe('s.vb')}, 'q', ({d} - s.b) / {safe('s.vb')}, "
        f"'u', -s.a / {safe('s.va')}, 'w', (s.len - s.a) / {safe('s.va')})"
    )
    body_lo, body_hi = "greatest(least(k.p, k.q), least(k.u, k.w))", "least(greatest(k.p, k.q), greatest(k.u, k.w))"
    zone = (
        f"named_struct('lo', least(CASE WHEN k.h0 > 0D THEN k.m0 - sqrt(k.h0) END, CASE WHEN k.h1 > 0D THEN k.m1 - sqrt(k.h1) END, CASE WHEN {body_lo} < {body_hi} THEN {body_lo} END), "
        f"'hi', greatest(CASE WHEN k.h0 > 0D THEN k.m0 + sqrt(k.h0) END, CASE WHEN k.h1 > 0D THEN k.m1 + sqrt(k.h1) END, CASE WHEN {body_lo} < {body_hi} THEN {body_hi} END))"
    )
    kept = f"filter(transform({edges}, e -> {local}), s -> {near})"
    return f"filter(transform(transform({kept}, s -> {roots}), k -> {zone}), z -> z.lo IS NOT NULL)"


def gaps_sql(zones: str, t0: str, t1: str) -> str:
    """Parts of [t0, t1] in no zone: ``array<struct<lo, hi>>``, found by a sweep over the sorted zones."""
    gap = "named_struct('lo', {lo}, 'hi', {hi})"
    live = f"array_sort(filter({zones}, z -> z.hi > {t0} AND z.lo < {t1}))"
    start = f"named_struct('cur', {t0}, 'gaps', CAST(array() AS array<struct<lo:double,hi:double>>))"
    step = (
        f"named_struct('cur', greatest(acc.cur, z.hi), 'gaps', CASE WHEN z.lo > acc.cur THEN "
        f"array_append(acc.gaps, {gap.format(lo='acc.cur', hi='z.lo')}) ELSE acc.gaps END)"
    )
    end = f"CASE WHEN acc.cur < {t1} THEN array_append(acc.gaps, {gap.format(lo='acc.cur', hi=t1)}) ELSE acc.gaps END"
    return f"aggregate({live}, {start}, (acc, z) -> {step}, acc -> {end})"
