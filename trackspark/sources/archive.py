"""Compact track archive: zig-zag deltas in five-bit characters.

A track is stored as parts of consecutive points; its parts joined in order are the track's whole text. Tracks up to
one part long, the usual case, are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..plans.chunks import with_neighbors

# Precision of degrees and metres, character offset, continuation bit.
DEG_SCALE, Z_SCALE, OFFSET, MORE = 1e6, 1e1, 63, 32
GROUPS = 13  # five bits each: any 64-bit number
PART = 65_536
POINTS = "track_id bigint, seq int, lng double, lat double, ele double"


def _text(delta: Column) -> Column:
    """One signed number as characters, lowest five bits first."""
    v = F.when(delta < 0, -2 * delta - 1).otherwise(2 * delta)
    out = []
    for i in range(GROUPS):
        rest = F.shiftright(v, 5 * i)
        code = rest % 32 + F.when(rest >= 32, MORE).otherwise(0) + OFFSET
        out.append(F.char(code) if i == 0 else F.when(rest > 0, F.char(code)).otherwise(F.lit("")))
    return F.concat(*out)


def archive_tracks(points: DataFrame, part: int = PART) -> DataFrame:
    """``(track_id, part_no, first_seq, start_x, start_y, start_z, encoded)``; a missing height counts as 0."""
    z = F.coalesce(F.col("ele"), F.lit(0.0)) if "ele" in points.columns else F.lit(0.0)
    ints = points.select("track_id", "seq", half_up(F.col("lng") * DEG_SCALE).alias("x"), half_up(F.col("lat") * DEG_SCALE).alias("y"), half_up(z * Z_SCALE).alias("z"))
    near = with_neighbors(ints, "track_id", "seq", prev={"px": "x", "py": "y", "pz": "z"}, size=part)
    zero = F.lit(0).cast("bigint")
    texts = [_text(F.col(c) - F.coalesce(F.col("p" + c), zero)) for c in "xyz"]
    start = F.struct(*[F.coalesce(F.col("p" + c), zero).alias("start_" + c) for c in "xyz"])
    row = F.struct("seq", F.concat(*texts).alias("t"))
    out = near.groupBy("track_id", F.col("_chunk").alias("part_no")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.min("seq").alias("first_seq"), F.min_by(start, "seq").alias("s")
    )
    return out.select("track_id", "part_no", "first_seq", "s.*", F.array_join(F.transform("rows", lambda r: r["t"]), "").alias("encoded"))


def decode_text(text: str) -> np.ndarray:
    """Deltas of one encoded text as an (n, 3) array."""
    codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(np.int64) - OFFSET
    last = codes < MORE
    number = np.concatenate(([0], np.cumsum(last)[:-1]))
    first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    place = np.arange(len(codes)) - first[number]
    value = np.zeros(int(last.sum()), dtype=np.int64)
    np.add.at(value, number, (codes & 31) << (5 * place))
    return np.where(value & 1, ~(value >> 1), value >> 1).reshape(-1, 3)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            if not row["encoded"]:
                continue
            at = np.cumsum(decode_text(row["encoded"]), axis=0) + np.array([row["start_x"], row["start_y"], row["start_z"]])
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["track_id"])), pa.array((np.arange(n) + row["first_seq"]).astype(np.int32)),
                 pa.array(at[:, 0] / DEG_SCALE), pa.array(at[:, 1] / DEG_SCALE), pa.array(at[:, 2] / Z_SCALE)],
                names=["track_id", "seq", "lng", "lat", "ele"],
            )


def unarchive_tracks(archive: DataFrame) -> DataFrame:
    """Points back from archive parts; every part decodes on its own."""
    return archive.select("track_id", "first_seq", "start_x", "start_y", "start_z", "encoded").mapInArrow(_decode, POINTS)
