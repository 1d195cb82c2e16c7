"""Rasters as bands, lookups by index, text files in byte ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import elevation
from trackspark.sources import dem, messages


@pytest.fixture
def rasters(tmp_path):
    rng = np.random.default_rng(1)
    grids = {}
    for name, n in (("N50E014", 70), ("N51E014", 2), ("S01W002", 5000)):
        grid = rng.integers(-400, 8000, (n, n)).astype(">i2")
        grid[rng.random((n, n)) < 0.05] = dem.VOID
        (tmp_path / f"{name}.hgt").write_bytes(grid.tobytes())
        grids[name] = grid.astype(int)
    (tmp_path / "N52E014.hgt").write_bytes(b"12345")
    return grids


def plain_height(grid, lat, lng):
    n = len(grid)
    row, col = (np.floor(lat) + 1 - lat) * (n - 1), (lng - np.floor(lng)) * (n - 1)
    r, c = int(np.floor(row)), int(np.floor(col))
    h = [[grid[min(n - 1, r + i)][min(n - 1, c + j)] for j in (0, 1)] for i in (0, 1)]
    mix = lambda a, b, f: b if a is None else a if b is None else a + (b - a) * f
    h = [[None if x == dem.VOID else float(x) for x in line] for line in h]
    value = mix(mix(*h[0], col - c), mix(*h[1], col - c), row - r)
    return 0.0 if value is None else value


def test_bands_give_the_heights_of_the_grid(spark, tmp_path, rasters):
    rng = np.random.default_rng(2)
    where = [(50 + a, 14 + b) for a, b in rng.random((200, 2))] + [(-1 + a, -2 + b) for a, b in rng.random((200, 2))] + [(51.5, 14.5), (50.0, 14.0), (50.9999999, 14.9999999), (10.5, 10.5)]
    points = spark.createDataFrame([(i, float(b), float(a)) for i, (a, b) in enumerate(where)], "i int, lng double, lat double")
    bands = dem.read_hgt_bands(spark, str(tmp_path))
    got = {r.i: r.ele for r in elevation.sample_dem(points, bands).collect()}
    names = {(50, 14): "N50E014", (51, 14): "N51E014", (-1, -2): "S01W002"}
    for i, (lat, lng) in enumerate(where):
        key = (int(np.floor(lat)), int(np.floor(lng)))
        assert got[i] == pytest.approx(plain_height(rasters[names[key]], lat, lng) if key in names else 0.0, abs=1e-6)
    small = bands.where("tile_lat >= 50")
    cells = dem.read_hgt(spark, str(tmp_path), spark.createDataFrame([(50, 14), (51, 14), (7, 7)], "tile_lat int, tile_lng int"))
    assert cells.count() == 70 * 70 + 4
    again = dem.bands_of_cells(cells)
    key = lambda df: {(r.tile_lat, r.band): (r.n, r.first_row, r.heights) for r in df.collect()}
    assert key(again) == key(small)


def test_one_tile_opens_one_file(spark, tmp_path, rasters):
    one = dem.raster_files(spark, str(tmp_path), spark.createDataFrame([(50, 14)], "tile_lat int, tile_lng int"))
    assert [f.rsplit("/", 1)[1] for f in one.inputFiles()] == ["N50E014.hgt"]
    assert dem.read_hgt_bands(spark, str(tmp_path), spark.createDataFrame([], "tile_lat int, tile_lng int")).count() == 0


def test_unasked_bands_are_not_joined(spark, tmp_path, rasters):
    bands = dem.read_hgt_bands(spark, str(tmp_path))
    points = spark.createDataFrame([(1, 14.5, 50.5)], "i int, lng double, lat double")
    plan = elevation.sample_dem(points, bands)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftOuter") < plan.index("LeftSemi")


def test_long_files_are_numbered_across_byte_ranges(spark, tmp_path):
    head = "\t".join(["h"] * 13)
    long = lambda i: "\t".join([str(i), str(2 * i), "0", "7", *"12345", "highway=path", *"678"])
    (tmp_path / "5.tsv").write_text("\r\n".join([head, *map(long, range(1, 3001))]) + "\r\n")
    (tmp_path / "6.tsv").write_text("\n".join([head, long(1), "", "short\trow", long(4)]))
    (tmp_path / "notes.txt").write_text("a\nb")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = messages.read_messages(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted((r.track_id, r.row_no, r.key_lng, r.key_lat, r.dist_m) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(5, i, i, 2 * i, 7) for i in range(1, 3001)] + [(6, 1, 1, 2, 7), (6, 4, 4, 8, 7)]
    assert {r.track_id for r in messages.read_messages(spark, str(tmp_path), tracks=[6]).collect()} == {6}
    assert rows.where(F.col("way_tags") != "highway=path").count() == 0


def test_bands_of_cells_with_gaps_and_carried_columns(spark):
    """Cells with some missing become bands as the raster itself; whole-number columns of the files come along."""
    import numpy as np

    n = 70
    grid = np.arange(n * n, dtype=">i2").reshape(n, n)
    grid[3, 5] = grid[58, 0] = dem.VOID
    files = spark.createDataFrame([("N50E014.hgt", bytearray(grid.tobytes()), 7)], "name string, content binary, survey long")
    cells = dem.decode_rasters(files, ["survey"])
    assert {r.survey for r in cells.select("survey").distinct().collect()} == {7}
    bands = dem.bands_of_cells(cells.where("ele IS NOT NULL"))
    assert "FlatMapGroupsInArrow" in bands._jdf.queryExecution().toString()
    assert sorted(bands.collect()) == sorted(dem.decode_bands(files, ["survey"]).drop("survey").collect())
