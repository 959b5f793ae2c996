"""Invariants and brute force for operators without a SQL form, on shapes made here."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumist.functions import color, settings
from vellumist.operators import curves, layers, palette, regions, skeleton, svg, tiles
from vellumist.plans import pipelines
from vellumist.streaming import jobs


def image(spark, rows, image_id=1, name="m"):
    cells = [(image_id, x, y, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(cells, f"image_id long, x int, y int, {name} int")


def disk(n, r):
    c = n / 2
    return [[(x + 0.5 - c) ** 2 + (y + 0.5 - c) ** 2 <= r * r for x in range(n)] for y in range(n)]


def spiral(n):
    grid, x, y, dx, dy = [[0] * n for _ in range(n)], 0, 0, 1, 0
    free = lambda a, b: 0 <= a < n and 0 <= b < n and not grid[b][a]
    grid[0][0] = 1
    while True:
        a, b = x + dx, y + dy
        ahead = (x + 2 * dx, y + 2 * dy)
        if not free(a, b) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead[1]][ahead[0]]):
            dx, dy = -dy, dx
            a, b = x + dx, y + dy
            if not free(a, b) or (0 <= x + 2 * dx < n and 0 <= y + 2 * dy < n and grid[y + 2 * dy][x + 2 * dx]):
                return grid
        x, y = a, b
        grid[y][x] = 1


def test_components_follow_a_spiral_and_partitions_do_not_matter(spark):
    m = image(spark, spiral(24))
    one = {(r.x, r.y): r.comp for r in regions.connected_components(m).collect()}
    assert {one[x, y] for x in range(24) for y in range(24) if spiral(24)[y][x]} == {0}
    assert one == {(r.x, r.y): r.comp for r in regions.connected_components(m.repartition(13)).collect()}


def test_published_color_differences(spark):
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, -1.0, 2.0), (50.0, 0.0, 0.0), 2.3669), ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)]
    row = spark.range(1).select(*[F.round(color.ciede2000(tuple(map(F.lit, a)), tuple(map(F.lit, b))), 4).alias(f"d{i}") for i, (a, b, _) in enumerate(pairs)]).first()
    assert list(row) == [d for _, _, d in pairs]


def test_hex_forms(spark):
    rows = spark.createDataFrame([("#fff",), ("A0b1C2",), ("#12345",), ("", ), (None,)], "t string").select(color.hex_parse(F.col("t")).alias("c")).collect()
    assert [tuple(r.c) if r.c else None for r in rows] == [(255, 255, 255), (160, 177, 194), None, None, None]


def test_thinning_keeps_connection_and_chamfer_grows_inward(spark):
    # The published method erases a 2 x 2 block, which is all that is left of a disk of even size; a bar of odd width keeps its middle.
    bar = image(spark, [[3 <= x < 22 and 2 <= y < 7 for x in range(25)] for y in range(9)])
    thin = skeleton.thin(bar)
    ink = [(r.x, r.y) for r in thin.collect() if r.m]
    assert 10 <= len(ink) <= 19 and {y for _, y in ink} <= {3, 4, 5}
    m = image(spark, disk(20, 8))
    comps = regions.connected_components(thin, diagonal=True).filter("m = 1").select("comp").distinct().count()
    assert comps == 1
    d = {(r.x, r.y): r.d for r in skeleton.chamfer(m).collect()}
    assert d[10, 10] == max(d.values()) and abs(d[10, 10] - 8) < 1 and d[0, 0] == 0


def test_rings_hold_the_ink(spark):
    rows = disk(16, 6)
    rows[8][8] = rows[8][7] = False
    got = sorted((r.area, r.length) for r in curves.rings(layers.crack_edges(image(spark, rows))).collect())
    assert got[0] == (-2.0, 6) and sum(a for a, _ in got) == sum(map(sum, rows))
    assert pipelines.ring_paths(curves.rings(layers.crack_edges(image(spark, [[1]])))).first().d == "M0 0L1 0L1 1L0 1Z"


def test_simplified_line_stays_within_tolerance():
    rng = np.random.default_rng(3)
    p = np.column_stack([np.arange(400.0), np.cumsum(rng.normal(size=400))])
    keep = curves.simplified(p, 2.0)
    assert 2 < len(keep) < 200 and keep[0] == 0 and keep[-1] == 399
    for i, j in zip(keep, keep[1:]):
        assert curves._distance(p[i : j + 1], p[i], p[j]).max() <= 2.0
    assert curves.simplified(p[:1], 1).tolist() == [0] and len(curves.simplified(p[:0], 1)) == 0


def test_cubic_pieces_join_and_stay_near():
    t = np.linspace(0, np.pi, 80)
    p = np.column_stack([50 * np.cos(t), 50 * np.sin(t)])
    pieces = curves.fit_cubics(p, 0.2)
    assert 1 <= len(pieces) <= 6
    assert all(np.allclose(a[3], b[0]) for a, b in zip(pieces, pieces[1:])) and np.allclose(pieces[0][0], p[0]) and np.allclose(pieces[-1][3], p[-1])
    u = np.linspace(0, 1, 50)[:, None]
    for c in pieces:
        q = (1 - u) ** 3 * c[0] + 3 * u * (1 - u) ** 2 * c[1] + 3 * u**2 * (1 - u) * c[2] + u**3 * c[3]
        assert np.abs(np.hypot(*q.T) - 50).max() < 0.5


def test_kmeans_finds_separated_colors(spark):
    rng = random.Random(1)
    cells = [(1, i % 20, i // 20, *[max(0, min(255, v + rng.randint(-6, 6))) for v in ((200, 30, 30), (30, 200, 30), (30, 30, 200))[i % 3]]) for i in range(400)]
    px = spark.createDataFrame(cells, "image_id long, x int, y int, r int, g int, b int")
    centers = palette.kmeans(px, [(150, 100, 100), (100, 150, 100), (100, 100, 150), (0, 0, 0)])
    assert all(abs(a - b) < 4 for c, want in zip(centers, ((200, 30, 30), (30, 200, 30), (30, 30, 200))) for a, b in zip(c, want)) and centers[3] == (0, 0, 0)
    with pytest.raises(ValueError):
        palette.kmeans(px, [])


def test_merge_leaves_no_small_region(spark):
    rng = random.Random(4)
    m = image(spark, [[rng.randint(0, 2) for _ in range(12)] for _ in range(12)])
    areas = regions.component_shape(regions.connected_components(regions.merge_small(m, 3))).select("area").collect()
    assert min(r.area for r in areas) >= 3


def test_color_layers_merge_beyond_two_rounds(spark):
    colors = [(255, 0, 0), (0, 255, 0), (0, 0, 255)]
    cells = [2, 0, 2, 1, 1, 2, 0, 2, 0, 1, 0, 0, 0, 2, 2, 0]  # two labels are left after two rounds, one after three
    px = spark.createDataFrame([(1, i % 4, i // 4, *colors[c]) for i, c in enumerate(cells)], "image_id long, x int, y int, r int, g int, b int")
    labels = palette.quantize_fixed(px, colors).withColumnRenamed("label", "m")
    assert [regions.merge_small(labels, 4, rounds=n).select("m").distinct().count() for n in (2, 3)] == [2, 1]
    assert str(pipelines.color_layers(px, colors, 4, 4, 4).first()).count("<path") == 1


def test_numbers_in_paths(spark):
    values = [0.0, -0.0, 0.5, -0.25, 12.0, 12.3, -7.126, 0.004, -0.004]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(svg.number(F.col("v")).alias("t")).collect()]
    assert got == ["0", "0", ".5", "-.25", "12", "12.3", "-7.13", "0", "0"]


def test_settings_round_trip_and_bad_documents(spark):
    docs = spark.createDataFrame([(1, '{"paletteSize": 99.6, "denoise": "x", "invert": true}'), (2, "not json"), (3, None)], "id int, settings string")
    rows = settings.normalize(docs, keep=("id",))
    by = {r.id: r for r in rows.collect()}
    assert (by[1].paletteSize, by[1].denoise, by[1].invert) == (64, "none", True)
    assert by[2].paletteSize == by[3].paletteSize == 16 and by[2].maxDimension == 1600
    back = {r.id: json.loads(r.settings) for r in settings.document(rows, keep=("id",)).collect()}
    assert back[1]["paletteSize"] == 64 and back[1]["version"] == 1
    assert settings.profile_patch("stencil")["minRegionArea"] == 64


def test_job_feed_newest_request_wins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed = [{"image_id": i % 3, "request": i, "at": f"2024-01-01T00:{i:02d}:00", "settings": "{}"} for i in range(6)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, feed)))
    px = image(spark, disk(8, 3), 0).unionByName(image(spark, disk(8, 2), 2))
    stream = jobs.run(jobs.read_jobs(spark, str(tmp_path / "in")), px, lambda p: p.groupBy("image_id").agg(F.sum("m").alias("ink")), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream.awaitTermination(120)
    got = {r.image_id: (r.request, r.ink) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (3, sum(map(sum, disk(8, 3)))), 2: (5, sum(map(sum, disk(8, 2))))}


def test_components_of_wide_and_tall_images(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [[rng.random() < 0.55 for _ in range(30)] for _ in range(40)]
    for diagonal in (False, True):
        whole = {(r.x, r.y): r.comp for r in regions.connected_components(image(spark, rows), diagonal=diagonal).collect()}
        monkeypatch.setattr(regions, "STRIP", 3)
        strips = {(r.x, r.y): r.comp for r in regions.connected_components(image(spark, rows), diagonal=diagonal).collect()}
        monkeypatch.undo()
        assert whole == strips
        for (x, y), c in whole.items():
            near = [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
            assert all(whole[p] == c for p in near if p in whole and rows[p[1]][p[0]] == rows[y][x])
    wide = spark.createDataFrame([(0, 4096, 0, 1), (0, 0, 1, 1), (0, 5000, 0, 1), (0, 5001, 0, 1)], "image_id long, x int, y int, m int")
    assert len({r.comp for r in regions.connected_components(wide).collect()}) == 3


def test_tiles_hold_their_pixels_and_are_never_broadcast(spark):
    pixels = image(spark, [[(7 * x + 13 * y) % 256 for x in range(23)] for y in range(17)], name="g")
    plan = tiles.plan(spark.createDataFrame([(1, 23, 17)], "image_id long, width int, height int"), 9, 4)
    boxes = [(t.tx, t.ty, t.w, t.h) for t in plan.collect()]
    wanted = sorted((x, y, *b, (7 * x + 13 * y) % 256) for b in boxes for x in range(b[0], b[0] + b[2]) for y in range(b[1], b[1] + b[3]))
    for side in (1, 4, 64):
        cells = tiles.cut(pixels, plan, side=side)
        assert sorted((r.x, r.y, r.tx, r.ty, r.w, r.h, r.g) for r in cells.collect()) == wanted
        back = tiles.stitch(cells)
        rows = back.collect()
        assert len(rows) == 23 * 17 and all(abs(r.v - (7 * r.x + 13 * r.y) % 256) < 1e-9 for r in rows)
        assert "Broadcast" not in back._jdf.queryExecution().executedPlan().toString()
    bare = tiles.cut(pixels, plan).drop("bx", "by")
    assert tiles.stitch(bare).count() == 23 * 17
