"""Properties of the raster operators, and agreement of their long form with the NumPy kernels."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from rastra.functions import kernels, training
from rastra.functions import tile_kernels as tk
from rastra.operators import histogram, model, raster, tables, tiles
from rastra.plans import QUERIES, SQL, cascade, jobs
from rastra.plans.tile_queries import dense
from rastra.sources import images
from rastra.sources.fixtures import labels, px


def frame(spark, *arrays):
    rows = [(n, y, x, int(a[y, x])) for n, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, row long, col long, v long")


def array(df, value="v", image=0):
    rows = df.filter(F.col("image_id") == image).collect()
    y0, x0 = min(r.row for r in rows), min(r.col for r in rows)
    out = np.full((max(r.row for r in rows) - y0 + 1, max(r.col for r in rows) - x0 + 1), np.nan)
    for r in rows:
        assert np.isnan(out[r.row - y0, r.col - x0])
        out[r.row - y0, r.col - x0] = r[value]
    return out


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(3)
    return rng.integers(0, 256, (21, 34)), rng.integers(0, 256, (18, 18))


def test_pad_and_crop(spark, pair):
    df = frame(spark, *pair)
    assert (array(raster.pad(df, 7), image=1) == np.pad(pair[1], 7, "symmetric")).all()
    assert (array(raster.pad(df, 3, "replicate")) == np.pad(pair[0], 3, "edge")).all()
    back = raster.crop(raster.pad_zero(df, 2, 3, 1, 4), 2, 3, 1, 4)
    assert (array(back) == pair[0]).all()


def test_convolution_and_features_match_numpy(spark, pair):
    df = frame(spark, *pair)
    got = array(raster.correlate(df, {"s": kernels.gaussian()}, "replicate"), "s")
    assert np.allclose(got, tk.correlate(pair[0].astype(float), tk._dense(kernels.gaussian())[None], "edge")[0])
    haar = raster.haar(df)
    want = tk.haar(pair[0]).reshape(*pair[0].shape, 2)
    assert np.allclose(array(haar, "hx"), want[:, :, 0]) and np.allclose(array(haar, "hy"), want[:, :, 1])
    assert (array(raster.downsample(df)) == tk.downsample(pair[0])).all()
    assert (array(raster.downsample(df, 2), image=1) == tk.downsample(tk.downsample(pair[1]))).all()


def test_pyramid(spark, pair):
    df = frame(spark, *pair)
    pooled = raster.maxpool(df, 1)
    assert (array(pooled) == tk.maxpool(pair[0])).all()
    up = array(raster.upsample(pooled, 1, *pair[0].shape))
    assert (up >= pair[0]).all() and up.shape == pair[0].shape
    assert histogram.histogram(df).agg(F.sum("n")).first()[0] == sum(a.size for a in pair)


def test_tiles_hold_halo_and_merge_to_the_image(spark, pair):
    df = frame(spark, *pair)
    grid = tiles.Grid(12, 14, 2, 3)
    blocks = grid.blocks(df).collect()
    for b in blocks:
        img = pair[b.image_id]
        h, w = (-(-n // s) * s for n, s in zip(img.shape, (grid.step_h, grid.step_w), strict=True))
        full = np.pad(img, ((2, h - img.shape[0] + 2), (3, w - img.shape[1] + 3)), "symmetric")
        y, x = (b.tile_row - 1) * grid.step_h, (b.tile_col - 1) * grid.step_w
        assert (np.array(b.data).reshape(12, 14) == full[y : y + 12, x : x + 14]).all()
    assert len(blocks) == 3 * 5 + 3 * 3
    kept = grid.selected(df, spark.createDataFrame([(1, 1), (1, 1), (99, 99)], "tile_row long, tile_col long"))
    assert kept.count() == 2 * grid.step_h * grid.step_w
    assert set(map(tuple, kept.collect())) <= set(map(tuple, grid.needed(grid.assign(df).select(*kept.columns), [(1, 1)]).collect()))
    with pytest.raises(ValueError):
        tiles.Grid(10, 10, 5, 1)


def test_local_features_do_not_depend_on_tiles(spark, pair):
    df = frame(spark, pair[0])
    got = {(r.row, r.col): r.f for r in dense(df, ("haar",), tiles.Grid(26, 26, 8, 8)).collect()}
    want = tk.haar(pair[0])
    assert np.allclose([got[divmod(i, pair[0].shape[1])] for i in range(len(want))], want)


@pytest.mark.parametrize("name", ["op_hog", "op_filterbank_width"])
def test_images_that_lack_lines_are_as_in_sql(spark, tmp_path, name):
    """The last image has 6 lines, 1 or 49, and one has holes, as when a table has no multiple of 50 rows."""
    ids = [v for v in range(250) if v not in (60, 61, 75, 99) and not 106 <= v < 150 and not 151 <= v < 200 and v != 249]
    rng = np.random.default_rng(4)
    rows = [(v, rng.normal(0, 0.3, 64).tolist(), 0) for v in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    same_rows(QUERIES[name](spark, str(tmp_path)), con, SQL[name])


def test_blocks_of_images_smaller_than_the_border(spark):
    """Reflections are reflected again, as numpy.pad does."""
    img = np.random.default_rng(5).integers(0, 256, (3, 17))
    grid = tiles.Grid(26, 26, 5, 5)
    blocks = grid.blocks(frame(spark, img)).collect()
    full = np.pad(img, ((5, 18), (5, 20)), "symmetric")
    assert len(blocks) == 2 and all(b["at"] is None for b in blocks)
    for b in blocks:
        x = (b.tile_col - 1) * 16
        assert (grid.block(b.asDict()) == full[:26, x : x + 26]).all()
    got = {(r.row, r.col): r.f for r in dense(frame(spark, img), ("gabor",)).collect()}
    assert set(got) == {divmod(i, 17) for i in range(3 * 17)}


def test_widths():
    img = np.arange(400).reshape(20, 20) % 256
    widths = {n: f(img).shape for n, f in tk.EXTRACTORS.items()}
    assert {n: s[1] for n, s in widths.items()} == {"haar": 2, "hog": 36, "edge": 49, "gabor": 180, "sift": 128, "intensity": 81}
    assert tk.filter_bank(img).shape == (400, 476) and tk.context(img / 255).shape == (400, 57)
    assert np.isfinite(tk.filter_bank(np.zeros((16, 16)))).all()


def test_hog_of_one_window_by_hand():
    img = np.random.default_rng(8).integers(0, 256, (15, 15))
    f = tk.hog(img)[7 * 15 + 7]
    p = np.pad(img / 255.0, 1)
    votes = np.zeros((4, 4, 9))
    for y in range(15):
        for x in range(15):
            dx, dy = p[y + 1, x + 2] - p[y + 1, x], p[y, x + 1] - p[y + 2, x + 1]
            turn = np.arctan2(dy, dx) % np.pi / (np.pi / 9)
            # each pixel shares its vote among the two nearest centres along y, x and the angle
            for cy in range(4):
                for cx in range(4):
                    for b in range(-1, 10):
                        near = [1 - abs(y + 0.5 - 8 * cy + 4) / 8, 1 - abs(x + 0.5 - 8 * cx + 4) / 8, 1 - abs(turn - b - 0.5)]
                        if min(near) > 0:
                            votes[cy, cx, b % 9] += np.hypot(dx, dy) * np.prod(near)
    block = votes[1:3, 1:3].ravel()
    block = np.minimum(block / np.sqrt((block**2).sum()), 0.2)
    assert np.allclose(f, block / np.sqrt((block**2).sum()))


def test_gabor_energies_are_those_of_whole_kernels():
    img = np.random.default_rng(9).integers(0, 256, (21, 24)).astype(float)
    got = tk.gabor(img)
    for at, (sigma, theta, length) in enumerate(kernels.gabor_bank()):
        if at % 17 == 0:
            pair = [tk._levels(tk.correlate(img, tk._dense(kernels.gabor(sigma, theta, length, p))[None], "symmetric")[0]) / 255 for p in (0.0, np.pi / 2)]
            assert np.allclose(got[:, at], np.hypot(*pair).ravel())


# fixed values: golden tile counts and batches
@pytest.mark.parametrize(
    ("w", "h", "bw", "bh", "want"),
    [(600, 400, 200, 100, (3, 4)), (600, 400, 199, 99, (4, 5)), (600, 400, 201, 101, (3, 4)), (15500, 12000, 875, 675, (18, 18)), (0, 400, 200, 100, (None, None))],
)
def test_tile_count(spark, w, h, bw, bh, want):
    a, b = tiles.tile_count(*(F.lit(x) for x in (w, h, bw, bh)))
    assert tuple(spark.range(1).select(a, b).first()) == want


def test_batches(spark):
    grid = spark.createDataFrame([("a", 2, 3)], "image string, tiles_w long, tiles_h long")
    got = [r.tiles for r in tables.task_batches(grid, 5).orderBy("batch").collect()]
    assert got == ["-t 2,3 -t 2,2 -t 2,1 -t 1,3 -t 1,2", "-t 1,1"]


def test_parsers(spark):
    sizes = spark.createDataFrame([("200x100",), ("7",), ("x3",), ("-1x2",), ("",)], "t string").select(*tables.parse_size(F.col("t"))).collect()
    assert [tuple(r) for r in sizes] == [(100, 200), (7, 7), (None, None), (None, None), (None, None)]
    texts = ["true", "t", "false", "f", "3", "-5.5", "[2 4]", "[2 4;5,-1]", "word"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(*tables.parse_literal(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [
        ("logical", "1"), ("logical", "1"), ("logical", "0"), ("logical", "0"), ("number", "3.000"), ("number", "-5.500"),
        ("matrix", "2.000 4.000"), ("matrix", "2.000 4.000;5.000 -1.000"), ("text", "word"),
    ]
    logs = spark.createDataFrame([(None,), ("",), ("x Exit Code: 0",), ("x Exit Code: 255",)], "t string")
    assert [r[0] for r in logs.select(tables.exit_status(F.col("t"))).collect()] == [12, 13, 0, 14]


def test_jobs_retry(spark):
    tasks = spark.createDataFrame([(i,) for i in range(5)], "task_id long")
    code, left = jobs.run_tasks(tasks, lambda t, n: t.filter(F.col("task_id") < 2 * n))
    assert code == jobs.DONE and left.count() == 0
    code, left = jobs.run_tasks(tasks, lambda t, n: t.filter("task_id < 3"), max_tries=2)
    assert code == jobs.RETRIES_EXCEEDED and sorted(r.task_id for r in left.collect()) == [3, 4]


def test_images(spark, tmp_path, pair):
    for i, a in enumerate((pair[0], pair[1], pair[0])):
        (tmp_path / f"s{i + 8:03d}.{'PNG' if i else 'png'}").write_bytes(images.encode_png(a))
    (tmp_path / "note.txt").write_text("x")
    names = lambda spec: [r.path.rpartition("/")[2] for r in images.expand(spark, spec).collect()]
    assert names(str(tmp_path)) == ["s008.png", "s009.PNG", "s010.PNG"]
    assert names(f"{tmp_path}/s###.PNG;8-30") == ["s009.PNG", "s010.PNG"] and names(f"{tmp_path}/s###.PNG;9-8") == []
    assert names(f"{tmp_path}/*8*") == ["s008.png"] and names(f"{tmp_path}/none") == []
    assert names(f"{tmp_path}/s008.png,{tmp_path}/*.png,{tmp_path}/gone") == ["s008.png", "s009.PNG", "s010.PNG"]
    assert names([f"{tmp_path}/s008.png", f"{tmp_path}/gone"]) == ["s008.png"]
    with pytest.raises(TypeError):
        images.expand(spark, 3)
    scanned = images.scan(spark, images.expand(spark, f"{tmp_path}/s008.png")).withColumn("image_id", F.lit(0))
    assert (array(scanned) == pair[0]).all()
    png = images.encoded(frame(spark, *pair)).filter("image_id = 1").first().png
    assert (images.decode_png(bytes(png)) == pair[1]).all() and images.png_size(bytes(png)) == pair[1].shape


def test_gradient_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(30, 6)), rng.integers(0, 2, 30), rng.normal(size=(6, 7))
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(30)], "id long, f array<double>, y int")
    net = spark.createDataFrame([(k // 3, k % 3, w[k, :-1].tolist(), float(w[k, -1])) for k in range(6)], "g int, d int, w array<double>, b double")
    got = np.zeros((6, 7))
    for r in model.gradient(rows, net).collect():
        got[r.g * 3 + r.d, r.i] = r.s
    x1 = np.concatenate([x, np.ones((30, 1))], axis=1)
    assert np.allclose(got, training._terms(x1, y, w, 2)[0].T @ x1)
    for root in (False, True):
        p = [r.p for r in model.and_or(rows, net, root).orderBy("id").collect()]
        assert np.allclose(p, tk.and_or(x, w, 2, root))


def test_training_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = (np.abs(x).sum(axis=1) < 1).astype(float)
    # dropout leaves half of the units, so it needs more of them
    for fit, groups, units, root in ((training.fit_batches, 3, 4, False), (training.fit_dropout, 12, 12, True)):
        w, errors = fit(x, y, training.Rates(0.05, 0.5, 30, groups, units))
        assert errors[-1] < errors[0]
        # the dropout network's outputs are pressed together, so it is their order that counts
        assert np.corrcoef(tk.and_or(x, w, groups, root), y)[0, 1] > 0.6


def test_cascade_restarts(spark, data, tmp_path):
    pixels = px(spark, data).filter("image_id < 2")
    param = cascade.Param(2, 1, ("haar",), 2000, {"epochs": 1, "groups": 2, "units": 2})
    folder = f"file://{tmp_path}/model"
    first = cascade.fit(labels(pixels), param, folder)
    again = cascade.fit(labels(pixels), param, folder, restart=True)
    assert list(first) == [(1, 0), (1, 1), (2, 0)]
    assert all((first[k].weights == again[k].weights).all() for k in first)
    out = cascade.predict(pixels, again, param, tiles.Grid(42, 42, 5, 5))
    lo, hi, n, m = out.agg(F.min("p"), F.max("p"), F.count("*"), F.count_distinct("image_id", "row", "col")).first()
    assert 0 <= lo <= hi <= 1 and n == m == 2 * 50 * 64
    assert first[2, 0].weights.shape[1] == 2 + 57 * 2 + 1


def test_streaming(spark, data, tmp_path):
    from rastra.streaming.predict import predict_stream

    pixels = px(spark, data).filter("image_id = 0")
    param = cascade.Param(1, 0, ("haar",))
    net = {(1, 0): cascade.Net(np.zeros((200, 3)), 10)}
    pixels.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    q = predict_stream(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/check", net, param, tiles.Grid(26, 26, 5, 5))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/batch=0").count() == 3200


def test_kmeans(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    got = model.nearest(rows, model.kmeans(rows, 3)).agg(F.sum("d2")).first()[0]
    assert got < 200
    assert model.kmeans_step(rows, spark.createDataFrame([(0, [0.0, 0.0]), (1, [99.0, 99.0])], "k int, m array<double>")).filter("k = 1").first().m == [0.0, 0.0]


def test_kmeans_from_coarse_to_fine(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, (200, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    assert training.nested_sizes(600, 50) == [67, 200, 600] and training.nested_sizes(40, 50) == [40]
    centres = training.coarse_to_fine(x, 3, np.random.default_rng(1))
    assert sorted(np.round(centres).tolist()) == [[0, 0], [0, 5], [5, 5]]
    # a centre without rows: equal rows have one centre for all, and the tries end
    same = training.coarse_to_fine(np.ones((60, 2)), 2, np.random.default_rng(1))
    assert same.shape == (2, 2) and [1, 1] in same.tolist()
    assert training.coarse_to_fine(np.array([[1.0, 2.0]]), 3, np.random.default_rng(1)).shape == (3, 2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    assert sorted(np.round([r.m for r in model.kmeans(rows, 3).collect()]).tolist()) == [[0, 0], [0, 5], [5, 5]]
    assert model.kmeans(rows.limit(0), 3).count() == 0


def test_batches_are_counted_in_each_pass():
    """130 rows: one update a pass; the 30 left over go into the next pass's update beside its first 100."""
    rng = np.random.default_rng(7)
    x, rates = rng.normal(size=(130, 3)), training.Rates(0.1, 0.5, 3, 2, 2)
    y = (x[:, 0] > 0).astype(float)
    got, errors = training.fit_batches(x, y, rates)
    again = np.random.default_rng(rates.seed)
    w = training.initial(x, y, rates, again)
    x1 = np.concatenate([x, np.ones((130, 1))], axis=1)
    rest, speed = np.zeros_like(w), np.zeros_like(w)
    sums = lambda rows: training._terms(x1[rows], y[rows], w, 2)[0].T @ x1[rows]
    for _ in range(3):
        order = again.permutation(130)
        speed = rest + sums(order[:100]) + 0.5 * speed
        w = w + 0.1 * speed
        rest = sums(order[100:])
    assert np.allclose(got, w) and len(errors) == 3


def test_places_of_any_values(spark):
    """Shared prefixes, repeats, nulls, wide numbers and clashing columns; ranges hold no more than their part."""
    from rastra.operators import ranges

    paths = spark.createDataFrame([(f"file:/data/{i:05d}", i) for i in range(3000)], "path string, __range int").repartition(5)
    got = tables.placed(paths, "path")
    assert got.columns == ["path", "__range", "place"] and all(r.place == r["__range"] for r in got.collect())
    starts = ranges.range_starts(paths, ["path"], 8)
    sizes = [r["count"] for r in paths.groupBy(ranges.range_of(paths, ["path"], starts).alias("k")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 3000 / 8
    values = [None, None, -(2**63), 2**63 - 1, 5, 5, 5, 0]
    rows = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values * 40)], "c int, v long")
    found = ranges.ranked(rows, ["v"], ["c"], ranges=6).collect()
    for c in (0, 1):
        own = sorted((r.place, r.v) for r in found if r.c == c)
        assert [p for p, _ in own] == list(range(160))
        assert [v for _, v in own] == sorted((v for k, v in enumerate(values * 40) if k % 2 == c), key=lambda v: (v is not None, v or 0))
    assert ranges.ranked(rows.limit(0), ["v"]).count() == 0
    with pytest.raises(ValueError, match="pair"):
        tables.zip_join(paths.select("path"), paths.select("path").limit(3), "path")
    zipped = tables.zip_join(paths.select("path"), paths.select(F.concat("path", F.lit("l")).alias("path")), "path")
    assert zipped.filter("concat(path, 'l') = path_2").count() == 3000


def test_png_files(spark, tmp_path):
    """Strips of large images, names, sizes by header alone, and functions applied to each image."""
    import zlib

    rng = np.random.default_rng(8)
    imgs = [rng.integers(0, 256, (150, 70)), rng.integers(0, 256, (64, 3)), rng.integers(0, 256, (1, 1))]
    names = spark.createDataFrame([(0, "b.png"), (1, "a.png"), (2, "C.PNG")], "image_id long, name string")
    folder = f"file://{tmp_path}/out"
    done = images.write(frame(spark, *imgs), names, folder)
    assert done.count() == 3
    for n, name in ((0, "b.png"), (1, "a.png"), (2, "C.PNG")):
        data = (tmp_path / "out" / name).read_bytes()
        assert (images.decode_png(data) == imgs[n]).all() and (images.decode_png(images.encode_png(imgs[n])) == imgs[n]).all()
        at = data.index(b"IDAT") + 4
        z = zlib.decompressobj()  # checks the joined checksum
        assert len(z.decompress(data[at : at + int.from_bytes(data[at - 8 : at - 4], "big")])) == imgs[n].size + len(imgs[n]) and z.eof
    assert {r.path.rpartition("/")[2] for r in images.png_files(spark, folder).collect()} == {"a.png", "b.png"}
    sizes = {r.path.rpartition("/")[2]: (r.h, r.w) for r in images.sizes(spark, images.expand(spark, folder)).collect()}
    assert sizes == {"b.png": (150, 70), "a.png": (64, 3), "C.PNG": (1, 1)}
    assert images.first_size(spark, folder) == (64, 3) and images.first_size(spark, f"file://{tmp_path}/none") is None
    images.transform(spark, images.png_files(spark, folder), lambda img: 255 - img, f"file://{tmp_path}/changed")
    assert (images.decode_png((tmp_path / "changed" / "a.png").read_bytes()) == 255 - imgs[1]).all()
    sparse = spark.createDataFrame([(5, 130, 2, 300)], "image_id long, row long, col long, v long")
    img = images.decode_png(bytes(images.encoded(sparse).first().png))
    assert img.shape == (131, 3) and img[130, 2] == 255 and img.sum() == 255


def test_merged_files(spark, tmp_path):
    rng = np.random.default_rng(10)
    imgs = [rng.integers(0, 200, (70, 20)) for _ in range(3)]
    names = spark.createDataFrame([(k, f"t{k}.png") for k in range(3)], "image_id long, name string")
    base = f"file://{tmp_path}"
    images.write(frame(spark, *imgs), names, f"{base}/a.tiles")
    read = lambda name: images.decode_png((tmp_path / "out" / name).read_bytes())
    images.merge(spark, images.expand(spark, f"{base}/a.tiles"), "all.png", f"{base}/out")
    assert (read("all.png") == np.minimum(255, sum(imgs))).all()
    images.merge(spark, images.expand(spark, f"{base}/a.tiles/t1.png"), "one.png", f"{base}/out")
    assert (read("one.png") == imgs[1]).all()
    with pytest.raises(ValueError, match="no tiles"):
        images.merge(spark, images.expand(spark, f"{base}/none"), "x.png", f"{base}/out")
    images.write(frame(spark, imgs[0][:5]), names.limit(1).select("image_id", F.lit("short.png").alias("name")), f"{base}/a.tiles")
    with pytest.raises(ValueError, match="sizes"):
        images.merge(spark, images.expand(spark, f"{base}/a.tiles"), "x.png", f"{base}/out")


def test_training_status_and_bins(spark, pair):
    rows = spark.createDataFrame([("x", True, 0), ("", True, 0), (None, True, 0), ("x", False, 0), ("x", True, None), ("x", True, 3)], "log string, model boolean, code int")
    got = [r.s for r in rows.select(tables.training_status(F.col("log"), F.col("model"), F.col("code")).alias("s")).collect()]
    assert got == [0, 1, 1, 2, 3, 4]
    assert tables.largest_stage(rows.select(F.lit("MODEL_level0_stage12.mat").alias("name"))).first().nstage == 12
    df = frame(spark, pair[0])
    levels = {r.v for r in histogram.equalize(df, 64).collect()}
    assert len(levels) <= 64 and levels <= {int(k * 255 / 63 + 0.5) for k in range(64)} and max(levels) == 255


def test_text_files(spark, tmp_path):
    from rastra.sources import text_files as t

    base = f"file://{tmp_path}"
    counts = spark.createDataFrame([(2, 7), (0, 5), (1, 0)], "level int, n long")
    assert t.write_histogram(counts, f"{base}/h.txt") == ["5", "0", "7"]
    assert sorted(map(tuple, t.read_histogram(spark, f"{base}/h.txt").collect())) == [(0, 5), (1, 0), (2, 7)]
    (tmp_path / "p").write_text("# note\nmax.retries=3\n\nopts=-limit 4gb -define a=/b\ntool.dir=/foo\nempty=\n")
    p = t.read_properties(spark, f"{base}/p")
    assert p == {"max.retries": "3", "opts": "-limit 4gb -define a=/b", "tool.dir": "/foo", "empty": ""}
    assert t.command(p, "tool.dir", "convert") == "/foo/convert" and t.command(p, "empty", "convert") == "convert"
    for missing in (t.read_properties, t.size_of):
        with pytest.raises(FileNotFoundError):
            missing(spark, f"{base}/none")
    assert t.size_of(spark, f"{base}/p") == (tmp_path / "p").stat().st_size < t.size_of(spark, base)
    assert t.full_path(spark, f"{base}/foo/../p") == f"{base}/p"


def test_jobs(spark, tmp_path):
    grid = spark.createDataFrame([("/in/a.png", 2, 3), ("/in/b.png", 1, 1)], "image string, tiles_w long, tiles_h long")
    lines = jobs.predict_job(grid, 5, "/model", "/out").orderBy("line_no").collect()
    assert [r.line_no for r in lines] == list(range(1, 13)) and lines[2].value == "1:::-t 2,3 -t 2,2 -t 2,1 -t 1,3 -t 1,2"
    assert [r.value for r in lines[4:8]] == ["2:::/in/a.png", "2:::/model", "2:::-t 1,1", "2:::/out/a.png"] and lines[11].value == "3:::/out/b.png"
    rows = tables.config_rows(jobs.predict_job(grid, 5, "/model", "/out"))
    assert {r.value for r in rows.filter("ordinal = 1").collect()} == {"/in/a.png", "/in/b.png"}
    train = jobs.train_job(spark.createDataFrame([(1, "i", "l", None, "o")], "task_id long, images string, labels string, options string, out string"))
    assert [r.value for r in train.orderBy("line_no").collect()] == ["1:::i", "1:::l", "1:::", "1:::o"]
    tasks, log = spark.range(1, 6).withColumnRenamed("id", "task_id"), jobs.Attempts(spark, f"file://{tmp_path}/failed")
    code, left = jobs.run_tasks(tasks, lambda todo, n: todo.filter(f"task_id <= {2 * n}"), max_tries=2, log=log)
    assert code == jobs.RETRIES_EXCEEDED and [r.task_id for r in left.collect()] == [5]
    assert sorted((r.attempt, r.task_id) for r in log.all().collect()) == [(1, 3), (1, 4), (1, 5), (2, 5)]
    done = tasks.filter("task_id < 3")
    assert {r.task_id: r.state for r in jobs.status(tasks, done).collect()} == {1: "done", 2: "done", 3: "failed", 4: "failed", 5: "failed"}
    assert jobs.verify(tasks, done)[0] == 3
    assert jobs.grouped(spark, "g1", lambda: spark.range(10).count()) == 10 and set(jobs.running(spark, "g1").values()) == {"SUCCEEDED"}
    jobs.cancel(spark, "g1")
    said: list[str] = []
    assert jobs.reported(lambda: 1, said.append) == 0 and jobs.reported(lambda: 1 / 0, said.append) == 1 and "ZeroDivisionError" in said[1]
    assert jobs.tool_numbers(["1", "0"], 2) == [1, 0] and len(jobs.tool_histogram(["1"] * 256)) == 256
    for bad in (["1"], ["1", "-2"], ["1", "x"]):
        with pytest.raises(ValueError):
            jobs.tool_numbers(bad, 2)


def test_only_wanted_tiles_are_predicted(spark, data):
    """The rest is 0, and no other tile is made."""
    pixels = px(spark, data).filter("image_id < 2")
    param, grid = cascade.Param(1, 0, ("haar",)), tiles.Grid(26, 26, 5, 5)
    net = {(1, 0): cascade.Net(np.random.default_rng(1).normal(size=(20, 3)), 10)}
    whole = {(r.image_id, r.row, r.col): r.p for r in cascade.predict(pixels, net, param, grid).collect()}
    some = {(r.image_id, r.row, r.col): r.p for r in cascade.predict(pixels, net, param, grid, [(1, 1), (2, 4), (2, 4), (9, 9), (-1, -1)]).collect()}
    assert whole.keys() == some.keys()
    inside = lambda y, x: (y // 16, x // 16) in ((0, 0), (1, 3))
    assert all(p == (whole[k] if inside(k[1], k[2]) else 0) for k, p in some.items())
    wanted = spark.createDataFrame([(1, 1)], "tile_row long, tile_col long")
    assert grid.blocks(pixels, wanted).count() == 2
    assert not any(r.p for r in cascade.predict(pixels, net, param, grid, [(-1, -1)]).collect())


def test_command_line_fits_and_predicts(spark, data, tmp_path, monkeypatch, capsys):
    from rastra import __main__ as cli

    real = cascade.Param
    monkeypatch.setattr(cascade, "Param", lambda s=1, v=0, e=("haar", "edge"): real(s, v, e, 500, {"epochs": 1, "groups": 2, "units": 2}))
    pixels = px(spark, data).filter("image_id < 2")
    for name, raster in (("in", pixels), ("labels", labels(pixels).select("image_id", "row", "col", (F.col("y") * 255).alias("v")))):
        images.write(raster, spark.createDataFrame([(0, "x.png"), (1, "y.png")], "image_id long, name string"), f"file://{tmp_path}/{name}")
    base = f"file://{tmp_path}"
    assert cli.main(["fit", f"{base}/in", f"{base}/labels", "-m", f"{base}/model", "-S", "1", "-L", "0"]) == 0
    assert cli.main(["show", "-m", f"{base}/model"]) == 0
    assert "training size: 50 x 64 (height x width)" in capsys.readouterr().out
    known = cascade.load_param(spark, f"{base}/model", "hgram", "stages")
    assert sum(known.hgram) == 2 * 50 * 64 and known.stages == 1
    net = spark.read.parquet(f"{base}/model/stage=1/level=0").first()
    weights = np.random.default_rng(1).normal(size=(10, net.width)).ravel().tolist()  # a few rows teach a network little
    schema = "stage int, level int, groups int, width int, weights array<double>, errors array<double>"
    spark.createDataFrame([(1, 0, 10, net.width, weights, [])], schema).write.mode("overwrite").parquet(f"{base}/model/stage=1/level=0")
    assert cli.main(["predict", f"{base}/in", f"{base}/out", "-m", f"{base}/model", "-b", "42x42", "-o", "5x5", "-t", "1,1"]) == 0
    for name in ("x.png", "y.png"):
        img = images.decode_png((tmp_path / "out" / name).read_bytes())
        assert img.shape == (50, 64) and not img[32:].any() and not img[:, 32:].any() and img[:32, :32].any()
    assert cli.main(["predict", f"{base}/in", f"{base}/table", "-m", f"{base}/model", "-b", "42x42", "-o", "5x5", "-n", "-p"]) == 0
    assert spark.read.parquet(f"{base}/table").count() == 2 * 50 * 64
    # a model of networks alone gets its parameters back
    import shutil

    shutil.rmtree(tmp_path / "model" / "param")
    assert cascade.migrate_param(spark, f"{base}/model").stages == 1
    assert cascade.load_param(spark, f"{base}/model", "hgram", "levels") == (None, 0)


def test_command_line():
    from rastra.__main__ import parser

    a = parser().parse_args(["predict", "in", "out", "-b", "200x100", "-o", "3x1", "-t", "1,1", "-t", "2,3"])
    assert (a.block, a.overlap, a.tile) == ((100, 200), (1, 3), [(1, 1), (3, 2)])
    for bad in ("10x0", "-1x2"):
        with pytest.raises(SystemExit):
            parser().parse_args(["predict", "in", "out", f"--block={bad}"])
    assert parser().parse_args(["predict", "in", "out", "-o", "0x2"]).overlap == (2, 0)
