"""Operators on hand-made fixtures and against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelframe.functions import scalar, special
from voxelframe.operators import align, arrays, classify, learn, ontology, points, quality, stats, summarize, voxels
from voxelframe.sources import catalog, images, tables
from voxelframe.streaming import windows


@pytest.mark.parametrize(("values", "p", "want"), [([1, 2, 3, 4], 5, 1.0), ([1, 2, 3, 4], 50, 2.5), ([1, 2, 3, 4], 90, 4.0), ([10, 20, 30, 40, 50], 30, 20.0), ([7], 99, 7.0), ([5, 5, 5, 9], 50, 5.0)])
def test_percentile(spark, values, p, want):
    frame = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    assert stats.rank_percentile(frame, ["g"], "v", p).collect()[0]["percentile"] == want


def test_mad_and_mode(spark):
    frame = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)] + [("b", v) for v in (3, 1, 3, 1, 2)] + [("c", 4)], "g string, v int")
    got = {r["g"]: r for r in stats.median_mad(frame, ["g"], "v").collect()}
    assert (got["a"]["median"], got["a"]["mad"]) == (3, 1) and got["b"]["mode"] == 1 and got["c"]["sd"] == 0


def test_fdr_with_ties(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.04, 0.9]
    frame = spark.createDataFrame(list(enumerate(p)), "i int, p double").withColumn("f", F.lit(1))
    got = [r["q"] for r in stats.fdr(frame, ["f"], "p", ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([0.06, 0.06, 0.06, 0.6, 0.06, 0.9])
    harmonic = sum(1 / k for k in range(1, 7))
    assert [r["q"] for r in stats.fdr(frame, ["f"], "p", ["i"], "by").orderBy("i").collect()] == pytest.approx([q * harmonic for q in got])


def test_student_t(spark):
    rows = [(t, d) for t in (0.0, 0.5, 1.0, 3.0, 25.0, -1.0) for d in (1.0, 2.0)] + [(float("nan"), 3.0), (float("inf"), 3.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, d double").select(special.student_t_p(F.col("t"), F.col("d"))).collect()]
    for (t, d), p in zip(rows[:-2], got, strict=False):
        want = 1 - 2 / math.pi * math.atan(abs(t)) if d == 1 else 1 - abs(t) / math.sqrt(2 + t * t)
        assert p == pytest.approx(want, abs=1e-9)
    assert math.isnan(got[-2]) and got[-1] == 0


def test_lgamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], abs=1e-10)


def test_divide(spark):
    got = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 2.0)], "a double, b double").select(special.divide(F.col("a"), F.col("b"))).collect()
    assert math.isnan(got[0][0]) and [r[0] for r in got[1:]] == [float("inf"), float("-inf"), 0.5]


def test_significance(spark):
    got = spark.createDataFrame([(0.0005,), (0.05,), (0.06,), (0.00001,)], "q double").select(stats.significance(F.col("q"))).collect()
    assert [r[0] for r in got] == [4, 1, 0, 5]


def structures(spark):
    return spark.createDataFrame([(1, None, 0, "/1/", "a"), (2, 1, 1, "/1/2/", "b"), (3, 2, 2, "/1/2/3/", "c"), (23, 1, 1, "/1/23/", "d")], "id bigint, parent_structure_id bigint, depth int, structure_id_path string, acronym string").withColumn("index", F.col("id"))


def test_rollup_and_binning(spark):
    s = structures(spark)
    counts = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 3, 4), ("x", 23, 8)], "sample string, annotation bigint, n bigint")
    got = {r["id"]: r["n"] for r in ontology.rollup(counts, s, "annotation", ["sample"], "n").collect()}
    assert got == {1: 15, 2: 6, 3: 4, 23: 8}
    targets = s.where("id IN (1, 2)")
    assert sorted((r["annotation"], r["n"]) for r in ontology.bin_to_ancestor(counts, s, targets, "annotation").collect()) == [(1, 1), (1, 8), (2, 2), (2, 4)]
    assert sorted(r["id"] for r in ontology.leaves(s).collect()) == [3, 23]
    assert {r["id"]: r["structure_id_path"] for r in ontology.build_paths(s).collect()} == {1: "/1/", 2: "/1/2/", 3: "/1/2/3/", 23: "/1/23/"}


def test_custom_class(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0)], "a double, b double")
    columns = {1: F.col("a"), 2: F.col("b")}
    read = lambda e: [r[0] for r in frame.select(summarize.custom_class(e, columns)).collect()]
    assert read("CT1/(CT1+CT2)") == [pytest.approx(1 / 3), 0.0]
    assert read("2*CT2-CT1") == [3.0, 0.0] and read("-CT1+3") == [2.0, 3.0]
    for bad in ("CT3", "CT1; drop", "__import__('os')", "CT1 CT2", "(CT1", "CT1)", ""):
        with pytest.raises(ValueError):
            summarize.custom_class(bad, columns)


def test_threshold_language():
    assert classify.parse_threshold("mean + 2.5*std + prctile(90)") == [(1.0, "mean", None), (2.5, "std", None), (1.0, "prctile", 90.0)]
    for bad in ("mean - std", "mean std", "prctile", "max", "mean(3)", ""):
        with pytest.raises(ValueError):
            classify.parse_threshold(bad)
    assert [classify.manual_threshold(t) for t in (0.5, 300, 1, 0)] == [32767.5, 300, 0, 0]


def test_class_codes():
    assert classify.class_codes(2) == {(0, 0): 1, (1, 0): 2, (0, 1): 3, (1, 1): 4}
    assert [p for p, _ in sorted(classify.class_codes(3).items(), key=lambda x: x[1])] == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)]


def test_subscripts(spark):
    y, x, z = points.subscripts(F.col("i"), 3, 4)
    assert tuple(spark.createDataFrame([(17,)], "i bigint").select(y, x, z).first()) == (2, 2, 2)


def test_touching_removal_is_two_hop(spark):
    frame = spark.createDataFrame([(1, 0), (2, 2), (3, 4), (4, 20)], "id bigint, x int").select("id", F.lit(0).alias("y"), "x", F.lit(0).alias("z"))
    assert sorted(r["id"] for r in points.touching_removal(frame, 2.0).collect()) == [1, 4]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9), st.integers(-4, 4)), min_size=1, max_size=25, unique=True), st.sampled_from([1.0, 2.0, 3.0]))
def test_touching_removal_brute(spark, at, radius):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id bigint, y int, x int, z int")
    gone = set()
    for p in at:
        near = [i for i, q in enumerate(at) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= radius**2]
        gone |= {i for i in near if i != min(near)}
    assert {r["id"] for r in points.touching_removal(frame, radius).collect()} == set(range(len(at))) - gone


def test_permute():
    with pytest.raises(ValueError):
        points.permute([F.lit(1)] * 3, [1, 1, 1], "aal", "ail")


def test_asof_and_interpolation(spark):
    rows = [("t", 1, None), ("t", 2, 10.0), ("t", 3, None), ("t", 4, None), ("t", 5, 40.0), ("t", 6, None), ("u", 1, None), ("v", 1, None), ("v", 2, 7.0)]
    frame = spark.createDataFrame(rows, "tile string, z int, v double")
    got = [r["filled"] for r in align.asof_nearest(frame, ["tile"], "z", "v").orderBy("tile", "z").collect()]
    assert got == [10, 10, 10, 40, 40, 40, None, 7, 7]
    got = [r["filled"] for r in align.interpolate(frame, ["tile"], "z", "v").orderBy("tile", "z").collect()]
    assert got == [0, 10, 20, 30, 40, 50, None, 7, 7]


def test_moving_outliers(spark):
    frame = spark.createDataFrame([("t", k, 100.0 if k == 9 else float(k % 3)) for k in range(20)], "tile string, z int, v double")
    assert [r["z"] for r in align.moving_outliers(frame, ["tile"], "z", "v").where("outlier").collect()] == [9]


def test_tile_offsets(spark):
    edges = spark.createDataFrame([("s", 0, 1, 2.0, 9.0), ("s", 1, 2, -1.0, 8.0), ("s", 0, 2, 50.0, 1.0)], "sample_id string, a int, b int, shift double, weight double")
    assert {r["tile"]: r["dz"] for r in align.tile_offsets(edges).collect()} == {0: -1.0, 1: 1.0, 2: 0.0}


def test_follow(spark):
    frame = spark.createDataFrame([("t", k, v) for k, v in enumerate([1.0, 2.0, 9.0, 3.0, None])], "tile string, z int, v double")
    assert [r["followed"] for r in align.follow(frame, ["tile"], "z", "v").orderBy("z").collect()] == [1, 2, 2, 3, 3]


def test_chunks(spark):
    frame = spark.range(1, 101).select(F.col("id").cast("int").alias("z"))
    got = {(r["chunk"]): (r["a"], r["b"]) for r in align.chunks(frame, "z", 32, 8).groupBy("chunk").agg(F.min("z").alias("a"), F.max("z").alias("b")).collect()}
    assert got == {k: (a, b) for k, a, b, _ in align.chunk_ranges(1, 100, 32, 8)}
    assert align.gain_chain(iter([2.0, 0.5])) == pytest.approx([0.75, 1.5, 0.75])


def test_connected_against_flood_fill():
    r = np.random.default_rng(3)
    for corners in (True, False):
        mask = r.random((9, 8, 7)) < 0.25
        label = arrays.connected(mask, corners)
        seen = np.zeros(mask.shape, int)
        n = 0
        for start in zip(*np.nonzero(mask), strict=True):
            if seen[start]:
                continue
            n += 1
            stack = [start]
            seen[start] = n
            while stack:
                p = stack.pop()
                for o in np.ndindex(3, 3, 3):
                    d = tuple(k - 1 for k in o)
                    if not any(d) or (not corners and sum(map(abs, d)) != 1):
                        continue
                    q = tuple(a + b for a, b in zip(p, d, strict=True))
                    if all(0 <= a < m for a, m in zip(q, mask.shape, strict=True)) and mask[q] and not seen[q]:
                        seen[q] = n
                        stack.append(q)
        assert (label == seen).all()
    assert arrays.connected(np.zeros((3, 3), bool)).sum() == 0


@pytest.mark.parametrize("shift", [(0, 0), (3, -4), (-6, 5)])
def test_phase_correlation(shift):
    big = arrays.gaussian(np.random.default_rng(1).random((80, 80)), 1.0)
    a, b = big[20:60, 20:60], big[20 + shift[0] : 60 + shift[0], 20 + shift[1] : 60 + shift[1]]
    dy, dx, cc = arrays.phase_correlation(a, b)
    assert (round(dy), round(dx)) == shift and cc > 0.99


def test_blob_seeds_find_blobs():
    v = np.zeros((30, 30, 20))
    centres = [(8, 8, 6), (20, 9, 12), (14, 22, 10)]
    for c in centres:
        v[c] = 1000
    v = arrays.gaussian(v, 1.5)
    label = arrays.connected(arrays.blob_seeds(v, (1.5,), 0.02))
    found = sorted(tuple(int(round(i.mean())) for i in np.nonzero(label == k)) for k in range(1, label.max() + 1))
    assert found == sorted(centres)


def test_filters():
    image = np.full((12, 12), 5.0)
    assert np.allclose(arrays.gaussian(image, 2), 5) and np.allclose(arrays.median_filter(image), 5)
    image[6, 6] = 50
    assert arrays.opening(image, 1).max() == 5 and arrays.closing(-image, 1).min() == -5
    assert arrays.without_background(image, 2).argmax() == 6 * 12 + 6
    assert 5 < arrays.otsu(image) < 50
    f = arrays.patch_features(image[2:11, 2:11])
    assert f["Max"] == 50 and f["Middle"] == 50 and f["MoC"] == 10
    flat, _ = arrays.flatfield(np.stack([np.outer(np.linspace(1, 2, 16), np.ones(16)) * k for k in (100, 200, 300)]))
    assert flat[-1].mean() > flat[0].mean()


def test_volumes(spark):
    v = spark.createDataFrame([(1, 1, 1, 5), (2, 3, 1, 6), (4, 4, 2, 7)], "y int, x int, z int, structure_index bigint")
    cells = lambda f: sorted(tuple(r) for r in f.select("y", "x", "z", "structure_index").collect())
    assert cells(voxels.mirrored(v, 4)) == sorted([(1, 1, 1, 5), (2, 3, 1, 6), (4, 4, 2, 7), (1, 8, 1, 5), (2, 6, 1, 6), (4, 5, 2, 7)])
    assert cells(voxels.half(voxels.mirrored(v, 4), 8)) == cells(v)
    assert cells(voxels.crop_pad(v, (4, 4, 2), (2, 6, 2))) == [(1, 4, 1, 6)]
    assert cells(voxels.nearest_resize(voxels.nearest_resize(v, (4, 4, 2), (8, 8, 4)), (8, 8, 4), (4, 4, 2))) == cells(v)
    cube = spark.createDataFrame([(y, x, z, 1) for y in range(4) for x in range(4) for z in range(4)], "y int, x int, z int, structure_index bigint")
    assert voxels.border(cube).count() == 64 - 8


def test_detection(spark):
    vox = spark.createDataFrame([(k, 1, 1, label, 1.0 if label != 4 else 0.0) for k, label in enumerate([1, 1, 2, 3, 4, 0])], "y int, x int, z int, label int, prediction double")
    hits = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 1), (5, 1, 1), (9, 9, 9)], "y int, x int, z int")
    r = quality.detection(vox, hits).first()
    assert (r["mult"], r["merged"], r["missed"], r["correct"], r["empty"]) == (1, 1, 1, 1, 2) and r["precision"] == 0.25


def test_folds_and_split(spark):
    frame = spark.range(10_000)
    n = {r["f"]: r["n"] for r in frame.groupBy(learn.fold(F.col("id"), 5).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert set(n) == set(range(5)) and max(n.values()) < 2300
    a, b = learn.split(frame, "id", 0.8)
    assert a.count() + b.count() == 10_000 and 7600 < a.count() < 8400
    assert learn.sample_valid(frame, "id", 7, 3).count() == 7


def test_svm_and_mixture(spark):
    r = np.random.default_rng(0)
    rows = [(int(k), [float(v) for v in r.normal(c * 6, 1, 2)], float(c)) for k, c in enumerate(np.repeat([0, 1, 2], 40))]
    frame = spark.createDataFrame(rows, "id int, f array<double>, label double")
    out = learn.predict(learn.svm(frame, "f", "label"), frame, "f")
    assert out.where("prediction = label").count() >= 100
    mix = learn.mixture(frame, "f", 3)
    assert mix.where("component = label + 1").count() >= 115


def plain_mixture(x, k, rounds, start):
    """Expectation maximisation on arrays."""
    n, d = x.shape
    whole = np.cov(x.T, bias=True).reshape(d, d)
    ridge = learn.RIDGE * np.trace(whole) * (1 + learn.RIDGE) / d * np.eye(d)
    weights, means, covs = (start[name].copy() for name in ("weights", "means", "covs"))
    for _ in range(rounds):
        dens = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(weights, means, covs, strict=True)], 1)
        r = dens / dens.sum(1, keepdims=True)
        weights = r.sum(0) / n
        means = (r.T @ x) / r.sum(0)[:, None]
        covs = np.stack([((x - means[c]).T * r[:, c]) @ (x - means[c]) / r[:, c].sum() + ridge for c in range(k)])
    return weights, means, covs


def test_mixture_against_arrays(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal((0, 0), 1, (150, 2)), r.normal((3, 1), (0.5, 2), (80, 2)), r.normal((7, -2), 1, (60, 2))])
    frame = spark.createDataFrame([([float(v) for v in p],) for p in x], "f array<double>")
    start = {"weights": np.full(3, 1 / 3), "means": np.array([[-1.0, 0], [2, 0], [5, 1]]), "covs": np.stack([np.eye(2) * 2] * 3)}
    got = learn.fit_mixture(frame, "f", 3, 2, rounds=8, tolerance=0, start=start)
    want = plain_mixture(x, 3, 8, start)
    order = np.lexsort(want[1].T[::-1])
    for a, b in zip((got["weights"], got["means"], got["covs"]), want, strict=True):
        assert a == pytest.approx(b[order], rel=1e-6, abs=1e-9)


def test_mixture_of_odd_rows(spark):
    """Equal rows, fewer rows than components, a constant feature, nulls, no rows: never a failure, always a distribution."""
    kinds = "f array<double>"
    for rows in ([[1.0, 2.0]] * 9, [[1.0, 5.0], [2.0, 5.0]], [[0.0, 0.0]] * 50 + [[9.0, 9.0]], [[float(k), 3.0] for k in range(40)]):
        got = learn.mixture(spark.createDataFrame([(v,) for v in rows] + [(None,)], kinds), "f", 4).collect()
        assert all(1 <= r["component"] <= 4 and 0.2 <= r["probability"] <= 1 + 1e-9 for r in got if r["f"]) and len(got) == len(rows) + 1
        assert all(r["component"] is None for r in got if r["f"] is None)
    assert learn.mixture(spark.createDataFrame([], kinds), "f", 2).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.01, 2.0, 50.0, 73.3, 99.99, 100.0])
def test_percentile_of_many_values(spark, p):
    r = np.random.default_rng(9)
    groups = {"even": r.random(20_000), "heavy": r.pareto(0.3, 45_000), "ties": r.integers(0, 3, 9_000).astype(float), "one": np.array([4.0])}
    frame = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(None, 2.0), (None, 3.0)], "g string, v double").repartition(7)
    got = {r["g"]: r["percentile"] for r in stats.rank_percentile(frame, ["g"], "v", p).collect()}
    for g, x in (groups | {None: np.array([2.0, 3.0])}).items():
        s, pos = np.sort(x), min(max(len(x) * p / 100 + 0.5, 1), len(x))
        lo, hi = s[int(np.floor(pos)) - 1], s[int(np.ceil(pos)) - 1]
        assert got[g] == pytest.approx(lo + (pos - np.floor(pos)) * (hi - lo), rel=1e-12)


def test_median_mad_against_arrays(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(0, 50, 5001))
    got = stats.median_mad(spark.createDataFrame([("a", float(v)) for v in x], "g string, v double"), ["g"], "v").first()
    values, counts = np.unique(x, return_counts=True)
    assert (got["median"], got["mode"], got["mad"]) == (np.median(x), values[counts.argmax()], np.median(np.abs(x - np.median(x))))


def test_chunked_kernels_equal_whole_ones(spark):
    r = np.random.default_rng(6)
    volume = np.where(r.random((41, 23, 9)) < 0.4, r.random((41, 23, 9)) * 100, 0)
    at = np.argwhere(volume > 0)
    frame = spark.createDataFrame([(1, int(y) + 3, int(x) - 4, int(z), float(volume[y, x, z])) for y, x, z in at], "g int, y int, x int, z int, value double")
    low = at.min(0)
    whole = volume[tuple(slice(a, b + 1) for a, b in zip(low, at.max(0), strict=True))]
    for kernel, halo in ((lambda v, top: arrays.gaussian(v, (1.0, 1.0, 0.0)), (3, 3, 0)), (lambda v, top: arrays.without_background(v, 2), 7), (lambda v, top: arrays.blob_seeds(v, (1.0, 1.5), 0.002, top).astype(float), 7)):
        want = kernel(whole, whole.max())
        got = {(q["y"] - 3, q["x"] + 4, q["z"]): q["value"] for q in arrays.per_chunk(frame, ["g"], kernel, (16, 10, 8), halo).collect()}
        assert set(got) == {tuple(int(v) for v in p + low) for p in np.argwhere(want)}
        assert all(v == pytest.approx(want[tuple(np.array(p) - low)]) for p, v in got.items())
    for corners in (True, False):
        label = arrays.connected(whole > 60, corners)
        got = arrays.components(frame.where("value > 60"), ["g"], corners, size=(9, 8, 4)).collect()
        parts: dict[int, set] = {}
        for q in got:
            parts.setdefault(q["label"], set()).add(int(label[q["y"] - 3 - low[0], q["x"] + 4 - low[1], q["z"] - low[2]]))
        assert len(parts) == label.max() and all(len(x) == 1 for x in parts.values()) and len(got) == (whole > 60).sum()


def test_catalog(spark):
    files = spark.createDataFrame([("in/C1/a[03 x 01]_Z0012.tif",), ("in/C2/a[03 x 02]_Z0013.TIF",), ("in/other/a[01 x 01]_Z0001.tif",), ("in/C1/readme.txt",)], "file string")
    got = sorted(tuple(r) for r in catalog.parse_raw(files, "s", {"m1": "/c1/", "m2": "/c2/"}).select("markers", "channel_num", "y", "x", "z").collect())
    assert got == [("m1", 1, 3, 1, 12), ("m2", 2, 3, 2, 13)]
    moved = files.select(catalog.reroot(F.col("file"), "in/", "out/").alias("f")).first()[0]
    assert moved.startswith("out/C1")
    name = spark.createDataFrame([("a_03_09_Z1.tif",)], "f string").select(catalog.renamed(F.col("f"), 1, 2)).first()[0]
    assert name == "a_04_11_Z1.tif"
    samples = spark.createDataFrame([("s1", ["p", "WT"]), ("s2", ["p", "KO"])], "sample_id string, groups array<string>")
    assert [r[0] for r in catalog.in_groups(samples, ["p", "KO"]).collect()] == ["s2"]


def test_image_files(spark, tmp_path):
    volume = (np.arange(2 * 3 * 4).reshape(2, 3, 4) * 7).astype("<u2")
    (tmp_path / "v.tif").write_bytes(images.write_tiff(volume))
    head = b"NRRD0004\ntype: ushort\ndimension: 3\nsizes: 4 3 2\nendian: little\nencoding: raw\n\n"
    (tmp_path / "v.nrrd").write_bytes(head + volume.tobytes())
    meta = b"ObjectType = Image\nNDims = 3\nDimSize = 4 3 2\nElementType = MET_USHORT\nElementDataFile = LOCAL\n"
    (tmp_path / "v.mha").write_bytes(meta + volume.tobytes())
    nifti = bytearray(352)
    nifti[0:4] = (348).to_bytes(4, "little")
    nifti[40:56] = np.array([3, 4, 3, 2, 1, 1, 1, 1], "<i2").tobytes()
    nifti[70:72] = np.array([512], "<i2").tobytes()
    nifti[76:108] = np.ones(8, "<f4").tobytes()
    nifti[108:112] = np.array([352], "<f4").tobytes()
    (tmp_path / "v.nii").write_bytes(bytes(nifti) + volume.tobytes())
    (tmp_path / "broken.tif").write_bytes(b"II*\0junk")
    assert {r["file"].rsplit("/", 1)[1]: r["ok"] for r in images.check_files(spark, str(tmp_path)).collect()} == {"v.tif": True, "v.nrrd": True, "v.mha": True, "v.nii": True, "broken.tif": False}
    (tmp_path / "broken.tif").unlink()
    got = images.read_pixels(spark, str(tmp_path), nonzero=False).collect()
    for name in ("v.tif", "v.nrrd", "v.mha", "v.nii"):
        back = np.zeros((2, 3, 4))
        for r in got:
            if r["file"].endswith(name):
                back[r["z"] - 1, r["y"] - 1, r["x"] - 1] = r["value"]
        assert (back == volume).all()
    assert catalog.list_files(spark, str(tmp_path)).count() == 3
    row = images.images_from(images.read_pixels(spark, str(tmp_path / "v.tif")), ["file", "z"]).orderBy("z").first()
    assert row["pixels"] == volume[0].ravel().astype(float).tolist()


def test_text_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿index,id,atlas_id,parent_structure_id,depth,structure_id_path,color_hex_triplet,name,acronym\n1,997,1,,0,/997/,FFFFFF,root,root\n,,,,,,,,\n".encode())
    r = tables.read_structures(spark, str(tmp_path / "s.csv")).collect()
    assert len(r) == 1 and r[0]["id"] == 997 and r[0]["color_hex_triplet"] == "FFFFFF"
    (tmp_path / "p.txt").write_text('// comment\n(Transform "BSplineTransform") // more\n(GridSpacing 8.0 4.0 2.0)\n\n')
    assert {x["key"]: x["values"] for x in tables.read_parameters(spark, str(tmp_path / "p.txt")).collect()} == {"Transform": ["BSplineTransform"], "GridSpacing": ["8.0", "4.0", "2.0"]}
    (tmp_path / "c.csv").write_text("1,2,3,997,5.5\n")
    assert tuple(tables.read_centroids(spark, str(tmp_path / "c.csv"), 1).first()) == (1, 2, 3, 997, 5.5)
    frame = spark.createDataFrame([("a", 1)], "s string, n int")
    assert tables.write_new(frame, str(tmp_path / "o")) != tables.write_new(frame, str(tmp_path / "o"))
    for _ in range(2):
        tables.append_partition(frame, str(tmp_path / "q"), "s")
    tables.append_partition(spark.createDataFrame([("b", 2)], "s string, n int"), str(tmp_path / "q"), "s")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_yaml():
    text = "# c\na: 1\nb:\n  - x\n  - [1, 2.5, true]\n  - k: v\n    l: ~\nc: {p: 'q', r: [s]}\nd:\n  e: text here\n"
    assert tables.read_yaml(text) == {"a": 1, "b": ["x", [1, 2.5, True], {"k": "v", "l": None}], "c": {"p": "q", "r": ["s"]}, "d": {"e": "text here"}}


def test_intensity(spark):
    k = F.lit
    got = spark.range(1).select(scalar.adjust_intensity(k(30000.0), k(1.0), k(1.0), k(0.0), k(0.0), k(1.0)), scalar.rescale16(k(5.0), k(0.0), k(10.0)), scalar.rescale16(k(5.0), k(5.0), k(5.0))).first()
    assert tuple(got) == (30000, 32768, 0)


def test_streaming(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = windows.read_events(spark, f"{tmp_path}/in", events._jdf.schema().toDDL(), 1)
    q = windows.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["window"]["start"], r["event_type"]): r["n"] for r in windows.tumbling(events, "1 hour").collect()}
    assert {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.table("hours").collect()} == want
    q = windows.append_detections(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    q = windows.append_detections(stream, f"{tmp_path}/out", f"{tmp_path}/ck")  # nothing is doubled
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()


@pytest.mark.parametrize("kind", ["uint8", "int16", "uint16", "float32"])
def test_image_writers_round_trip(kind):
    volume = (np.arange(2 * 5 * 7).reshape(2, 5, 7) * 3 % 251).astype(kind)
    for compress in (False, True):
        assert (images.read_nrrd(images.write_nrrd(volume, (0.5, 0.25, 2.0), compress))[0] == volume).all()
        assert (images.read_mha(images.write_mha(volume, None, compress))[0] == volume).all()
        got, head = images.read_nifti(images.write_nifti(volume, (0.5, 0.25, 2.0), compress))
        assert (got == volume).all() and head["spacing"] == (0.5, 0.25, 2.0)


def test_parameter_and_points_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("// made here\n" + tables.parameters_text({"Transform": ["Affine"], "Grid": [8, 8.5], "Write": True}))
    assert {r["key"]: r["values"] for r in tables.read_parameters(spark, str(tmp_path / "p.txt")).collect()} == {"Transform": ["Affine"], "Grid": ["8", "8.5"], "Write": ["true"]}
    assert tables.points_text([(1, 2.5), (3, 4)], True) == "index\n2\n1 2.5\n3 4\n"
    (tmp_path / "o.txt").write_text("Point\t0\t; InputIndex = [ 1 2 ]\t; InputPoint = [ 1.0 2.0 ]\t; OutputPoint = [ 1.5 2.25 ]\t; Deformation = [ 0.5 0.25 ]\n")
    (got,) = tables.read_transformed_points(spark, str(tmp_path / "o.txt")).collect()
    assert (got["point"], got["input"], got["output"], got["deformation"]) == (0, [1.0, 2.0], [1.5, 2.25], [0.5, 0.25])


def test_results_and_steps(spark, tmp_path):
    from voxelframe.sources import results

    base = str(tmp_path / "results")
    make = lambda s: spark.createDataFrame([(k, (k + len(s), 0.5)) for k in range(3)], "k int, stats struct<n:int,share:double>")
    assert results.run_step(spark, base, "counts", ["a", "b"], make) == ["a", "b"]
    assert results.run_step(spark, base, "counts", ["a", "b", "c"], make) == ["c"]
    assert results.run_step(spark, base, "counts", ["a"], make, "update") == ["a"] and results.run_step(spark, base, "counts", ["d"], make, "false") == []
    assert sorted(map(tuple, results.load_field(spark, base, "counts.stats.n", ["b"]).collect())) == [("b", 1), ("b", 2), ("b", 3)]
    assert results.load_field(spark, base, "counts").count() == 9
    assert sorted(map(tuple, results.fields(spark, base).collect())) == [("a", "counts"), ("b", "counts"), ("c", "counts")]
    with pytest.raises(ValueError, match="flag"):
        results.pending(make("a"), make("a"), ["k"], "maybe")
    with pytest.raises(Exception, match="not in exactly one group: x"):
        results.grouped(spark.createDataFrame([("a",), ("x",)], "sample_id string"), {"g": ["a"], "h": ["b"]}).collect()


def test_per_marker():
    from voxelframe.sources.results import per_marker

    assert per_marker({"a": 1, "b": [2, 3], "c": [4]}, ["a", "b", "c", "d"], ["m", "n"], {"d": "x"}) == {"a": [1, 1], "b": [2, 3], "c": [4, 4], "d": ["x", "x"]}
    with pytest.raises(ValueError, match="b has 3"):
        per_marker({"b": [1, 2, 3]}, ["b"], ["m", "n"])


def test_any_catalog(spark):
    files = spark.createDataFrame([("in/C1/t[01 x 02]_Z0003.tif",), ("S1_0002_C1_m1_01_02_aligned.tif",), ("S1_0002_C2_m2_stitched.tif",), ("S1_C2_m2_25.nii",)], "file string")
    got = {r["kind"]: r for r in catalog.read_any(files, "", {"m1": "/C1/"}).collect()}
    assert set(got) == {"raw", "aligned", "stitched", "resampled"}
    assert (got["raw"]["z"], got["aligned"]["z"], got["stitched"]["channel_num"], got["resampled"]["x_res"]) == (3, 2, 2, 25.0)
