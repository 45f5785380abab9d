"""What larger tables bring: values between two integers of a pixel, ids of seven digits."""

import numpy as np

from quillstone.operators import model_boundary as M
from quillstone.plans import catalog, more  # noqa: F401


def test_pixels_are_rounded_as_floats(spark, tmp_path):
    """Just under half a pixel a product of doubles stays there, and one of floats, as in SQL, reaches it."""
    x = np.arange(1, 4_000, dtype=np.float32) / np.float32(200)
    x = np.concatenate([x, np.nextafter(x, np.float32(0))])
    floats, doubles = np.floor(x * np.float32(100) + np.float32(0.5)), np.floor(x.astype(np.float64) * 100 + 0.5)
    odd = np.flatnonzero(floats != doubles)[:64]
    assert len(odd) == 64
    row = np.where(np.arange(64) % 2 == 0, x[odd], np.float32(0))
    spark.createDataFrame([(0, [float(v) for v in row]), (1, [0.0] * 64)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    g = np.floor(row * np.float32(100) + np.float32(0.5)).astype(np.float64).reshape(8, 8)
    e = (g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]).ravel()
    got = {r.vec_id: r.sharpness for r in catalog.QUERIES["laplacian_variance"](spark, str(tmp_path)).collect()}
    assert got == {0: np.round(e.var() + 0.013), 1: 0.0}
    assert [r.difference for r in catalog.QUERIES["pixel_difference"](spark, str(tmp_path)).collect()] == [round(float(g.mean()) / 255, 6)]


def test_references_of_seven_digits(spark):
    reports = spark.createDataFrame([(1, "U1000001 and U000007"), (2, "U1000002"), (3, "none")], "k long, text string")
    units = spark.createDataFrame([("U1000001",), ("U000007",), ("U100000",)], "unit_id string")
    got = {r.k: (r.n_cited, r.n_unknown, r.valid) for r in M.report_references(reports, units, "k", "text").collect()}
    assert got == {1: (2, 0, True), 2: (1, 1, False), 3: (0, 0, False)}
