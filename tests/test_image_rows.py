"""Images of one shape are taken together and give what each gives by itself, and a run's images are cut into pieces."""

import numpy as np
import pytest

from spokeflow.operators import series, signal


@pytest.mark.parametrize("shape", [(4, 201), (4, 7), (1, 30), (9, 40), (20, 64), (4, 1)])
def test_images_together(shape):
    rng = np.random.default_rng(3)
    images = rng.normal(size=(24, *shape))
    images[::3] = np.cumsum(images[::3], axis=-1)  # large regions, holes
    images[1] = 0.0
    images[2] = np.where(np.add.outer(np.arange(shape[0]), np.arange(shape[1])) % 5 < 2, 1.0, 0.0)  # even moments
    images[4] = 0.0
    images[4, : shape[0] // 2 + 1, 2:14] = 1.0
    for least in (1, 10):
        want = np.array([list(signal.image_geometry(x, least).values()) for x in images])
        np.testing.assert_allclose(signal.image_rows(images, least), want, rtol=1e-9, atol=1e-9)


def test_regions_of_plain_masks():
    rng = np.random.default_rng(5)
    images = rng.normal(size=(40, 7, 23))
    masks = rng.random(images.shape) < rng.uniform(0.3, 0.9, (40, 1, 1))
    image, found = signal.regions(signal._labels(masks), images)
    want = []
    for k, (m, x) in enumerate(zip(masks, images)):
        labels = signal.label(m)
        want += [(k, signal.region(labels == n, x)) for n in range(1, labels.max() + 1)]
    assert image.tolist() == [k for k, _ in want]
    np.testing.assert_allclose(found, np.array([w for _, w in want]), rtol=1e-9, atol=1e-9)


def test_a_run_is_cut_into_pieces(spark, monkeypatch):
    rng = np.random.default_rng(7)
    cells = [(0, t, lag, r, float(v)) for t in range(60) for lag in (0, 1) for r, v in enumerate(rng.normal(size=4).cumsum())]
    strips = spark.createDataFrame(cells, "run int, t int, lag int, row int, p double")
    take = lambda: {(r.t, r.lag): tuple(r)[3:] for r in series.image_features(strips, ["run"], "t", rows=20).collect()}
    whole = take()
    cut = []
    monkeypatch.setattr(series, "SERIES_PIECE", 25)
    pieces = series.in_pieces
    monkeypatch.setattr(series, "in_pieces", lambda *a, **k: cut.append(pieces(*a, **k)) or cut[-1])
    assert take() == whole and len(whole) == 120
    assert cut[0].select("_piece").distinct().count() == 3
    by = {(t, lag): [v for *_, v in sorted(c for c in cells if c[1:3] == (t, lag))] for t in range(60) for lag in (0, 1)}
    for t, lag in ((5, 0), (30, 1), (59, 0)):
        image = np.array([by[k, lag] for k in range(max(0, t - 20), t + 1)]).T
        top = max(v for k in range(max(0, t - 20), t + 1) for each in (0, 1) for v in by[k, each])
        np.testing.assert_allclose(whole[t, lag], list(signal.image_geometry(np.nan_to_num(image / top if top else image)).values()), rtol=1e-9, atol=1e-9)
