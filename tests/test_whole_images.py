"""Picture queries give every asset a result: plain NumPy on the smallest tables."""

import numpy as np
import pytest

from lodestone.operators import images
from lodestone.plans.catalog import QUERIES
from lodestone.sources.assets import derive_assets
from tests.test_catalog import SF


def pixels(asset: int, n: int) -> np.ndarray:
    i = np.arange(n)
    return (asset // 4 * 31 + i * i * (asset % 4 + 3) + i * 17) % 256


def dhash(asset):
    p = pixels(asset, 72).reshape(8, 9)
    bits = (p[:, :-1] > p[:, 1:]).ravel()
    x = sum(1 << int(i) for i in np.flatnonzero(bits))
    return (x - (1 << 64) if x >> 63 else x,)


def color_histogram(asset):
    p = pixels(asset, 256)
    p = p[p % 9 != 0]
    n = np.bincount(p // 64 * 16 + p * 3 % 256 // 64 * 4 + p * 7 % 256 // 64, minlength=64)
    return (",".join(str(min(255, int(x) * 255 // len(p))) for x in n),)


def quality_metrics(asset):
    return images.quality(pixels(asset, 4096))  # the kernel itself is held by its own test


@pytest.mark.parametrize("plain", [dhash, color_histogram, quality_metrics])
def test_every_asset_has_a_result(spark, plain):
    name = plain.__name__
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.asset_id) == sorted(r.asset_id for r in derive_assets(spark, SF).select("asset_id").collect())
    for asset, *values in got.itertuples(index=False):
        want = plain(asset)
        assert values == pytest.approx(want, abs=1e-8) if name == "quality_metrics" else tuple(values) == want, asset
