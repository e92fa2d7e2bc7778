"""Colour difference after the CIEDE2000 formula, written once for columns and for numpy arrays."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the formula needs of either side.
COLUMNS = SimpleNamespace(sqrt=F.sqrt, sin=F.sin, cos=F.cos, exp=F.exp, atan2=F.atan2, degrees=F.degrees, radians=F.radians, abs=F.abs, mod=lambda x, y: F.pmod(x, F.lit(y)), pick=lambda test, x, y: F.when(test, x).otherwise(y), pow=lambda x, y: F.pow(x, F.lit(y)), number=F.lit)
ARRAYS = SimpleNamespace(sqrt=np.sqrt, sin=np.sin, cos=np.cos, exp=np.exp, atan2=np.arctan2, degrees=np.degrees, radians=np.radians, abs=np.abs, mod=np.mod, pick=np.where, pow=np.power, number=float)


def difference(on: SimpleNamespace, l1, a1, b1, l2, a2, b2):
    """Perceived difference of two CIELAB colours, weights all 1, over columns or arrays that broadcast."""
    n = on.number
    chroma = lambda a, b: on.sqrt(a * a + b * b)
    mean_c7 = on.pow((chroma(a1, b1) + chroma(a2, b2)) / n(2.0), 7.0)
    g = n(0.5) * (n(1.0) - on.sqrt(mean_c7 / (mean_c7 + n(25.0**7))))
    a1, a2 = a1 * (n(1.0) + g), a2 * (n(1.0) + g)
    c1, c2 = chroma(a1, b1), chroma(a2, b2)
    hue = lambda a, b: on.pick((a == 0) & (b == 0), n(0.0), on.mod(on.degrees(on.atan2(b, a)), 360.0))
    h1, h2 = hue(a1, b1), hue(a2, b2)
    grey, d = c1 * c2 == 0, h2 - h1
    turn = on.pick(grey, n(0.0), on.pick(d > 180, d - n(360.0), on.pick(d < -180, d + n(360.0), d)))
    dl, dc, dh = l2 - l1, c2 - c1, n(2.0) * on.sqrt(c1 * c2) * on.sin(on.radians(turn / n(2.0)))
    ml, mc, s = (l1 + l2) / n(2.0), (c1 + c2) / n(2.0), h1 + h2
    mh = on.pick(grey, s, on.pick(on.abs(d) <= 180, s / n(2.0), on.pick(s < 360, (s + n(360.0)) / n(2.0), (s - n(360.0)) / n(2.0))))
    cosd = lambda x: on.cos(on.radians(x))
    t = n(1.0) - n(0.17) * cosd(mh - n(30.0)) + n(0.24) * cosd(n(2.0) * mh) + n(0.32) * cosd(n(3.0) * mh + n(6.0)) - n(0.20) * cosd(n(4.0) * mh - n(63.0))
    off = (ml - n(50.0)) * (ml - n(50.0))
    sl, sc, sh = n(1.0) + n(0.015) * off / on.sqrt(n(20.0) + off), n(1.0) + n(0.045) * mc, n(1.0) + n(0.015) * mc * t
    bend = n(30.0) * on.exp(-on.pow((mh - n(275.0)) / n(25.0), 2.0))
    mc7 = on.pow(mc, 7.0)
    rt = -n(2.0) * on.sqrt(mc7 / (mc7 + n(25.0**7))) * on.sin(on.radians(n(2.0) * bend))
    x, y, z = dl / sl, dc / sc, dh / sh
    return on.sqrt(x * x + y * y + z * z + rt * y * z)


def ciede2000(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    """difference of columns."""
    return difference(COLUMNS, l1, a1, b1, l2, a2, b2)


def delta_e(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """difference of arrays whose last axis is L, a, b."""
    return difference(ARRAYS, *np.moveaxis(one, -1, 0), *np.moveaxis(two, -1, 0))


def cielab(rgb: np.ndarray) -> np.ndarray:
    """CIELAB (D65) of sRGB in 0 to 1; the last axis has the components."""
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ np.array([[0.4124, 0.2126, 0.0193], [0.3576, 0.7152, 0.1192], [0.1805, 0.0722, 0.9505]]) / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), (903.3 * xyz + 16) / 116)
    x, y, z = np.moveaxis(f, -1, 0)
    return np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=-1)
