"""Polarization algebra per pixel, as columns. Intensities behind polarizers at 0, 45, 90 and 135 degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1e-9
#: Refractive index for the Fresnel forms.
INDEX = 1.5


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def stokes(i0: Column, i45: Column, i90: Column, i135: Column) -> list[Column]:
    return [i0 + i90, i0 - i90, i45 - i135]


def dolp(s0: Column, s1: Column, s2: Column, offset: float = 0.0, gain: float = 1.0) -> Column:
    """Degree of linear polarization, optionally with an offset taken off and a gain, within 0..1."""
    return clip((F.hypot(s1, s2) / F.greatest(s0, F.lit(Z)) - offset) * gain)


def theta(s1: Column, s2: Column) -> Column:
    """Angle of polarization in -pi/2..pi/2."""
    return 0.5 * F.atan2(s2, s1)


def aolp(s1: Column, s2: Column) -> Column:
    """Angle of polarization in 0..pi."""
    return F.pmod(theta(s1, s2), F.lit(math.pi))


def attenuation(d: Column, strength: float = 0.8, floor: float = 0.35) -> Column:
    """Factor that takes glare off: the more polarized, the darker, but never below floor."""
    return F.greatest(1 - strength * d, F.lit(floor))


def gamma(c: Column) -> Column:
    return F.pow(clip(c), F.lit(1 / 1.8))


def fresnel_diffuse(zenith: Column, n: float = INDEX) -> Column:
    """Degree of polarization of diffuse reflection at a zenith angle."""
    s2 = F.sin(zenith) ** 2
    top = (n - 1 / n) ** 2 * s2
    return top / (2 + 2 * n * n - (n + 1 / n) ** 2 * s2 + 4 * F.cos(zenith) * F.sqrt(n * n - s2))


def fresnel_specular(zenith: Column, n: float = INDEX) -> Column:
    """Degree of polarization of specular reflection at a zenith angle."""
    s, c = F.sin(zenith), F.cos(zenith)
    root = F.sqrt(n * n - s * s)
    return 2 * s * s * c * root / (n * n - s * s - n * n * s * s + 2 * s**4)


def zenith_of(d: Column, steps: int = 900) -> Column:
    """Zenith angle on a grid of steps + 1 angles: the number of them whose diffuse polarization is below d, as an angle.

    The inverse of the diffuse form gives the place; four forward values around it settle the count.
    """
    n, r = INDEX, clip(d)
    top = n**4 * (1 - r * r) + 2 * n * n * (2 * r * r + r - 1) + r * r + 2 * r - 4 * n**3 * r * F.sqrt(1 - r * r) + 1
    bottom = (r + 1) * (r + 1) * (n**4 + 1) + 2 * n * n * (3 * r * r + 2 * r - 1)
    angle = F.acos(F.sqrt(clip(top / bottom)))
    low = F.least(F.greatest(F.floor(angle / (math.pi / 2) * steps) - 1, F.lit(0)), F.lit(steps))
    near = [(low + i <= steps) & (fresnel_diffuse((low + i) / float(steps) * (math.pi / 2)) < d) for i in range(4)]
    below = low + sum((c.cast("int") for c in near), F.lit(0))
    return F.least(below, F.lit(steps)) / steps * (math.pi / 2)


def pseudo_normal(d: Column, a: Column, factor: float = 0.05) -> list[Column]:
    """A normal tilted by the degree of polarization towards its angle, before the display factor."""
    tilt = clip(d / factor) * (math.pi / 2) * 0.9
    return [F.sin(tilt) * F.cos(a), F.sin(tilt) * F.sin(a), F.cos(tilt)]


def encode_normal(n: list[Column]) -> list[Column]:
    """Bytes (blue |z|, green, red) of a normal."""
    byte = lambda c: F.floor(clip(c * 0.5 + 0.5) * 255).cast("int")
    return [byte(F.abs(n[2])), byte(n[1]), byte(n[0])]


def hsv(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green, blue 0..1 of hue (0..1), saturation and value."""
    channel = lambda k: v - v * s * F.greatest(F.lit(0.0), F.least(F.least(F.pmod(k + h * 6, F.lit(6.0)), 4 - F.pmod(k + h * 6, F.lit(6.0))), F.lit(1.0)))
    return [channel(F.lit(float(k))) for k in (5, 3, 1)]
