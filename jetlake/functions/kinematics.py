"""Kinematics of four-momenta as column expressions (no Python at run time)."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def pt(px: Column, py: Column) -> Column:
    return F.sqrt(px * px + py * py)


def phi(px: Column, py: Column) -> Column:
    """Azimuth in [0, 2 pi)."""
    raw = F.atan2(py, px)
    turned = F.when(raw < 0, raw + F.lit(TWO_PI)).otherwise(raw)
    return F.when(turned >= F.lit(TWO_PI), F.lit(0.0)).otherwise(turned)


def rapidity(px: Column, py: Column, pz: Column, e: Column) -> Column:
    """Rapidity; +-(1e5 + |pz|) for a massless momentum along the beam."""
    pt2 = px * px + py * py
    part = F.greatest((e + pz) * (e - pz), pt2)
    total = e + F.abs(pz)
    size = F.when(part <= 0, F.abs(pz) + F.lit(1e5)).otherwise(
        F.lit(-0.5) * F.log(part / (total * total)))
    return F.when(pz < 0, -size).otherwise(size)


def mass2(px: Column, py: Column, pz: Column, e: Column) -> Column:
    return (e + pz) * (e - pz) - px * px - py * py


def mass(px: Column, py: Column, pz: Column, e: Column) -> Column:
    """Signed mass: negative for space-like momenta."""
    m2 = mass2(px, py, pz, e)
    return F.when(m2 < 0, -F.sqrt(-m2)).otherwise(F.sqrt(m2))


def of(momentum: Column) -> tuple[Column, Column, Column, Column]:
    """The components of a momentum struct, in the argument order used here."""
    return tuple(momentum.getField(c) for c in ("px", "py", "pz", "e"))


def delta_r2(a: Column, b: Column) -> Column:
    """Squared (rapidity, phi) distance of two momentum structs."""
    dphi = F.abs(phi(*of(a)[:2]) - phi(*of(b)[:2]))
    folded = F.least(dphi, F.lit(TWO_PI) - dphi)
    dy = rapidity(*of(a)) - rapidity(*of(b))
    return dy * dy + folded * folded


def add(a: Column, b: Column) -> Column:
    return F.struct(*[(a.getField(c) + b.getField(c)).alias(c) for c in ("px", "py", "pz", "e")])


def total(momenta: Column) -> Column:
    """Four-momentum sum of an array of momentum structs."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("px", "py", "pz", "e")])
    return F.aggregate(momenta, zero, add)
