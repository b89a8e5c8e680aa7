"""Small dense algebra and integer hashing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def determinant2(xx: Column, xy: Column, yy: Column) -> Column:
    return xx * yy - xy * xy


def inverse2(xx: Column, xy: Column, yy: Column, ridge: float = 1e-5, floor: float = 1e-5) -> dict[str, Column]:
    """Inverse of a symmetric matrix and the logarithm of its determinant.

    A matrix that isn't positive gets the ridge on its diagonal; a determinant below the floor is raised to it.
    """
    bad = determinant2(xx, xy, yy) <= 0
    a, d = F.when(bad, xx + ridge).otherwise(xx), F.when(bad, yy + ridge).otherwise(yy)
    det = F.greatest(determinant2(a, xy, d), F.lit(floor))
    return {"xx": d / det, "xy": -xy / det, "yy": a / det, "logdet": F.log(det)}


def eigenvalues2(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """The larger and the smaller eigenvalue."""
    half, spread = (xx + yy) / 2, F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    return half + spread, half - spread


def inverse3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column, fallback: float = 100.0, least: float = 1e-12) -> dict[str, Column]:
    """Inverse of a symmetric 3 x 3 matrix and its determinant; a matrix that isn't positive falls back to a multiple of the identity."""
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    cofactors = {"ixx": yy * zz - yz * yz, "iyy": xx * zz - xz * xz, "izz": xx * yy - xy * xy, "ixy": xz * yz - xy * zz, "ixz": xy * yz - xz * yy, "iyz": xy * xz - xx * yz}
    good = det > least
    out = {k: F.when(good, c / det).otherwise(fallback if k in ("ixx", "iyy", "izz") else 0.0) for k, c in cofactors.items()}
    return out | {"det": F.when(good, det).otherwise(0.01)}


def smooth(s: Column, count: Column, prior: Column, side: float, diagonal: bool) -> Column:
    """A covariance entry drawn to a round region of the given side, with a quarter of the prior as weight on the diagonal."""
    q = prior / 4
    return ((q * side if diagonal else 0.0) + count * s) / (count + q + 3)


def _times(h: Column, k: int) -> Column:
    """h * k modulo 2**32, in two halves so that no product leaves 64 bits."""
    low, high = h.bitwiseAND(F.lit(0xFFFF)) * F.lit(k), (F.shiftrightunsigned(h, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def hash_unit(seed: Column, tid: Column) -> Column:
    """A hash of two integers in [0, 1]: the 32-bit finaliser of MurmurHash3, its lower 24 bits."""
    # Shifts and factors of the finaliser.
    h = tid.cast("long").bitwiseXOR(seed.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    h = _times(h, 0x85EBCA6B)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = _times(h, 0xC2B2AE35)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    return h.bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0xFFFFFF))
