"""Turbomachinery coefficients as column expressions; a denominator that is too small gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def guarded(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where the denominator is at most TINY."""
    return F.when(denominator > TINY, numerator / denominator)


def loss_coefficient(pt_in: Column, pt_out: Column, ps_in: Column) -> Column:
    """MTH1: total-pressure loss over the inlet's dynamic pressure."""
    return guarded(pt_in - pt_out, pt_in - ps_in)


def static_pressure_coefficient(p: Column, p_ref: Column, q_ref: Column) -> Column:
    """MTH2."""
    return guarded(p - p_ref, q_ref)


def turbine_efficiency(pt_in: Column, pt_out: Column, tt_in: Column, tt_out: Column, gamma: float = 1.4) -> Column:
    """MTH3: actual over ideal drop of total temperature; pressure ratio in (0, 1]."""
    ratio = pt_out / pt_in
    ideal = 1 - F.pow(ratio, F.lit((gamma - 1) / gamma))
    return F.when((ratio > 0) & (ratio <= 1), guarded(1 - tt_out / tt_in, ideal))


def compressor_efficiency(pt_in: Column, pt_out: Column, tt_in: Column, tt_out: Column, gamma: float = 1.4) -> Column:
    """MTH4: ideal over actual rise of total temperature; pressure ratio of at least 1."""
    ratio = pt_out / pt_in
    return F.when(ratio >= 1, guarded(F.pow(ratio, F.lit((gamma - 1) / gamma)) - 1, tt_out / tt_in - 1))


def film_effectiveness(t_inf: Column, t_wall: Column, t_cool: Column) -> Column:
    """MTH5, MTH6: adiabatic film and overall cooling effectiveness share one form."""
    return guarded(t_inf - t_wall, t_inf - t_cool)


def nusselt(h: Column, length: Column, k: Column) -> Column:
    """MTH7."""
    return guarded(h * length, k)


def heat_transfer_coefficient(nu: Column, length: Column, k: Column) -> Column:
    """MTH8: the inverse of nusselt."""
    return guarded(nu * k, length)


def relative_change(new: Column, base: Column) -> Column:
    """MTH9, in percent of the base's absolute value."""
    return F.when(F.abs(base) > TINY, 100 * (new - base) / F.abs(base))


def point_change(new: Column, base: Column) -> Column:
    """MTH10, in percentage points."""
    return new - base


def vae_loss(kl: Column, mse: Column, lp: Column, lam1: float = 1.0, lam2: float = 5e5) -> Column:
    """MTH16."""
    return kl + lam1 * mse + lam2 * lp
