"""Scalar derivations over encounters, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain model.
MU_KM3_S2, EARTH_KM = 398600.8, 6378.135


def floored(x: Column, digits: int = 6) -> Column:
    """Round half up by floor, which engines agree on."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


# Fixed values of the next four: thresholds of severity, risk, action, and the weights and knots of the index.
def severity(pc: Column, miss_km: Column) -> Column:
    return F.when((pc >= 1e-4) | (miss_km < 1), "CRITICAL").when((pc >= 1e-6) | (miss_km < 5), "WARNING").otherwise("WATCH")


def risk_class(pc: Column) -> Column:
    return F.when(pc >= 1e-4, "high").when(pc >= 1e-6, "elevated").otherwise("low")


def action_tier(pc: Column) -> Column:
    return F.when(pc >= 1e-4, "MANOEUVRE").when(pc >= 1e-5, "PREPARE").when(pc >= 1e-7, "MONITOR").otherwise("NONE")


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def log10_floor(pc: Column) -> Column:
    return F.log10(F.greatest(pc, F.lit(1e-20)))


def conjunction_index(miss_km: Column, pc: Column, tca_h: Column, speed: Column, age_h: Column) -> Column:
    """Weighted 0-10 index: distance, probability, time, speed and data age, each piecewise linear."""
    d = miss_km
    miss = F.when(d <= 0.1, 10.0).when(d <= 1, 9 - (d - 0.1) * 2 / 0.9).when(d <= 10, 7 - (d - 1) * 3 / 9).when(d <= 50, 4 - (d - 10) * 2 / 40).when(d <= 200, 2 - (d - 50) * 1.5 / 150).otherwise(F.greatest(F.lit(0.0), 0.5 - (d - 200) * 0.001))
    prob = F.when(pc <= 0, 0.0).when(pc >= 1e-2, 10.0).otherwise(clipped((log10_floor(pc) + 6) / 0.4, 0.0, 10.0))
    time = F.when(tca_h <= 1, 10.0).when(tca_h <= 6, 10 - (tca_h - 1) * 0.8).when(tca_h <= 24, 6 - (tca_h - 6) * 4 / 18).otherwise(F.greatest(F.lit(0.0), 2 - (tca_h - 24) * 0.05))
    return miss * 0.4 + prob * 0.3 + time * 0.15 + clipped(speed / 15 * 10, 0.0, 10.0) * 0.1 + clipped(age_h / 168 * 10, 0.0, 10.0) * 0.05


def isotropic_pc(miss_km: Column, sigma_km: Column, radius_km: Column) -> Column:
    """Chance that an isotropic Gaussian miss falls in the hard-body disk: the non-central chi-square distribution.

    With a = miss^2 / 2 sigma^2 and x = radius^2 / 2 sigma^2 it is the sum over i >= 1 of x^i / i! times the
    sum over j < i of a^j / j!, times exp(-a - x): positive terms only, so the relative error stays small.
    The fold runs over as many terms as the larger of x and sqrt(a x) needs and carries exp(-sqrt(a x)) in
    both factors, so that nothing overflows. Where a x and x are small, as for most bodies, the same sum is a
    short nested polynomial without a fold. Below 1e-300 it is 0. A body beyond ``STRAIGHT`` deviations has
    an edge as good as straight, and the normal distribution of the way to it decides.
    """
    a, x = miss_km * miss_km / (sigma_km * sigma_km * 2), radius_km * radius_km / (sigma_km * sigma_km * 2)
    u = F.sqrt(a * x)
    most = F.greatest(u, x)
    terms = F.ceil(most + 7 * F.sqrt(most) + 10).cast("int")
    scale = F.exp(-u)
    start = F.struct(scale.alias("px"), scale.alias("pa"), F.lit(0.0).alias("inner"), F.lit(0.0).alias("total"))

    def step(done: Column, i: Column) -> Column:
        px, inner = done["px"] * x / i, done["inner"] + done["pa"]
        return F.struct(px.alias("px"), (done["pa"] * a / i).alias("pa"), inner.alias("inner"), (done["total"] + px * inner).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda done: done["total"])
    apart = F.sqrt(a) - F.sqrt(x)
    edge = normal_share((radius_km - F.sqrt(miss_km * miss_km + sigma_km * sigma_km)) / sigma_km)
    short = (a * x <= 2) & (x <= 0.05)
    return F.when(short, F.exp(-a - x) * _short_sum(a * x, x)).when(x > STRAIGHT * STRAIGHT / 2, edge).when((apart > 0) & (apart * apart > 690), 0.0).otherwise(clipped(F.exp(-apart * apart) * summed, 0.0, 1.0))


def _short_sum(z: Column, x: Column, terms: int = 9, depth: int = 5) -> Column:
    """The double sum, grouped by powers of z = a x: x times the sum over j of z^j / (j! (j + 1)!) (1 + x / (j + 2) (1 + x / (j + 3) (...)))."""
    total = None
    for j in reversed(range(terms)):
        inner = F.lit(1.0)
        for k in reversed(range(j + 2, j + 2 + depth)):
            inner = inner * x / k + 1
        total = inner if total is None else total * z / ((j + 1) * (j + 2)) + inner
    return x * total


#: Body radius in deviations from which its edge counts as straight.
STRAIGHT = 30.0
#: Coefficients of a rational approximation of the error function (to 1.2e-7).
ERF = (1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_share(z: Column) -> Column:
    """The standard normal distribution function, to about 1e-7."""
    t = 1 / (1 + F.abs(z) * (0.5 * 0.5**0.5))
    poly = F.lit(ERF[-1])
    for c in ERF[-2:0:-1]:
        poly = poly * t + c
    tail = t * F.exp(-z * z / 2 - ERF[0] + t * poly) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def log_pc_norm(pc: Column) -> Column:
    """0 at 1e-7, 1 at 1e-4, linear in the logarithm; 0 for none."""
    return F.when(pc > 0, clipped((F.log10(pc) + 7) / 3, 0.0, 1.0)).otherwise(0.0)


def decision_components(pc: Column, pc_ml: Column, downstream: Column, dv: Column, safe: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Raw value, normalised value and weight of each part of the decision score, by source."""
    burn = F.when(dv.isNull(), 0.0).otherwise(F.exp(-F.greatest(dv, F.lit(0.0))) * F.when(safe == F.lit(False), 0.5).otherwise(1.0))
    return {
        "physics": (pc, log_pc_norm(pc), F.when(pc_ml.isNull(), 0.75).otherwise(0.60)),
        "ml": (pc_ml, F.coalesce(log_pc_norm(pc_ml), F.lit(0.0)), F.when(pc_ml.isNull(), 0.0).otherwise(0.15)),
        "cascade": (downstream, 1 - F.exp(-downstream / 5), F.lit(0.15)),
        "manoeuvre": (dv, burn, F.lit(0.10)),
    }


def decision(pc: Column, pc_ml: Column, downstream: Column, dv: Column, safe: Column, spread: Column, short_ok: Column) -> dict[str, Column]:
    """score, action, escalated, confidence, rationale of an alert.

    Weights are .60 physics, .15 surrogate, .15 cascade, .10 manoeuvre; without a surrogate its weight
    goes to physics. PREPARE becomes MANOEUVRE where surrogate and cascade agree.
    """
    parts = decision_components(pc, pc_ml, downstream, dv, safe)
    cascade = parts["cascade"][1]
    score = floored(100 * sum((x * w for _, x, w in list(parts.values())[1:]), parts["physics"][1] * parts["physics"][2]), 2)
    tier = action_tier(pc)
    escalated = F.coalesce((tier == "PREPARE") & (pc_ml >= 1e-4) & (cascade >= 0.5), F.lit(False))
    action = F.when(escalated, "MANOEUVRE").otherwise(tier)
    apart = F.abs(log10_floor(pc) - log10_floor(pc_ml))
    fine = F.coalesce(short_ok, F.lit(True))
    confidence = F.when(fine & (spread <= 0.5) & (apart <= 1.0), "high").when(fine & (F.coalesce(spread, F.lit(0.0)) <= 1.0) & (apart.isNull() | (apart <= 2.0)), "medium").otherwise("low")
    said = F.concat_ws("; ", F.concat(F.lit("in the "), tier, F.lit(" band")), F.when(pc_ml.isNull(), "no surrogate (weight moved to physics)").otherwise(F.concat(F.format_string("%.2f", floored(apart, 2)), F.lit(" decades from physics"))), F.when(spread.isNotNull(), F.concat(F.lit("spread "), F.format_string("%.2f", floored(spread, 2)), F.lit(" decades"))), F.concat(downstream.cast("int").cast("string"), F.lit(" downstream object"), F.when(downstream == 1, "").otherwise("s")), F.when(dv.isNotNull(), F.concat(F.lit("verified manoeuvre "), F.format_string("%.3f", floored(dv, 3)), F.lit(" m/s"), F.when(safe == F.lit(False), " (not cascade-safe)").otherwise(""))))
    rationale = F.concat(said, F.lit(" -> "), action, F.when(escalated, " (escalated)").otherwise(""), F.lit(", confidence "), confidence)
    return {"score": score, "action": action, "escalated": escalated, "confidence": confidence, "rationale": rationale}


def cpi_of_pc(pc: Column) -> Column:
    """0 at 1e-9 to 10 at 1e-4 on a logarithmic scale."""
    return F.when(pc <= 0, 0.0).otherwise(clipped(2 * (F.log10(pc) + 9), 0.0, 10.0))


def legacy_band(km: Column) -> Column:
    return F.when(km <= 50, "red").when(km <= 200, "yellow").when(km <= 500, "green").otherwise("none")


#: Words of severity that clients have sent.
TIERS = {"CRITICAL": "CRITICAL", "RED": "CRITICAL", "WARNING": "WARNING", "YELLOW": "WARNING", "AMBER": "WARNING", "ORANGE": "WARNING", "WATCH": "WATCH", "GREEN": "WATCH", "NOMINAL": "WATCH"}


def tier_of(word: Column, cpi: Column) -> Column:
    """The tier of a word in any case, else by the index."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.upper(F.coalesce(word, F.lit(""))))
    return F.coalesce(named, F.when(cpi >= 8, "CRITICAL").when(cpi >= 5, "WARNING").otherwise("WATCH"))


def approach(miss_m: Column) -> Column:
    return F.when(miss_m <= 1, "collision").when(miss_m <= 5000, "warning").otherwise("clear")


#: Position deviations (km) of fresh elements along R, T, N and their growth a day.
SIGMA_KM, GROWTH_KM = (0.10, 0.50, 0.15), (0.10, 1.00, 0.10)


def age_sigmas(age_days: Column) -> list[Column]:
    return [s + g * F.abs(age_days) for s, g in zip(SIGMA_KM, GROWTH_KM, strict=True)]


def ellipse_covariance(a: Column, b: Column, angle: Column, level: Column, km_per_unit: float = 1e-3) -> tuple[Column, Column, Column]:
    """c_tt, c_tn, c_nn (km^2) of an ellipse with semi-axes at ``level`` deviations and its major axis at an angle."""
    s1, s2 = a * km_per_unit / F.greatest(level, F.lit(1e-12)), b * km_per_unit / F.greatest(level, F.lit(1e-12))
    c, s = F.cos(angle), F.sin(angle)
    return c * c * s1 * s1 + s * s * s2 * s2, c * s * (s1 * s1 - s2 * s2), s * s * s1 * s1 + c * c * s2 * s2


def mahalanobis(b_t: Column, b_n: Column, c_tt: Column, c_tn: Column, c_nn: Column) -> Column:
    return (c_nn * b_t * b_t - 2 * c_tn * b_t * b_n + c_tt * b_n * b_n) / (c_tt * c_nn - c_tn * c_tn)


def largest_pc(b_t: Column, b_n: Column, c_tt: Column, c_tn: Column, c_nn: Column, hbr: Column) -> Column:
    """Largest probability over scales of the covariance, closed form for a small body."""
    q = mahalanobis(b_t, b_n, c_tt, c_tn, c_nn)
    return F.when(q <= 0, 1.0).otherwise(F.least(F.lit(1.0), hbr * hbr / (F.exp(F.lit(1.0)) * F.sqrt(c_tt * c_nn - c_tn * c_tn) * q)))


def shown_distance(km: Column) -> Column:
    return F.when(km.isNull(), "n/a").when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m"))).when(km < 10, F.concat(F.format_string("%.2f", floored(km, 2)), F.lit(" km"))).otherwise(F.concat(F.format_string("%.1f", floored(km, 1)), F.lit(" km")))


def shown_pc(pc: Column) -> Column:
    return F.when(pc.isNull(), "n/a").when(pc == 0, "0").otherwise(F.format_string("%.1e", pc))


def shown_countdown(minutes: Column) -> Column:
    m = F.abs(minutes)
    return F.when(minutes.isNull(), "n/a").otherwise(F.concat(F.when(minutes >= 0, "T-").otherwise("T+"), F.when(m < 90, F.concat(F.floor(m + 0.5).cast("string"), F.lit(" min"))).otherwise(F.concat(F.format_string("%.1f", floored(m / 60, 1)), F.lit(" h")))))


def rcs_class(rcs: Column) -> Column:
    return F.when(rcs.isNull(), "UNKNOWN").when(rcs < 0.1, "SMALL").when(rcs < 1, "MEDIUM").otherwise("LARGE")


def object_type(name: Column) -> Column:
    n = F.upper(F.coalesce(name, F.lit("")))
    return F.when(n.contains("DEB"), "DEB").when(n.contains("R/B"), "R/B").when(n == "", "UNK").otherwise("PAY")


def catalogue_number(field: Column) -> Column:
    """Alpha-5: a leading letter of either case (without I and O) stands for 10 and up; null where it is no number."""
    head, rest = F.upper(F.substring(field, 1, 1)), F.substring(field, 2, 10)
    at = F.instr(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ"), head)
    return F.when((at > 0) & (head != ""), (at + 9) * 10000 + F.when(rest.rlike("^[0-9]+$"), rest).try_cast("int")).otherwise(F.when(field.rlike("^[0-9]+$"), field).try_cast("int"))


def scaled_bessel(y: Column, terms: int = 40, far: float = 20.0) -> Column:
    """exp(-y) I0(y) for y >= 0: the power series up to ``far``, the asymptotic one beyond, both to 1e-10."""
    near = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(1.0), lambda acc, k: 1 + F.least(y, F.lit(far)) * F.least(y, F.lit(far)) / 4 / (k * k) * acc)
    z = F.greatest(y, F.lit(far))
    beyond = F.aggregate(F.sequence(F.lit(10), F.lit(1)), F.lit(1.0), lambda acc, k: 1 + (2 * k - 1) * (2 * k - 1) / (8 * k * z) * acc)
    return F.when(y <= far, F.exp(-y) * near).otherwise(beyond / F.sqrt(2 * math.pi * z))


def first_term_pc(b_t: Column, b_n: Column, c_tt: Column, c_nn: Column, radius: Column) -> Column:
    """First term of the series for an encounter with the mean variance of its plane; 0 without a variance.

    A fallback where no integral can be taken. Exponents are joined before they are raised, so far misses
    give small numbers and not 0 times infinity.
    """
    variance = (c_tt + c_nn) / 2
    u, x = radius * radius / (2 * variance), (b_t * b_t + b_n * b_n) / (2 * variance)
    y = 2 * F.sqrt(u * x)
    return F.when(variance < 1e-20, 0.0).otherwise(clipped(u * F.exp(y - u - x) * scaled_bessel(y), 0.0, 1.0))
