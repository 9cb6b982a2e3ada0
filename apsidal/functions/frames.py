"""Frames, elements and interpolation of states, as Column functions. A vector is a list of three columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .encounters import clipped

Vec = list[Column]
#: WGS-84 axis (km) and flattening, astronomical unit (km), gravity of the state vectors, Earth radius of the shadow.
WGS_A, WGS_F, AU_KM, MU, SHADOW_KM = 6378.137, 1 / 298.257223563, 149597870.7, 398600.4418, 6378.137
WGS_E2 = WGS_F * (2 - WGS_F)
TINY = 1e-10


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vec, by: Column) -> Vec:
    return [x * by for x in a]


def days_since_2000(micros: Column) -> Column:
    """Days from noon of 1 January 2000 UTC."""
    return (micros - F.lit(946728000000000)) / 86400e6


def gmst(micros: Column) -> Column:
    """Greenwich mean sidereal angle in radians."""
    d = days_since_2000(micros)
    t = d / 36525.0
    return F.radians(F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0, F.lit(360.0)))


def turned(r: Vec, angle: Column) -> Vec:
    """Inertial to Earth-fixed by the sidereal angle; the other way with its negative."""
    c, s = F.cos(angle), F.sin(angle)
    return [c * r[0] + s * r[1], c * r[1] - s * r[0], r[2]]


def of_geodetic(lat_deg: Column, lon_deg: Column, alt_km: Column) -> Vec:
    """Earth-fixed position of geodetic coordinates."""
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    n = WGS_A / F.sqrt(1 - WGS_E2 * F.sin(lat) * F.sin(lat))
    return [(n + alt_km) * F.cos(lat) * F.cos(lon), (n + alt_km) * F.cos(lat) * F.sin(lon), (n * (1 - WGS_E2) + alt_km) * F.sin(lat)]


def ground_point(fixed: Vec) -> tuple[Column, Column, Column]:
    """Spherical latitude and longitude (degrees) and height over the equatorial radius of an Earth-fixed position."""
    flat = F.hypot(fixed[0], fixed[1])
    lat = F.when(flat > 1e-9, F.degrees(F.atan2(fixed[2], flat))).when(fixed[2] > 0, 90.0).otherwise(-90.0)
    lon = F.pmod(F.degrees(F.atan2(fixed[1], fixed[0])), F.lit(360.0))
    return lat, F.when(lon > 180, lon - 360).otherwise(lon), F.greatest(F.lit(0.0), norm(fixed) - WGS_A)


def geodetic(fixed: Vec, rounds: int = 10) -> tuple[Column, Column, Column]:
    """Geodetic latitude, longitude (degrees), height by fixed-point rounds, folded so that the expression stays small."""
    p = F.hypot(fixed[0], fixed[1])

    def closer(lat: Column, _) -> Column:
        s = F.sin(lat)
        return F.atan2(fixed[2] + WGS_E2 * WGS_A / F.sqrt(1 - WGS_E2 * s * s) * s, p)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(fixed[2], p * (1 - WGS_E2)), closer)
    s = F.sin(lat)
    return F.degrees(lat), F.degrees(F.atan2(fixed[1], fixed[0])), p / F.cos(lat) - WGS_A / F.sqrt(1 - WGS_E2 * s * s)


def sun(micros: Column) -> Vec:
    """Low-precision position of the sun (km)."""
    n = days_since_2000(micros)
    lon = F.radians(F.pmod(280.460 + 0.9856474 * n, F.lit(360.0)))
    g = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    lam = lon + math.radians(1.915) * F.sin(g) + math.radians(0.020) * F.sin(2 * g)
    eps = F.radians(23.439 - 0.0000004 * n)
    r = (1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)) * AU_KM
    return [r * F.cos(lam), r * F.cos(eps) * F.sin(lam), r * F.sin(eps) * F.sin(lam)]


def illumination(r: Vec, micros: Column) -> Column:
    """sunlit, or eclipse inside the Earth's shadow cylinder."""
    s = sun(micros)
    along = dot(r, s) / norm(s)
    off = F.sqrt(F.greatest(F.lit(0.0), dot(r, r) - along * along))
    return F.when(along >= 0, "sunlit").when(off < SHADOW_KM, "eclipse").otherwise("sunlit")


def element_parts(r: Vec, v: Vec) -> dict[str, Column]:
    """What ``elements`` uses again and again: momentum, eccentricity vector, their sizes, energy."""
    h = cross(r, v)
    rm = norm(r)
    ev = [((dot(v, v) - MU / rm) * r[i] - dot(r, v) * v[i]) / MU for i in range(3)]
    sizes = {"rm": rm, "hm": norm(h), "nm": norm([-h[1], h[0], F.lit(0.0)]), "em": norm(ev), "energy": dot(v, v) / 2 - MU / rm}
    return {**{f"h{i}": x for i, x in enumerate(h)}, **{f"ev{i}": x for i, x in enumerate(ev)}, **sizes}


def elements(r: Vec, v: Vec, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """a, e, i, raan, aop, ta (km, degrees) with the circular and equatorial branches; null for a parabola or no orbit.

    ``parts``: the columns of ``element_parts`` where they are computed already, so that no branch computes them again.
    """
    parts = parts or element_parts(r, v)
    h, ev = ([parts[f"{n}{i}"] for i in range(3)] for n in ("h", "ev"))
    rm, hm, nm, e, energy = (parts[n] for n in ("rm", "hm", "nm", "em", "energy"))
    n = [-h[1], h[0], F.lit(0.0)]
    turn = lambda y, x: F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    tilted, oval = nm > TINY, e > TINY
    aop = F.when(oval & tilted, turn(dot(cross(n, ev), h) / (nm * e * hm), dot(n, ev) / (nm * e))).otherwise(0.0)
    ta = F.when(oval & tilted, turn(dot(cross(ev, r), h) / (e * rm * hm), dot(ev, r) / (e * rm))).when(oval, turn(ev[1], ev[0])).otherwise(turn(r[1], r[0]))
    some = (rm > 0) & (hm > TINY) & (F.abs(energy) > TINY)
    out = {"a": -MU / (2 * energy), "e": e, "i": F.degrees(F.acos(clipped(h[2] / hm, -1.0, 1.0))), "raan": F.when(tilted, turn(n[1], n[0])).otherwise(0.0), "aop": aop, "ta": ta}
    return {k: F.when(some, x) for k, x in out.items()}


def radial_basis(r: Vec, v: Vec) -> tuple[Vec, Vec, Vec]:
    """Unit vectors along radius, track and normal."""
    u, h = scaled(r, 1 / norm(r)), cross(r, v)
    w = scaled(h, 1 / norm(h))
    return u, cross(w, u), w


def inertial(parts: Vec, r: Vec, v: Vec) -> Vec:
    """A vector given along radius, track and normal, in the frame of r and v."""
    u, s, w = radial_basis(r, v)
    return [parts[0] * u[i] + parts[1] * s[i] + parts[2] * w[i] for i in range(3)]


def orbit_over(lat_deg: Column, lon_deg: Column, alt_km: Column, micros: Column, incl_deg: Column) -> tuple[Vec, Vec]:
    """State of the circular orbit over a ground point, rising eastward at an inclination (raised to reach the latitude)."""
    r = turned(of_geodetic(lat_deg, lon_deg, alt_km), -gmst(micros))
    rm, flat = norm(r), F.hypot(r[0], r[1])
    east = [F.when(flat < 1e-9, 1.0).otherwise(-r[1] / flat), F.when(flat < 1e-9, 0.0).otherwise(r[0] / flat), F.lit(0.0)]
    up = r[2] / (rm * rm)
    raw = [-up * r[0], -up * r[1], 1 - up * r[2]]
    size = norm(raw)
    north = [F.when(size < 1e-9, float(i == 1)).otherwise(x / size) for i, x in enumerate(raw)]
    incl = F.greatest(F.abs(lat_deg) + 0.5, incl_deg)
    heading = F.asin(clipped(F.cos(F.radians(incl)) / F.greatest(F.lit(1e-9), F.cos(F.radians(lat_deg))), -1.0, 1.0))
    speed = F.sqrt(MU / rm)
    return r, [(n * F.cos(heading) + e * F.sin(heading)) * speed for n, e in zip(north, east, strict=True)]


def hermite(s: Column, step: Column, p0: Column, d0: Column, p1: Column, d1: Column) -> tuple[Column, Column]:
    """Value and derivative of the cubic through two nodes with slopes, at the share s of the step."""
    value = (2 * s * s * s - 3 * s * s + 1) * p0 + (s * s * s - 2 * s * s + s) * step * d0 + (-2 * s * s * s + 3 * s * s) * p1 + (s * s * s - s * s) * step * d1
    slope = (6 * s * s - 6 * s) / step * p0 + (3 * s * s - 4 * s + 1) * d0 + (-6 * s * s + 6 * s) / step * p1 + (3 * s * s - 2 * s) * d1
    return value, slope


def time_grid(total: Column, step: Column, most: int) -> Column:
    """Array of times from 0: multiples of the step inside the window, at most ``most`` with the exact end last."""
    size = F.greatest(step, F.lit(1e-6))
    inner = F.least(F.floor(total / size), F.lit(max(2, most) - 2))
    times = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), inner), lambda k: k * size), lambda t: t < total - 1e-9)
    return F.when(total <= 0, F.array(F.lit(0.0))).otherwise(F.concat(times, F.array(total)))


def symmetric_grid(half: int, step: float) -> Column:
    """Times k * step for k from -half to half."""
    return F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: k * F.lit(step))
