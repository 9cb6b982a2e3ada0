"""Burns, engines and breakups as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import Vec, dot, norm

#: Standard gravity; share of the lead time and of the orbit that a burn may take.
G0, LEAD_SHARE, ARC_SHARE = 9.80665, 0.10, 0.10
#: Engine, specific impulse (s), thrust (N), practical for satellites.
ENGINES = (
    ("Aerojet Rocketdyne RL10B-2", 465.5, 110100.0, False),
    ("Aerojet R-4D-11", 312.0, 490.0, True),
    ("Aerojet AMBR", 333.0, 623.0, True),
    ("Aerojet MR-106L", 235.0, 22.0, True),
    ("Aerojet MR-103G", 224.0, 1.0, True),
    ("Bradford ECAPS 1N HPGP", 231.0, 1.0, True),
    ("Aerojet GR-1", 231.0, 1.0, True),
    ("Cold-gas N2 thruster", 65.0, 1.0, True),
    ("Fakel SPT-100", 1600.0, 0.083, True),
    ("Busek BHT-600", 1530.0, 0.039, True),
    ("NASA/L3 NSTAR", 3100.0, 0.092, True),
    ("QinetiQ T6", 4120.0, 0.145, True),
)
#: Sizes of candidate burns (m/s) and their directions along track, radius and normal.
BURN_MS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)
DIRECTIONS = ("+S", "-S", "+R", "-R", "+W", "-W")
#: Energy a target kilogram (J) from which a collision is catastrophic, share of the escape speed, gravity.
CATASTROPHIC_J_KG, ESCAPE_SHARE, MU = 40000.0, 0.99, 398600.8


def propellant(mass_kg: Column, dv_ms: Column, isp_s: Column) -> Column:
    """Propellant (kg) that the rocket equation asks for."""
    return mass_kg * -F.expm1(-F.abs(dv_ms) / (isp_s * G0))


def engine_rows(mass_kg: Column, dv_ms: Column, lead_s: Column, period_s: Column) -> Column:
    """Array of (propellant_kg, burn_s, engine, practical, ok), one entry an engine: a dimension of twelve rows, joined inside the row."""

    def row(e) -> Column:
        name, isp, thrust, practical = e
        need = propellant(mass_kg, dv_ms, F.lit(isp))
        burn = need * isp * G0 / thrust
        ok = (burn <= F.greatest(lead_s, F.lit(0.0)) * LEAD_SHARE) & (burn <= period_s * ARC_SHARE)
        return F.struct(need.alias("propellant_kg"), burn.alias("burn_s"), F.lit(name).alias("engine"), F.lit(practical).alias("practical"), ok.alias("ok"))

    return F.array(*map(row, ENGINES))


def engine_choice(rows: Column) -> Column:
    """Least propellant, then the shorter burn, of practical engines whose burn is short enough; else the shortest burn."""
    fit = F.array_min(F.transform(F.filter(rows, lambda e: e["practical"] & e["ok"]), lambda e: F.struct(e["propellant_kg"].alias("a"), e["burn_s"].alias("b"), e["engine"].alias("engine"))))
    short = F.array_min(F.transform(F.filter(rows, lambda e: e["practical"]), lambda e: F.struct(e["burn_s"].alias("a"), e["propellant_kg"].alias("b"), e["engine"].alias("engine"))))
    return F.coalesce(fit["engine"], short["engine"])


def collision(m1: Column, m2: Column, v_kms: Column) -> tuple[Column, Column, Column]:
    """Reference mass (kg), whether catastrophic, impact energy a target kilogram (J)."""
    small, large = F.least(m1, m2), F.greatest(m1, m2)
    emr = F.when(large > 0, 0.5 * small * (v_kms * 1000) * (v_kms * 1000) / large).otherwise(0.0)
    whole = emr >= CATASTROPHIC_J_KG
    return F.when(whole, large + small).otherwise(small * v_kms * v_kms), whole, emr


def bound_share(r_km: Column, v0: Vec, dv: Vec) -> Column:
    """Share of dv (0 to 1) that keeps v0 + dv below the escape speed: 1 where it is below anyway, else the root of a quadratic."""
    most = ESCAPE_SHARE * F.sqrt(2 * MU / r_km)
    a, b, c = dot(dv, dv), 2 * dot(v0, dv), dot(v0, v0) - most * most
    root = (-b + F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))) / (2 * a)
    over = norm([x + y for x, y in zip(v0, dv, strict=True)]) >= most
    return F.when(over, F.least(F.lit(1.0), F.greatest(F.lit(0.0), root))).otherwise(1.0)


#: Rules of authority in their order: the first that holds decides.
def authority(session: Column, known: Column, expired: Column, kind: Column, admin: Column, owner: Column, covers: Column, catalogued: Column, demo: int = 1, demo_open: bool = True) -> Column:
    """Name of the rule; demo_session, admin_session, agency_match and synthetic_object_no_owner allow the command; a closed demo session does not."""
    rule = F.when(session == demo, "demo_session" if demo_open else "demo_session_disabled").when(~known, "session_not_found").when(expired, "session_expired").when(kind.isin("DEB", "R/B"), "object_not_manoeuvrable").when(admin, "admin_session")
    rule = rule.when((owner != "Unknown") & covers, "agency_match").when((owner == "Unknown") & catalogued, "catalogued_owner_unresolved")
    return rule.when(owner == "Unknown", "synthetic_object_no_owner").otherwise("agency_mismatch")


ALLOWING = ("demo_session", "admin_session", "agency_match", "synthetic_object_no_owner")


def gates(miss_km: Column, tca_min: Column, perigee_km: Column, dv_ms: Column, need_kg: Column, load_kg: Column, allowed: Column, flown: Column, warning_km: float = 5.0) -> dict[str, Column]:
    """The six gates of a burn. Without a flown dry run the orbit's gates fail; no approach passes, no mass model does not."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    ran = yes(flown)
    out = {"trajectory_clear": ran & (miss_km.isNull() | (miss_km > warning_km)), "fuel_budget": need_kg <= load_kg, "agency_auth": allowed, "tca_window": ran & (tca_min.isNull() | (tca_min > 60))}
    out |= {"physical_limits": ran & (perigee_km >= 100) & (dv_ms <= 100), "sim_dryrun": ran}
    return {k: yes(c) for k, c in out.items()}
