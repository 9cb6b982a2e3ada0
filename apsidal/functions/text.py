"""Explanations of a zone in five paragraphs, as Column functions. A null or empty list has its own sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .encounters import floored, shown_countdown, shown_distance, shown_pc

# The sentences of the paragraphs.
NO_PLACE = "an unresolved location"
NO_APPROACH = "No conjunction inside this zone has a computed closest approach."
NO_MOVER = "No operational payload in this zone can manoeuvre (debris / rocket bodies only)."
COLD_ENGINES = ". Cryogenic LOX/LH2 has the best Isp but boils off, so it is listed for comparison only."
NO_BREAKUP, RUN_DEBRIS = "No breakup has been simulated yet. ", "Run the debris simulation to see the fragment cloud."
NO_OPTION = "No burn is proposed here, so nobody else's risk changes. "
NOT_RUN = "The 24 h secondary screening has not run for these options (time budget), so effects on others are unknown. "


def said(*parts: Column | str) -> Column:
    """Texts and Columns in a row; strings are literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def number(x: Column, digits: int) -> Column:
    return F.floor(x + 0.5).cast("string") if digits == 0 else F.format_string(f"%.{digits}f", floored(x, digits))


def spaced(word: Column) -> Column:
    return F.translate(word, "_", " ")


def listed(items: Column, one) -> Column:
    return F.array_join(F.transform(items, one), "; ")


def area(radius_km: Column, lat: Column, lon: Column, alt_km: Column, minutes: Column, source: Column, members: Column) -> Column:
    """Where the zone is and how large; no latitude means no place."""
    place = said(number(F.abs(lat), 2), "°", F.when(lat >= 0, "N").otherwise("S"), ", ", number(F.abs(lon), 2), "°", F.when(lon >= 0, "E").otherwise("W"), ", ", number(alt_km, 0), " km up")
    where = F.when(lat.isNull(), NO_PLACE).otherwise(place)
    return said("A sphere of radius ", shown_distance(radius_km), " centred at ", where, " at ", shown_countdown(minutes), ". The radius comes from ", spaced(source), "; ", members.cast("string"), " tracked object(s) are inside it at that instant.")


def debris(events: Column, forecast: Column, catastrophic: Column) -> Column:
    """The zone's events, each by its state: event_id, state, window_h, own, t_rel_s, fragments, inside, nearest_km, later (minutes, p90_km).

    Without events: ``forecast``, the fragments a collision would leave, if it is known and not 0. An event in another
    state says nothing.
    """

    def one(e: Column) -> Column:
        later = listed(F.filter(e["later"], lambda t: t["p90_km"].isNotNull()), lambda t: said(number(t["minutes"], 0), " min later the cloud's 90 % radius is ", shown_distance(t["p90_km"])))
        name = e["event_id"].cast("string")
        here = said("this is the breakup point of event ", name, ": ~", e["fragments"].cast("string"), " fragments ≥10 cm are released here", F.when(F.coalesce(later, F.lit("")) != "", said(" (", later, ")")).otherwise(""))
        held = said("~", e["inside"].cast("string"), " fragment(s) of event ", name, " are inside the zone (nearest ", shown_distance(e["nearest_km"]), ")")
        none = said("no fragment of event ", name, " is inside the zone at TCA (nearest ", shown_distance(e["nearest_km"]), ")")
        released = F.when(e["own"] & (F.abs(e["t_rel_s"]) <= 1.0), here).when(e["inside"] > 0, held).otherwise(none)
        beyond = said("this TCA is beyond the ", F.format_string("%d", e["window_h"].cast("long")), " h debris look-ahead, so fragments of event ", name, " were not propagated that far")
        return F.when(e["state"] == "not_yet_released", said("event ", name, " has not broken up yet at this time")).when(e["state"] == "outside_debris_window", beyond).when(e["state"] == "released", released)

    predicted = said("If this pair collided, the NASA breakup model predicts ~", forecast.cast("string"), " fragments ≥10 cm (", F.when(catastrophic, "catastrophic").otherwise("non-catastrophic"), ").")
    without = said(NO_BREAKUP, F.when(forecast > 0, predicted).otherwise(RUN_DEBRIS))
    return F.when(F.size(F.coalesce(events, F.array())) > 0, said("Debris layer: ", listed(events, one), ".")).otherwise(without)


def closest(first: Column, second: Column, miss_km: Column, speed: Column, minutes: Column, foster: Column, chan: Column, worst: Column, severity: Column, action: Column) -> Column:
    """How near the pair comes and how likely it collides; parts that are null are left out. No first name, no approach."""
    pace = F.when(speed.isNull(), said("apart (", shown_countdown(minutes), "). ")).otherwise(said("apart at ", number(speed, 1), " km/s (", shown_countdown(minutes), "). "))
    part = lambda head, x, text: F.when(x.isNull(), "").otherwise(said(head, text))
    odds = said("Collision probability (Foster) ", shown_pc(foster), part(", Chan ", chan, shown_pc(chan)), part(", worst-case (Alfano) ", worst, shown_pc(worst)))
    end = said("; severity ", F.coalesce(severity, F.lit("n/a")), part(", decision ", action, action), ".")
    return F.when(first.isNull(), NO_APPROACH).otherwise(said(first, " and ", second, " pass ", shown_distance(miss_km), " ", pace, odds, end))


def avoidance(movers: Column) -> Column:
    """Chosen burns of the zone's movers: name, status, candidate (null: none planned), dv_ms, miss_km, pc, safe, check, engine."""

    def burn(m: Column) -> Column:
        checked = F.when(m["safe"], "cascade-safe").when(~m["safe"], "NOT cascade-safe").otherwise(said("cascade check: ", spaced(F.coalesce(m["check"], F.lit("not run")))))
        return said(m["name"], ": ", m["candidate"], " (", number(m["dv_ms"], 2), " m/s) moves the miss to ", shown_distance(m["miss_km"]), " and Pc to ", shown_pc(m["pc"]), ", ", checked, "; engine ", F.coalesce(m["engine"], F.lit("n/a")))

    planned = F.filter(movers, lambda m: m["candidate"].isNotNull())
    burns = said("Re-propagated avoidance burns — ", listed(planned, burn), COLD_ENGINES)
    none = said("No burn was planned: ", listed(movers, lambda m: said(m["name"], " (", spaced(m["status"]), ")")), ".")
    return F.when(F.size(planned) > 0, burns).when(F.size(movers) > 0, none).otherwise(NO_MOVER)


def effect(options: Column, checked: Column, secondaries: Column, unsafe: Column, downstream: Column) -> Column:
    """What the burns do to others and what lies downstream."""
    ran = said("Each option was re-screened for 24 h against the catalogue and live fragments: ", secondaries.cast("string"), " new or worsened close approach(es) found, ", unsafe.cast("string"), " option(s) unsafe. ")
    head = F.when(F.coalesce(options, F.lit(0)) == 0, NO_OPTION).when(checked > 0, ran).otherwise(NOT_RUN)
    return said(head, downstream.cast("string"), " object(s) are downstream of this zone in the cascade graph.")
