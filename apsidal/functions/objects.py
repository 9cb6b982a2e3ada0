"""What a catalogue record says about an object: identifiers, type, owner, size and mass, as Column functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of owner codes, and codes that name no owner.
OWNER_LABELS = {
    "US": "USA", "CIS": "Russia/CIS", "PRC": "China", "IND": "India", "ISRO": "India", "JPN": "Japan", "FR": "France", "UK": "UK", "ESA": "ESA", "ESRO": "ESA", "ISS": "ISS",
    "ITSO": "Intelsat", "GLOB": "Globalstar", "IRID": "Iridium", "ORB": "ORBCOMM", "O3B": "SES", "SES": "SES", "EUTE": "Eutelsat", "EUME": "EUMETSAT", "IM": "Inmarsat",
    "AB": "Arabsat", "AC": "AsiaSat", "ABS": "ABS", "SKOR": "South Korea", "ROC": "Taiwan", "GER": "Germany", "IT": "Italy", "CA": "Canada", "SPN": "Spain", "AUS": "Australia",
    "NATO": "NATO", "SEAL": "Sea Launch",
}
#: Names of owner codes in the public catalogue, used where there is no label.
OWNER_NAMES = {
    "AB": "Arab Satellite Communications Organization", "ABS": "Asia Broadcast Satellite", "AC": "Asia Satellite Telecommunications Company (ASIASAT)", "ALG": "Algeria", "ANG": "Angola",
    "ARGN": "Argentina", "ARM": "Republic of Armenia", "ASRA": "Austria", "AUS": "Australia", "AZER": "Azerbaijan", "BEL": "Belgium", "BELA": "Belarus", "BERM": "Bermuda",
    "BGD": "Peoples Republic of Bangladesh", "BHR": "The Kingdom of Bahrain", "BHUT": "The Kingdom of Bhutan", "BOL": "Bolivia", "BRAZ": "Brazil", "BUL": "Bulgaria", "BWA": "Republic of Botswana",
    "CA": "Canada", "CHBZ": "China/Brazil", "CHTU": "China/Türkiye", "CHLE": "Chile", "CIS": "Commonwealth of Independent States (former USSR)", "COL": "Colombia", "CRI": "Republic of Costa Rica",
    "CZCH": "Czech Republic (former Czechoslovakia)", "DEN": "Denmark", "DJI": "Republic of Djibouti", "ECU": "Ecuador", "EGYP": "Egypt", "ESA": "European Space Agency",
    "ESRO": "European Space Research Organization", "EST": "Estonia", "ETH": "Ethiopia", "EUME": "European Organization for the Exploitation of Meteorological Satellites (EUMETSAT)",
    "EUTE": "European Telecommunications Satellite Organization (EUTELSAT)", "FGER": "France/Germany", "FIN": "Finland", "FR": "France", "FRIT": "France/Italy", "GER": "Germany",
    "GHA": "Republic of Ghana", "GLOB": "Globalstar", "GREC": "Greece", "GRSA": "Greece/Saudi Arabia", "GUAT": "Guatemala", "HRV": "Republic of Croatia", "HUN": "Hungary",
    "IM": "International Mobile Satellite Organization (INMARSAT)", "IND": "India", "INDO": "Indonesia", "IRAN": "Iran", "IRAQ": "Iraq", "IRID": "Iridium", "IRL": "Ireland", "ISRA": "Israel",
    "ISRO": "Indian Space Research Organisation", "ISS": "International Space Station", "IT": "Italy", "ITSO": "International Telecommunications Satellite Organization (INTELSAT)", "JPN": "Japan",
    "KAZ": "Kazakhstan", "KEN": "Republic of Kenya", "LAOS": "Laos", "LKA": "Democratic Socialist Republic of Sri Lanka", "LTU": "Lithuania", "LUXE": "Luxembourg", "MA": "Morocco", "MALA": "Malaysia",
    "MCO": "Principality of Monaco", "MDA": "Republic of Moldova", "MEX": "Mexico", "MMR": "Republic of the Union of Myanmar", "MNE": "Montenegro", "MNG": "Mongolia", "MUS": "Mauritius",
    "NATO": "North Atlantic Treaty Organization", "NETH": "Netherlands", "NICO": "New ICO", "NIG": "Nigeria", "NKOR": "Democratic People's Republic of Korea", "NOR": "Norway",
    "NPL": "Federal Democratic Republic of Nepal", "NZ": "New Zealand", "O3B": "O3b Networks", "ORB": "ORBCOMM", "PAKI": "Pakistan", "PERU": "Peru", "POL": "Poland", "POR": "Portugal",
    "PRC": "People's Republic of China", "PRY": "Republic of Paraguay", "PRES": "People's Republic of China/European Space Agency", "QAT": "State of Qatar", "RASC": "RascomStar-QAF",
    "ROC": "Taiwan (Republic of China)", "ROM": "Romania", "RP": "Philippines (Republic of the Philippines)", "RWA": "Republic of Rwanda", "SAFR": "South Africa", "SAUD": "Saudi Arabia",
    "SDN": "Republic of Sudan", "SEAL": "Sea Launch", "SEN": "Republic of Senegal", "SES": "SES", "SGJP": "Singapore/Japan", "SING": "Singapore", "SKOR": "Republic of Korea", "SLB": "Solomon Islands",
    "SPN": "Spain", "STCT": "Singapore/Taiwan", "SVN": "Slovenia", "SWED": "Sweden", "SWTZ": "Switzerland", "TBD": "To Be Determined", "THAI": "Thailand", "TMMC": "Turkmenistan/Monaco",
    "TUN": "Republic of Tunisia", "TURK": "Türkiye", "UAE": "United Arab Emirates", "UK": "United Kingdom", "UKR": "Ukraine", "UNK": "Unknown", "URY": "Uruguay", "US": "United States",
    "USBZ": "United States/Brazil", "VAT": "Vatican City State", "VENZ": "Venezuela", "VTNM": "Vietnam", "ZWE": "Republic of Zimbabwe",
}
UNRESOLVED = ("", "TBD", "UNK")
#: Operators by name pattern, first match wins, with the owner codes they are accepted for (none: any).
#: One constellation of the ESA row is left out here; callers that need it pass their own table.
OPERATORS = (
    (r"\bSTARLINK\b", "SpaceX", ("US",)),
    (r"\bDRAGON\b|\bSPACEX\b", "SpaceX", ("US",)),
    (r"\bKUIPER\b", "Amazon", ("US",)),
    (r"\bIRIDIUM\b", "Iridium", ("US", "IRID")),
    (r"\bONEWEB\b", "OneWeb", ("UK",)),
    (r"\bNAVSTAR\b|\bGPS\b|^USA \d+|\bMILSTAR\b|\bMUOS\b|\bWGS\b|\bSBIRS\b|\bDMSP\b", "US Space Force", ("US",)),
    (r"\bNOAA\b|\bGOES\b|\bSUOMI\b|\bJPSS\b", "NOAA", ("US",)),
    (r"\bHST\b|\bHUBBLE\b|\bTERRA\b|\bAQUA\b|\bAURA\b|\bLANDSAT\b|\bSWIFT\b|\bTDRS\b|\bICESAT\b", "NASA", ("US",)),
    (r"\bISS\b|\bZARYA\b", "ISS", ("ISS",)),
    (r"\bGAIA\b|\bENVISAT\b|\bCRYOSAT\b|\bSWARM\b|\bGALILEO\b", "ESA", ()),
    (r"\bCOSMOS\b|\bKOSMOS\b|\bGLONASS\b|\bRESURS\b|\bMETEOR\b|\bELEKTRO\b|\bSOYUZ\b|\bPROGRESS\b", "Russia/CIS", ("CIS",)),
    (r"\bFENGYUN\b|\bYAOGAN\b|\bTIANGONG\b|\bTIANHE\b|\bBEIDOU\b|\bSHIYAN\b|\bCZ-", "China", ("PRC",)),
    (r"\bGSAT\b|\bINSAT\b|\bCARTOSAT\b|\bRESOURCESAT\b|\bRISAT\b|\bIRNSS\b|\bOCEANSAT\b", "India", ("IND", "ISRO")),
)
#: Names of older clients and the labels that they cover.
ALIASES = {"ROSCOSMOS": ("Russia/CIS",), "CNSA": ("China",), "ISRO": ("India",), "ISS/NASA": ("ISS", "NASA"), "UNKNOWN": ("Unknown",)}
#: Radii (m) of large structures, of size classes and of types; masses (kg) and hard-body radii (m).
STRUCTURE_M = {"ISS": 55.0, "ZARYA": 55.0, "TIANHE": 20.0, "CSS": 20.0}
RADIUS_M = {"PAY": 5.0, "R/B": 4.0, "DEB": 0.5, "UNK": 1.0}
RCS_RADIUS_M = {"SMALL": math.sqrt(0.1 / math.pi), "MEDIUM": math.sqrt(1.0 / math.pi)}
MASS_KG = {"PAY": 800.0, "R/B": 1500.0, "DEB": 20.0, "UNK": 500.0}
HBR_M = {"PAY": 2.0, "R/B": 3.0, "DEB": 0.5, "UNK": 2.0}
RCS_MASS_KG = {"SMALL": 50.0, "MEDIUM": 500.0, "LARGE": 2000.0}
RCS_HBR_M = {"SMALL": 0.5, "MEDIUM": 1.5, "LARGE": 4.0}
#: Wet mass (kg), specific impulse (s) and propellant share by name prefix and by size class.
CRAFT = {"ISS": (420000.0, 300.0, 0.02), "STARLINK": (306.0, 1500.0, 0.05), "ONEWEB": (147.0, 1500.0, 0.05), "IRIDIUM": (860.0, 220.0, 0.10)}
CRAFT_RCS_KG = {"SMALL": 20.0, "MEDIUM": 300.0, "LARGE": 1500.0}


def looked(key: Column, table: dict) -> Column:
    """The value of a small fixed table; null where it has none."""
    return reduce(lambda done, kv: done.when(key == kv[0], kv[1]), list(table.items())[1:], F.when(key == next(iter(table)), table[next(iter(table))]))


def upper(name: Column) -> Column:
    return F.upper(F.coalesce(name, F.lit("")))


def cospar_id(line1: Column) -> Column:
    """Launch year, number and piece from columns 10-17 of an element line; two-digit years from 57 are of 1957 on."""
    field = F.trim(F.substring(line1, 10, 8))
    yy = F.substring(field, 1, 2).try_cast("int")
    return F.when((F.length(line1) >= 17) & (F.length(field) >= 5) & F.substring(field, 1, 2).rlike("^[0-9]{2}$"), F.concat(F.when(yy >= 57, yy + 1900).otherwise(yy + 2000).cast("string"), F.lit("-"), F.substring(field, 3, 99)))


def type_of_catalogue(name: Column) -> Column:
    """Type from the name as the catalogue reads it."""
    n = upper(name)
    return F.when((n == "") | n.startswith("TBA") | n.startswith("OBJECT "), "UNK").when(n.contains(" DEB") | n.startswith("DEB") | n.contains("(DEB"), "DEB").when(n.contains("R/B") | n.contains(" AKM") | n.contains(" PKM"), "R/B").otherwise("PAY")


def type_of_screening(name: Column) -> Column:
    """Type from the name as screening reads it: motors need no space before them, unnamed is unknown."""
    n = upper(name)
    return F.when(n.contains(" DEB") | n.startswith("DEB") | n.contains("(DEB"), "DEB").when(n.contains("R/B") | n.contains("AKM") | n.contains("PKM"), "R/B").when(n == "", "UNK").otherwise("PAY")


def type_of_breakup(name: Column) -> Column:
    """Type from the name as breakup reads it: fragments are debris, whatever else is unknown."""
    n = upper(name)
    return F.when(n.contains(" DEB") | n.endswith("DEB") | n.contains("FRAG"), "DEB").when(n.contains("R/B") | n.contains("ROCKET BODY"), "R/B").otherwise("UNK")


def type_of_tracker(name: Column) -> Column:
    """Type from the words of the name."""
    n = upper(name)
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(n, r"[()]", " "), r"\s+", " ")), " ")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    return F.when(has("R/B", "AKM", "PKM") | n.contains("ROCKET BODY"), "R/B").when(has("DEB", "DEBRIS") | n.contains("FRAG"), "DEB").when((n == "") | n.startswith("UNKNOWN") | n.startswith("TBA"), "UNK").otherwise("PAY")


def known_type(record: Column) -> Column:
    """A catalogue type in either spelling; null stays null, other words are unknown."""
    t = F.upper(record)
    return F.when(t.isin("PAY", "PAYLOAD"), "PAY").when(t.isin("R/B", "ROCKET BODY"), "R/B").when(t.isin("DEB", "DEBRIS"), "DEB").when(t.isNotNull() & (t != ""), "UNK")


def radius(name: Column, rcs: Column, kind: Column) -> tuple[Column, Column]:
    """Radius (m) and where it comes from: known structure, size class, type."""
    n = upper(name)
    big = reduce(lambda done, kv: done.when(n.startswith(kv[0]) | n.contains(f"({kv[0]})"), kv[1]), list(STRUCTURE_M.items())[1:], F.when(n.startswith("ISS") | n.contains("(ISS)"), STRUCTURE_M["ISS"]))
    of_class = F.when(rcs == "LARGE", F.greatest(F.lit(1.0), looked(kind, RADIUS_M))).otherwise(looked(rcs, RCS_RADIUS_M))
    return F.coalesce(big, of_class, looked(kind, RADIUS_M)), F.when(big.isNotNull(), "known_structure").when(of_class.isNotNull(), "satcat_rcs").otherwise("type_default")


def physical(scenario_mass: Column, listed: Column, rcs: Column, name: Column) -> tuple[Column, Column, Column, Column]:
    """Mass (kg), hard-body radius (m), type and source: scenario, size class, listed type, name, default."""
    named, kind = type_of_breakup(name), known_type(listed)
    source = F.when(scenario_mass.isNotNull(), "scenario_config").when(looked(rcs, RCS_MASS_KG).isNotNull(), F.concat(F.lit("satcat_rcs_"), F.lower(rcs))).when(kind.isNotNull(), "satcat_object_type").when(named == "UNK", "default").otherwise("default_by_name_type")
    of = lambda by_class, by_type: F.coalesce(looked(rcs, by_class), looked(kind, by_type), looked(named, by_type))
    kinds = F.when(scenario_mass.isNotNull(), "PAY").otherwise(F.coalesce(kind, F.when(looked(rcs, RCS_MASS_KG).isNotNull(), "UNK"), named))
    return F.coalesce(scenario_mass, of(RCS_MASS_KG, MASS_KG)), F.when(scenario_mass.isNotNull(), HBR_M["PAY"]).otherwise(of(RCS_HBR_M, HBR_M)), kinds, source


def craft(name: Column, rcs: Column, launch_year: Column) -> tuple[Column, Column, Column]:
    """Wet mass (kg), specific impulse (s), propellant share: by name prefix, then size class, then default."""
    n = upper(name)
    by = lambda i: reduce(lambda done, kv: done.when(n.startswith(kv[0]), kv[1][i]), list(CRAFT.items())[1:], F.when(n.startswith("ISS"), CRAFT["ISS"][i]))
    heavy = n.startswith("STARLINK") & (launch_year >= 2023)
    return F.when(heavy, 800.0).otherwise(F.coalesce(by(0), looked(rcs, CRAFT_RCS_KG), F.lit(500.0))), F.coalesce(by(1), F.lit(220.0)), F.coalesce(by(2), F.lit(0.10))


def owner_label(code: Column) -> Column:
    """The label of an owner code, else its name in the catalogue, else the code."""
    known = F.create_map(*[F.lit(x) for kv in (OWNER_NAMES | OWNER_LABELS).items() for x in kv])
    return F.when(code.isNull() | code.isin(*UNRESOLVED), "Unknown").otherwise(F.coalesce(F.element_at(known, code), code))


def operator(name: Column, code: Column, operators: Sequence[tuple] = OPERATORS) -> Column:
    """The first pattern that the name matches and the owner code allows; no code allows any."""
    n, out = upper(name), None
    for pattern, label, owners in operators:
        fits = n.rlike(pattern) & (code.isNull() | code.isin(*owners) if owners else F.lit(True))
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out


def agency(name: Column, code_by_id: Column, code_by_name: Column, operators: Sequence[tuple] = OPERATORS) -> tuple[Column, Column]:
    """Agency and provenance: owner by id, else by name, refined by operator; unresolved owners and none by pattern."""
    code = F.coalesce(code_by_id, code_by_name)
    how = F.when(code_by_id.isNotNull(), "satcat_id").when(code_by_name.isNotNull(), "satcat_name").otherwise("none")
    refined, guessed = operator(name, code, operators), operator(name, F.lit(None).cast("string"), operators)
    settled = code.isNotNull() & ~code.isin(*UNRESOLVED)
    label = F.when(code.isNotNull() & refined.isNotNull(), refined).when(settled, owner_label(code)).otherwise(F.coalesce(guessed, F.lit("Unknown")))
    return label, F.when(code.isNotNull() & refined.isNotNull(), F.concat(how, F.lit("+operator_pattern"))).when(settled, how).when(guessed.isNotNull(), "name_pattern").otherwise(how)


def aliases(label: Column) -> Column:
    """The labels that a name of an older client covers; any other name covers itself."""
    out = None
    for old, new in ALIASES.items():
        values = F.array(*map(F.lit, new))
        out = F.when(F.upper(label) == old, values) if out is None else out.when(F.upper(label) == old, values)
    return out.otherwise(F.array(label))
