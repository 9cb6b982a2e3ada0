"""Queries over catalogue records: files, identifiers, types, owners, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import objects as O
from ..functions.encounters import rcs_class
from ..operators.graph import checkpoint
from ..sources.catalogue import SNAPSHOT_COLUMNS, element_names, element_sets, snapshot, snapshot_lines, typed_catalogue
from ..sources.derived import CATALOGUE_SQL, catalogue, table
from .catalog import query

RCS_SQL = "CASE WHEN rcs_m2 < 0.1 THEN 'SMALL' WHEN rcs_m2 < 1 THEN 'MEDIUM' WHEN rcs_m2 IS NOT NULL THEN 'LARGE' END"
#: Lines of element files: a triple per record, with stray lines, blank lines and an unreadable number between.
LINES_SQL = f"""{CATALOGUE_SQL}, lines AS (SELECT 'f' || id % 3 AS file, id * 10 + k AS line_no, CASE k WHEN 0 THEN '0 ' || coalesce(name, 'N ' || id) WHEN 1 THEN CASE WHEN id % 6 = 0 THEN '' ELSE '  1 ' || CASE WHEN id % 9 = 0 THEN 'x1234' ELSE lpad(CAST(id % 100000 AS STRING), 5, '0') END || 'U ' END
 WHEN 2 THEN CASE WHEN id % 7 = 0 THEN '# stray' ELSE '1 ' || lpad(CAST(id % 100000 AS STRING), 5, '0') || 'U' END ELSE '2 ' || id || '  ' END AS line FROM catalogue CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) WHERE NOT (id % 6 <> 0 AND k = 2))"""


def element_lines(spark, sf_dir):
    c = catalogue(spark, sf_dir).selectExpr("id", "name", "explode(array(0, 1, 2, 3)) AS k").where("NOT (id % 6 <> 0 AND k = 2)")
    return c.selectExpr("'f' || id % 3 AS file", "id * 10 + k AS line_no", "CASE k WHEN 0 THEN '0 ' || coalesce(name, 'N ' || id) WHEN 1 THEN CASE WHEN id % 6 = 0 THEN '' ELSE '  1 ' || CASE WHEN id % 9 = 0 THEN 'x1234' ELSE lpad(CAST(id % 100000 AS STRING), 5, '0') END || 'U ' END WHEN 2 THEN CASE WHEN id % 7 = 0 THEN '# stray' ELSE '1 ' || lpad(CAST(id % 100000 AS STRING), 5, '0') || 'U' END ELSE '2 ' || id || '  ' END AS line")


SETS_SQL = f"""{LINES_SQL}, kept AS (SELECT file, line_no, trim(line) AS line FROM lines WHERE trim(line) <> ''), ahead AS (SELECT *, lead(line, 1) OVER w AS line1, lead(line, 2) OVER w AS line2 FROM kept WINDOW w AS (PARTITION BY file ORDER BY line_no)),
sets AS (SELECT file, line_no, trim(substr(line, 3)) AS name, coalesce(TRY_CAST(trim(substr(line1, 3, 5)) AS BIGINT), 0) AS norad_id, line1, line2 FROM ahead WHERE line LIKE '0 %' AND line1 LIKE '1 %' AND line2 LIKE '2 %')"""


@query(f"WITH {SETS_SQL} SELECT * FROM sets")
def element_file_parse(spark, sf_dir):
    """Three-line element sets out of lines with strays, blanks and broken numbers."""
    return element_sets(element_lines(spark, sf_dir))


CSV_SQL = f"""{CATALOGUE_SQL}, raw AS (SELECT CASE WHEN id % 13 = 0 THEN 'n/a' ELSE ' ' || id END AS norad_id, name, lower(listed_type) AS object_type, owner, CASE WHEN id % 4 = 0 THEN '' ELSE launch_year || '-01-02' END AS launch_date, CASE WHEN id % 10 = 0 THEN 'big' ELSE CAST(id % 40 AS STRING) END AS rcs_m2 FROM catalogue),
typed AS (SELECT TRY_CAST(trim(norad_id) AS BIGINT) AS norad_id, nullif(trim(name), '') AS name, upper(nullif(trim(object_type), '')) AS object_type, nullif(trim(owner), '') AS owner, TRY_CAST(substr(launch_date, 1, 4) AS INT) AS launch_year, TRY_CAST(trim(rcs_m2) AS DOUBLE) AS rcs_m2 FROM raw)"""


def catalogue_rows(spark, sf_dir):
    return typed_catalogue(catalogue(spark, sf_dir).selectExpr("CASE WHEN id % 13 = 0 THEN 'n/a' ELSE ' ' || id END AS norad_id", "name", "lower(listed_type) AS object_type", "owner", "CASE WHEN id % 4 = 0 THEN '' ELSE launch_year || '-01-02' END AS launch_date", "CASE WHEN id % 10 = 0 THEN 'big' ELSE CAST(id % 40 AS STRING) END AS rcs_m2"))


@query(f"WITH {CSV_SQL} SELECT * FROM typed WHERE norad_id IS NOT NULL")
def catalogue_scan(spark, sf_dir):
    """Typed records; rows with a bad id go, bad fields are null."""
    return catalogue_rows(spark, sf_dir)


@query(f"WITH {CSV_SQL.replace('catalogue AS (', 'catalogue AS MATERIALIZED (', 1)}, {SETS_SQL.split(', lines AS', 1)[1].join(['lines AS', ''])} SELECT * FROM typed WHERE norad_id IN (SELECT norad_id FROM sets)")
def catalogue_snapshot(spark, sf_dir):
    """The records of objects that the element files track."""
    return snapshot(catalogue_rows(spark, sf_dir), element_sets(element_lines(spark, sf_dir)))


#: A catalogue file with all its columns, in SQL that both engines read; one site holds a comma.
PUBLIC = {
    "NORAD_CAT_ID": "CASE WHEN id % 13 = 0 THEN 'n/a' ELSE ' ' || id END",
    "OBJECT_NAME": "name",
    "OBJECT_ID": "launch_year || '-' || tail || 'A'",
    "OBJECT_TYPE": "CASE id % 4 WHEN 0 THEN 'PAY' WHEN 1 THEN 'R/B' WHEN 2 THEN 'DEB' ELSE 'UNK' END",
    "OPS_STATUS_CODE": "CASE id % 3 WHEN 0 THEN '+' WHEN 1 THEN ' D ' END",
    "OWNER": "owner",
    "LAUNCH_DATE": "launch_year || '-01-02'",
    "LAUNCH_SITE": "CASE WHEN id % 6 = 0 THEN 'TTMTR, S' ELSE 'AFETR' END",
    "DECAY_DATE": "CASE WHEN id % 5 = 0 THEN '2020-03-04' END",
    "PERIOD": "CAST(90 + id % 30 AS STRING) || '.5'",
    "INCLINATION": "CAST(id % 100 AS STRING) || '.25 '",
    "APOGEE": "CAST(400 + id % 900 AS STRING)",
    "PERIGEE": "CAST(300 + id % 90 AS STRING)",
    "RCS": "CASE WHEN id % 10 <> 0 THEN CAST(id % 40 AS STRING) || '.1' END",
}
_FIELD = "CASE WHEN contains({0}, ',') THEN '\"' || trim({0}) || '\"' ELSE coalesce(trim({0}), '') END"


@query(f"""WITH {SETS_SQL}, public AS (SELECT {', '.join(f'{e} AS {n}' for n, e in PUBLIC.items())} FROM catalogue)
SELECT TRY_CAST(trim(NORAD_CAT_ID) AS BIGINT) AS norad_id, {" || ',' || ".join(_FIELD.format(n) for n in SNAPSHOT_COLUMNS)} AS line FROM public WHERE TRY_CAST(trim(NORAD_CAT_ID) AS BIGINT) IN (SELECT norad_id FROM sets)""")
def catalogue_lines(spark, sf_dir):
    """Lines of a snapshot with all fourteen columns, for the objects that the element files track."""
    raw = catalogue(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in PUBLIC.items()])
    return snapshot_lines(raw, element_sets(element_lines(spark, sf_dir)))


_ALPHA = "ABCDEFGHJKLMNPQRSTUVWXYZ"
#: Lines of an index file: some numbers with a letter, some lines 1 without a name of their own, some unreadable.
INDEX_SQL = f"""{CATALOGUE_SQL}, index_lines AS (SELECT 'f' || id % 3 AS file, id * 10 + k AS line_no, CASE k WHEN 0 THEN CASE WHEN id % 6 = 5 THEN '# none' ELSE '0 ' || coalesce(name, 'N ' || id) || ' ' END WHEN 1 THEN '1 ' || CASE WHEN id % 9 = 0 THEN 'I1234' WHEN id % 4 = 1 THEN substr('{_ALPHA}', CAST(id % 24 + 1 AS INT), 1) || lpad(CAST(id % 10000 AS STRING), 4, '0') WHEN id % 11 = 0 THEN '  ' || lpad(CAST(id % 1000 AS STRING), 3, '0') ELSE lpad(CAST(id % 100000 AS STRING), 5, '0') END || 'U  ' ELSE '2 x' END AS line FROM catalogue CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))"""


def index_lines(spark, sf_dir):
    c = catalogue(spark, sf_dir).selectExpr("id", "name", "explode(array(0, 1, 2)) AS k")
    return c.selectExpr("'f' || id % 3 AS file", "id * 10 + k AS line_no", INDEX_SQL.split(" AS line_no, ", 1)[1].split(" AS line FROM", 1)[0] + " AS line")


@query(f"""WITH {INDEX_SQL}, held AS (SELECT file, line_no, line, last_value(CASE WHEN line LIKE '0 %' THEN trim(substr(line, 3)) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS name, trim(substr(line, 3, 5)) AS f FROM index_lines),
numbers AS (SELECT *, CASE WHEN instr('{_ALPHA}', upper(substr(f, 1, 1))) > 0 THEN (instr('{_ALPHA}', upper(substr(f, 1, 1))) + 9) * 10000 + TRY_CAST(substr(f, 2) AS BIGINT) ELSE TRY_CAST(f AS BIGINT) END AS n FROM held WHERE line LIKE '1 %')
SELECT n AS norad_id, arg_max(coalesce(name, ''), (file, line_no)) AS name, arg_max(rtrim(line), (file, line_no)) AS line1 FROM numbers WHERE n IS NOT NULL GROUP BY n""")
def element_index(spark, sf_dir):
    """Name and first line by catalogue number, letters decoded; of repeated numbers the last line counts."""
    return element_names(index_lines(spark, sf_dir))


@query("SELECT c_custkey AS id, 'crossing-' || c_custkey AS name, CAST(c_custkey % 90 AS BIGINT) AS minutes, [CAST(1 AS DOUBLE), CAST(c_custkey % 15 AS DOUBLE)][2] AS max_speed, '{\"id\":' || c_custkey || ',\"name\":\"crossing-' || c_custkey || '\",\"minutes\":' || c_custkey % 90 || '}' AS compact FROM customer")
def scenario_json(spark, sf_dir):
    """Scenario documents as JSON text, read with a schema, and written back without spaces."""
    docs = table(spark, sf_dir, "customer").select(F.format_string('{"id": %d, "name": "crossing-%d", "crossing": {"encounter_minutes": %d, "rel_speed_kms_range": [1.0, %d.0]}}', "c_custkey", "c_custkey", F.col("c_custkey") % 90, F.col("c_custkey") % 15).alias("doc"))
    read = docs.select(F.from_json("doc", "id long, name string, crossing struct<encounter_minutes: long, rel_speed_kms_range: array<double>>").alias("s")).select("s.*")
    out = read.select("id", "name", F.col("crossing.encounter_minutes").alias("minutes"), F.element_at("crossing.rel_speed_kms_range", 2).alias("max_speed"))
    return out.withColumn("compact", F.to_json(F.struct("id", "name", "minutes")))


@query(f"WITH {CATALOGUE_SQL} SELECT id, CASE WHEN yy >= 57 THEN 1900 + yy ELSE 2000 + yy END || '-' || tail || CASE WHEN id % 2 = 0 THEN 'A' ELSE 'BC' END AS cospar FROM (SELECT *, launch_year % 100 AS yy FROM catalogue)")
def cospar_ids(spark, sf_dir):
    """International designators from first lines."""
    line = F.concat(F.lit("1 25544U "), F.lpad((F.col("launch_year") % 100).cast("string"), 2, "0"), F.col("tail"), F.when(F.col("id") % 2 == 0, "A  ").otherwise("BC "), F.lit(" 24001.5"))
    return catalogue(spark, sf_dir).select("id", O.cospar_id(line).alias("cospar"))


@query(f"""WITH {CATALOGUE_SQL}, n AS (SELECT id, upper(coalesce(name, '')) AS n, string_split(trim(regexp_replace(regexp_replace(upper(coalesce(name, '')), '[()]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM catalogue)
SELECT id, CASE WHEN n = '' OR n LIKE 'TBA%' OR n LIKE 'OBJECT %' THEN 'UNK' WHEN n LIKE '% DEB%' OR n LIKE 'DEB%' OR n LIKE '%(DEB%' THEN 'DEB' WHEN n LIKE '%R/B%' OR n LIKE '% AKM%' OR n LIKE '% PKM%' THEN 'R/B' ELSE 'PAY' END AS by_catalogue,
 CASE WHEN n LIKE '% DEB%' OR n LIKE 'DEB%' OR n LIKE '%(DEB%' THEN 'DEB' WHEN n LIKE '%R/B%' OR n LIKE '%AKM%' OR n LIKE '%PKM%' THEN 'R/B' WHEN n = '' THEN 'UNK' ELSE 'PAY' END AS by_screening,
 CASE WHEN n LIKE '% DEB%' OR n LIKE '%DEB' OR n LIKE '%FRAG%' THEN 'DEB' WHEN n LIKE '%R/B%' OR n LIKE '%ROCKET BODY%' THEN 'R/B' ELSE 'UNK' END AS by_breakup,
 CASE WHEN list_has_any(w, ['R/B', 'AKM', 'PKM']) OR n LIKE '%ROCKET BODY%' THEN 'R/B' WHEN list_has_any(w, ['DEB', 'DEBRIS']) OR n LIKE '%FRAG%' THEN 'DEB' WHEN n = '' OR n LIKE 'UNKNOWN%' OR n LIKE 'TBA%' THEN 'UNK' ELSE 'PAY' END AS by_tracker FROM n""")
def object_types(spark, sf_dir):
    """The four readings of an object's type from its name."""
    n = F.col("name")
    return catalogue(spark, sf_dir).select("id", O.type_of_catalogue(n).alias("by_catalogue"), O.type_of_screening(n).alias("by_screening"), O.type_of_breakup(n).alias("by_breakup"), O.type_of_tracker(n).alias("by_tracker"))


@query(f"WITH {CATALOGUE_SQL} SELECT id, coalesce({RCS_SQL}, 'UNKNOWN') AS rcs_class FROM catalogue")
def rcs_classes(spark, sf_dir):
    return catalogue(spark, sf_dir).select("id", rcs_class(F.col("rcs_m2")).alias("rcs_class"))


def _rcs():
    return F.nullif(rcs_class(F.col("rcs_m2")), F.lit("UNKNOWN"))


KNOWN_SQL = "CASE WHEN upper(listed_type) IN ('PAY', 'PAYLOAD') THEN 'PAY' WHEN upper(listed_type) IN ('R/B', 'ROCKET BODY') THEN 'R/B' WHEN upper(listed_type) IN ('DEB', 'DEBRIS') THEN 'DEB' WHEN listed_type <> '' THEN 'UNK' END"


@query(f"""WITH {CATALOGUE_SQL}, n AS (SELECT id, upper(coalesce(name, '')) AS n, {RCS_SQL} AS rcs, {KNOWN_SQL} AS listed FROM catalogue), k AS (SELECT *, coalesce(listed, CASE WHEN n LIKE '% DEB%' OR n LIKE 'DEB%' OR n LIKE '%(DEB%' THEN 'DEB' WHEN n LIKE '%R/B%' OR n LIKE '%AKM%' OR n LIKE '%PKM%' THEN 'R/B' WHEN n = '' THEN 'UNK' ELSE 'PAY' END) AS kind FROM n),
t AS (SELECT *, CASE kind WHEN 'PAY' THEN 5.0 WHEN 'R/B' THEN 4.0 WHEN 'DEB' THEN 0.5 ELSE 1.0 END AS own, CASE WHEN n LIKE 'ISS%' OR n LIKE '%(ISS)%' OR n LIKE 'ZARYA%' OR n LIKE '%(ZARYA)%' THEN 55.0 WHEN n LIKE 'TIANHE%' OR n LIKE '%(TIANHE)%' OR n LIKE 'CSS%' OR n LIKE '%(CSS)%' THEN 20.0 END AS big FROM k)
SELECT id, kind AS object_type, CAST(floor(CASE WHEN big IS NOT NULL THEN big WHEN rcs = 'SMALL' THEN sqrt(0.1 / pi()) WHEN rcs = 'MEDIUM' THEN sqrt(1 / pi()) WHEN rcs = 'LARGE' THEN greatest(1.0, own) ELSE own END * 1e6 + 0.5) / 1e6 AS DOUBLE) AS radius_m, CASE WHEN big IS NOT NULL THEN 'known_structure' WHEN rcs IS NOT NULL THEN 'satcat_rcs' ELSE 'type_default' END AS radius_source FROM t""")
def object_records(spark, sf_dir):
    """Type, radius and provenance: listed type before the name, known structure before size class before type."""
    c = catalogue(spark, sf_dir).withColumn("kind", F.coalesce(O.known_type(F.col("listed_type")), O.type_of_screening(F.col("name"))))
    r, source = O.radius(F.col("name"), _rcs(), F.col("kind"))
    return c.select("id", F.col("kind").alias("object_type"), (F.floor(r * 1e6 + 0.5) / 1e6).alias("radius_m"), source.alias("radius_source"))


@query(f"""WITH {CATALOGUE_SQL}, n AS (SELECT id, scenario_mass, {RCS_SQL} AS rcs, {KNOWN_SQL} AS listed, CASE WHEN upper(name) LIKE '% DEB%' OR upper(name) LIKE '%DEB' OR upper(name) LIKE '%FRAG%' THEN 'DEB' WHEN upper(name) LIKE '%R/B%' OR upper(name) LIKE '%ROCKET BODY%' THEN 'R/B' ELSE 'UNK' END AS named FROM catalogue),
kinds(kind, kg, m) AS (VALUES ('PAY', 800e0, 2e0), ('R/B', 1500e0, 3e0), ('DEB', 20e0, 0.5e0), ('UNK', 500e0, 2e0)), classes(class, kg, m) AS (VALUES ('SMALL', 50e0, 0.5e0), ('MEDIUM', 500e0, 1.5e0), ('LARGE', 2000e0, 4e0))
SELECT id, coalesce(scenario_mass, c.kg, k.kg) AS mass_kg, CASE WHEN scenario_mass IS NOT NULL THEN 2e0 ELSE coalesce(c.m, k.m) END AS hbr_m, CASE WHEN scenario_mass IS NOT NULL THEN 'PAY' WHEN rcs IS NOT NULL THEN coalesce(listed, 'UNK') ELSE coalesce(listed, named) END AS object_type,
 CASE WHEN scenario_mass IS NOT NULL THEN 'scenario_config' WHEN rcs IS NOT NULL THEN 'satcat_rcs_' || lower(rcs) WHEN listed IS NOT NULL THEN 'satcat_object_type' WHEN named = 'UNK' THEN 'default' ELSE 'default_by_name_type' END AS mass_source FROM n LEFT JOIN classes c ON c.class = rcs LEFT JOIN kinds k ON k.kind = coalesce(listed, named)""")
def physical_properties(spark, sf_dir):
    """Mass and hard-body radius with their source."""
    mass, hbr, kind, source = O.physical(F.col("scenario_mass"), F.col("listed_type"), _rcs(), F.col("name"))
    return catalogue(spark, sf_dir).select("id", mass.alias("mass_kg"), hbr.alias("hbr_m"), kind.alias("object_type"), source.alias("mass_source"))


@query(f"""WITH {CATALOGUE_SQL}, m AS (SELECT id, {RCS_SQL} AS rcs, upper(coalesce(name, '')) AS n, launch_year FROM catalogue)
SELECT id, CASE WHEN n LIKE 'ISS%' THEN 420000e0 WHEN n LIKE 'STARLINK%' THEN CASE WHEN launch_year >= 2023 THEN 800e0 ELSE 306e0 END WHEN n LIKE 'ONEWEB%' THEN 147e0 WHEN n LIKE 'IRIDIUM%' THEN 860e0 WHEN rcs = 'SMALL' THEN 20e0 WHEN rcs = 'MEDIUM' THEN 300e0 WHEN rcs = 'LARGE' THEN 1500e0 ELSE 500e0 END AS mass_kg,
 CASE WHEN n LIKE 'ISS%' THEN 300e0 WHEN n LIKE 'STARLINK%' OR n LIKE 'ONEWEB%' THEN 1500e0 ELSE 220e0 END AS isp_s, CASE WHEN n LIKE 'ISS%' THEN 0.02e0 WHEN n LIKE 'STARLINK%' OR n LIKE 'ONEWEB%' THEN 0.05e0 ELSE 0.1e0 END AS propellant_share FROM m""")
def craft_models(spark, sf_dir):
    """Wet mass, specific impulse and propellant share by name, size class and default."""
    mass, isp, share = O.craft(F.col("name"), _rcs(), F.col("launch_year"))
    return catalogue(spark, sf_dir).select("id", mass.alias("mass_kg"), isp.alias("isp_s"), share.alias("propellant_share"))


def _operator_sql(code: str) -> str:
    rows = [f"WHEN regexp_matches(n, '{p}')" + (f" AND ({code} IS NULL OR {code} IN ({', '.join(repr(o) for o in owners)}))" if owners else "") + f" THEN '{label}'" for p, label, owners in O.OPERATORS]
    return "CASE " + " ".join(rows) + " END"


LABEL_SQL = "CASE WHEN code IS NULL OR code IN ('', 'TBD', 'UNK') THEN 'Unknown' ELSE coalesce(label, code) END"
AGENCY_SQL = f"""labels_of(code, label) AS (VALUES {', '.join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in (O.OWNER_NAMES | O.OWNER_LABELS).items())}), one AS (SELECT name, min(owner) AS owner FROM catalogue WHERE name <> '' AND owner IS NOT NULL GROUP BY name HAVING count(DISTINCT owner) = 1),
codes AS (SELECT c.id, upper(coalesce(c.name, '')) AS n, CASE WHEN c.id % 4 <> 0 THEN c.owner END AS by_id, one.owner AS by_name FROM catalogue c LEFT JOIN one ON one.name = c.name),
found AS (SELECT id, n, coalesce(by_id, by_name) AS code, CASE WHEN by_id IS NOT NULL THEN 'satcat_id' WHEN by_name IS NOT NULL THEN 'satcat_name' ELSE 'none' END AS how FROM codes),
guess AS (SELECT f.*, l.label, {_operator_sql('f.code')} AS refined, {_operator_sql('NULL')} AS guessed FROM found f LEFT JOIN labels_of l ON l.code = f.code),
agencies AS (SELECT id, CASE WHEN code IS NOT NULL AND refined IS NOT NULL THEN refined WHEN code NOT IN ('', 'TBD', 'UNK') THEN {LABEL_SQL} ELSE coalesce(guessed, 'Unknown') END AS agency, CASE WHEN code IS NOT NULL AND refined IS NOT NULL THEN how || '+operator_pattern' WHEN code NOT IN ('', 'TBD', 'UNK') THEN how WHEN guessed IS NOT NULL THEN 'name_pattern' ELSE how END AS provenance, code FROM guess)"""


#: Names of one owner that are broadcast.
NAMES_BROADCAST = 200_000


def attributed(spark, sf_dir):
    """id, agency, provenance, code of every object; a quarter of them have no owner by id."""
    c = catalogue(spark, sf_dir)
    one = c.where("name <> '' AND owner IS NOT NULL").groupBy("name").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low = high").select("name", F.col("low").alias("by_name"))
    one = checkpoint(one)
    one = F.broadcast(one) if one.count() <= NAMES_BROADCAST else one  # no popular name is one task; beyond, adaptive execution splits it
    label, how = O.agency(F.col("name"), F.when(F.col("id") % 4 != 0, F.col("owner")), F.col("by_name"))
    return c.join(one, "name", "left").select("id", label.alias("agency"), how.alias("provenance"), F.coalesce(F.when(F.col("id") % 4 != 0, F.col("owner")), F.col("by_name")).alias("code"))


@query(f"WITH {CATALOGUE_SQL}, {AGENCY_SQL} SELECT * FROM agencies")
def agency_resolution(spark, sf_dir):
    """Agency with provenance: by id, by a name that one owner has alone, by pattern."""
    return attributed(spark, sf_dir)


@query(f"WITH {CATALOGUE_SQL}, {AGENCY_SQL} SELECT agency, count(*) AS n, count(*) FILTER (provenance = 'none') AS unexplained, floor(count(*) * 1e6 / sum(count(*)) OVER () + 0.5) / 1e6 AS share, string_agg(DISTINCT provenance, ',' ORDER BY provenance) AS sources FROM agencies GROUP BY agency")
def agency_counts(spark, sf_dir):
    """Objects of each agency with the sources of the attribution."""
    a = attributed(spark, sf_dir)
    by = a.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("provenance") == "none").alias("unexplained"), F.concat_ws(",", F.sort_array(F.collect_set("provenance"))).alias("sources"))
    total = F.broadcast(by.agg(F.sum("n").alias("total")))  # one row
    return by.crossJoin(total).select("agency", "n", "unexplained", (F.floor(F.col("n") * 1e6 / F.col("total") + 0.5) / 1e6).alias("share"), "sources")


@query("""WITH old AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'ROSCOSMOS' WHEN 1 THEN 'cnsa' WHEN 2 THEN 'ISRO' WHEN 3 THEN 'ISS/NASA' WHEN 4 THEN 'UNKNOWN' ELSE 'SpaceX' END AS label FROM customer)
SELECT id, label, unnest(CASE upper(label) WHEN 'ROSCOSMOS' THEN ['Russia/CIS'] WHEN 'CNSA' THEN ['China'] WHEN 'ISRO' THEN ['India'] WHEN 'ISS/NASA' THEN ['ISS', 'NASA'] WHEN 'UNKNOWN' THEN ['Unknown'] ELSE [label] END) AS agency FROM old""")
def agency_aliases(spark, sf_dir):
    """Names of older clients, one row per label that they cover."""
    k = F.col("c_custkey") % 7
    old = F.when(k == 0, "ROSCOSMOS").when(k == 1, "cnsa").when(k == 2, "ISRO").when(k == 3, "ISS/NASA").when(k == 4, "UNKNOWN").otherwise("SpaceX")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), old.alias("label")).select("id", "label", F.explode(O.aliases(F.col("label"))).alias("agency"))
