"""Shared common table expressions: the derived tables in plain SQL."""

from __future__ import annotations

from ..sources.dimensions import QUESTIONS, REGION_COORDS
from ..sources.mentions import DESCRIPTION_ENDINGS, NAME_SUFFIXES, REGION_TEXTS, REPLY_LABELS, SQL_TEXTS

BLANKS = "' ' || chr(9) || chr(13) || chr(10)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({array(values)})[CAST({index} AS INT) + 1]"


def known(column: str) -> str:
    """Trimmed value or NULL for a null word."""
    return f"(CASE WHEN lower(trim({column}, {BLANKS})) NOT IN ('null','none','nan','') THEN trim({column}, {BLANKS}) END)"


def slot(key: str, slots) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {slots})"


def json_list(expr: str) -> str:
    return f"(CASE WHEN len({expr}) > 0 THEN CAST(to_json(list_sort({expr})) AS VARCHAR) END)"


SINGLES = [
    "name", "organization_type", "email", "officialWebsite", "officialPhone", "yearEstablished",
    "acceptsVolunteers", "facebookLink", "address_city", "address_stateOrRegion", "address_country",
    "address_countryCode", "facilityTypeId", "operatorTypeId", "description", "numberDoctors", "capacity",
    "missionStatement", "mongo DB",
]
LISTS = ["specialties", "procedure", "equipment", "capability", "phone_numbers", "websites", "affiliationTypeIds"]
FLAGS = [
    "flag_procedures_no_doctors", "flag_capacity_no_equipment", "flag_clinic_claims_surgery",
    "flag_too_many_specialties", "flag_sparse_record", "flag_high_capacity_no_surgery",
    "flag_many_specialties_small_size", "flag_no_doctors_listed", "flag_emergency_not_offered",
]
ANY_FLAG = "(" + " OR ".join(FLAGS) + ")"


def _singles(source: str) -> str:
    cells = ", ".join(
        f"arg_min({known(chr(34) + c + chr(34))}, source_url) FILTER (WHERE {known(chr(34) + c + chr(34))} IS NOT NULL)"
        f" AS \"{c.replace(' ', '_')}\"" for c in SINGLES
    )
    return f"SELECT pk_unique_id, {cells}, count(*) AS source_count FROM {source} GROUP BY pk_unique_id"


def _int(column: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST({column} AS DOUBLE)) AS INTEGER) AS {column}"


SPECIALTY = """CASE t WHEN 'STANDARD' THEN 'internalMedicine' WHEN 'SMALL' THEN 'pediatrics'
    WHEN 'MEDIUM' THEN 'gynecologyAndObstetrics' WHEN 'ECONOMY' THEN 'cardiology'
    WHEN 'PROMO' THEN CASE WHEN n_nationkey % 5 = 0 THEN 'dermatology' ELSE 'generalSurgery' END
    ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'familyMedicine' ELSE 'emergencyMedicine' END END"""

MENTIONS = f"""
order_lines AS (
  SELECT l_orderkey,
    list(DISTINCT p_type) FILTER (WHERE l_returnflag = 'N') AS types,
    list(DISTINCT {{'n': p_name, 'promo': p_type = 'PROMO'}}) FILTER (WHERE l_returnflag = 'A') AS parts,
    list(DISTINCT p_brand) FILTER (WHERE l_returnflag = 'R') AS brands
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
mention_base AS (
  SELECT *, o_custkey AS k, o_orderkey AS o, c_name || ' ' || {pick(NAME_SUFFIXES, f'o_custkey % {len(NAME_SUFFIXES)}')} AS full_name,
    'City ' || (o_custkey % 40) AS city, 'src' || (o_orderkey % 3) || '.example.com' AS host,
    list_distinct(list_transform(types, lambda t: {SPECIALTY})) AS spec,
    list_distinct(list_transform(parts, lambda p: 'Performs ' || p.n || CASE WHEN p.promo AND n_nationkey % 5 <> 0 THEN ' surgery' ELSE '' END)) AS procs
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN order_lines ON o_orderkey = l_orderkey
),
mentions AS (
  SELECT k AS pk_unique_id, 'https://' || host || '/' || o AS source_url, o_orderdate AS scraped_at, full_name AS name,
    CASE WHEN k % 17 = 0 THEN 'ngo' ELSE 'facility' END AS organization_type,
    CASE WHEN o % 3 <> 0 THEN 'info' || k || '@' || host END AS email,
    CASE WHEN k % 3 <> 0 THEN 'https://www.site' || (k % 50) || '.example.org/home?id=' || o END AS "officialWebsite",
    CASE WHEN k % 10 = 0 THEN '0' || (k % 1000) ELSE '+233' || lpad(CAST(k AS VARCHAR), 9, '3') END AS "officialPhone",
    CASE WHEN k % 7 = 0 THEN 'null' ELSE CAST(1950 + k % 70 AS VARCHAR) END AS "yearEstablished",
    CASE k % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS "acceptsVolunteers",
    CASE WHEN k % 5 = 0 THEN 'https://facebook.com/f' || k END AS "facebookLink",
    CASE WHEN n_nationkey >= 18 AND k % 10 <> 0 THEN {pick(REGION_TEXTS, 'n_nationkey % 18')}
      WHEN n_nationkey = 23 THEN NULL WHEN n_nationkey = 24 THEN 'null' ELSE {pick(REGION_TEXTS, 'n_nationkey')} END AS "address_stateOrRegion",
    city AS address_city, 'Ghana' AS address_country,
    CASE WHEN k % 11 <> 0 THEN 'GH' WHEN k % 2 = 0 THEN 'Ghana' END AS "address_countryCode",
    CASE c_mktsegment WHEN 'BUILDING' THEN 'hospital' WHEN 'HOUSEHOLD' THEN 'clinic' WHEN 'FURNITURE' THEN 'dentist'
      WHEN 'MACHINERY' THEN 'pharmacy' ELSE 'null' END AS "facilityTypeId",
    CASE k % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'null' END AS "operatorTypeId",
    CASE WHEN k % 6 <> 0 THEN full_name || ' in ' || city || {pick(DESCRIPTION_ENDINGS, f'o % {len(DESCRIPTION_ENDINGS)}')} END AS description,
    CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN NULL ELSE (k % 9) || CASE WHEN k % 13 = 0 THEN '.0' ELSE '' END END AS "numberDoctors",
    CASE WHEN k % 5 = 0 THEN 'null' ELSE CAST(k % 120 AS VARCHAR) END AS capacity,
    CASE WHEN k % 17 = 0 THEN 'Care for all in ' || city END AS "missionStatement",
    md5(CAST(k AS VARCHAR)) AS "mongo DB",
    {json_list('spec')} AS specialties,
    CASE WHEN k % 24 <> 0 THEN {json_list('procs')} END AS procedure,
    CASE WHEN k % 24 <> 0 THEN {json_list('brands')} END AS equipment,
    CASE WHEN k % 12 = 0 THEN NULL ELSE CASE o_orderpriority
      WHEN '1-URGENT' THEN CASE WHEN n_nationkey % 3 = 0 THEN '["Outpatient clinic"]' ELSE '["24-hour emergency care"]' END
      WHEN '2-HIGH' THEN '["Inpatient ward"," Pharmacy ","brand#7"]' WHEN '3-MEDIUM' THEN '[""]'
      WHEN '4-NOT SPECIFIED' THEN '[]' ELSE 'Outpatient only' END END AS capability,
    '["+233' || lpad(CAST(k AS VARCHAR), 9, '3') || '","0' || (o % 5) || '"]' AS phone_numbers,
    '["http://www.site' || (k % 50) || '.example.org/","m' || (o % 4) || '.example.net/x"]' AS websites,
    CASE WHEN k % 19 = 0 THEN '["community","unknown-level"]' WHEN k % 5 = 0 THEN '["academic"]' END AS "affiliationTypeIds"
  FROM mention_base
)"""

_raw_lists = " UNION ALL ".join(
    f"SELECT pk_unique_id, source_url, '{f}' AS field, \"{f}\" AS txt FROM mentions" for f in LISTS
)

CLAIMS = f"""
raw_lists AS ({_raw_lists}),
parsed_lists AS (
  SELECT pk_unique_id, source_url, field,
    CASE WHEN {known('txt')} IS NULL THEN CAST([] AS VARCHAR[])
         WHEN txt LIKE '[%' THEN CAST(CAST(txt AS JSON) AS VARCHAR[]) ELSE [trim(txt)] END AS items
  FROM raw_lists
),
claim_sources AS (
  SELECT DISTINCT pk_unique_id, source_url, field, trim(trim(trim(x, {BLANKS}), '"'), {BLANKS}) AS item
  FROM (SELECT pk_unique_id, source_url, field, unnest(items) AS x FROM parsed_lists)
  WHERE trim(trim(trim(x, {BLANKS}), '"'), {BLANKS}) <> ''
),
all_claims AS (SELECT DISTINCT pk_unique_id, field, item FROM claim_sources),
claims AS (SELECT * FROM all_claims WHERE field IN ('specialties','procedure','equipment','capability')),
lists AS (
  SELECT pk_unique_id, field, list(item ORDER BY item) AS items FROM all_claims GROUP BY ALL
)"""

FACILITIES = f"""
singles AS ({_singles('mentions')}),
signals AS (
  SELECT pk_unique_id,
    CAST(count(*) FILTER (WHERE field = 'procedure') AS INT) AS num_procedures,
    CAST(count(*) FILTER (WHERE field = 'equipment') AS INT) AS num_equipment,
    CAST(count(*) FILTER (WHERE field = 'capability') AS INT) AS num_capabilities,
    CAST(count(*) FILTER (WHERE field = 'specialties') AS INT) AS num_specialties,
    bool_or(field = 'specialties' AND lower(item) LIKE '%surgery%') AS claims_surgery,
    bool_or(field = 'specialties' AND lower(item) LIKE '%emergency%') AS claims_emergency,
    bool_or(field = 'specialties' AND lower(item) LIKE '%obstetrics%') AS claims_obstetrics,
    bool_or(field = 'specialties' AND lower(item) LIKE '%pediatrics%') AS claims_pediatrics,
    bool_or(field = 'procedure' AND lower(item) LIKE '%surg%') AS does_surgery,
    bool_or(field = 'capability' AND (lower(item) LIKE '%emergency%' OR item LIKE '%24%')) AS offers_emergency
  FROM claims GROUP BY pk_unique_id
),
facility_base AS (
  SELECT singles.* REPLACE ({_int('"yearEstablished"')}, {_int('"numberDoctors"')}, {_int('capacity')}),
    coalesce(num_procedures, 0) AS num_procedures, coalesce(num_equipment, 0) AS num_equipment,
    coalesce(num_capabilities, 0) AS num_capabilities, coalesce(num_specialties, 0) AS num_specialties,
    coalesce(claims_surgery, false) AS claims_surgery, coalesce(claims_emergency, false) AS claims_emergency,
    coalesce(claims_obstetrics, false) AS claims_obstetrics, coalesce(claims_pediatrics, false) AS claims_pediatrics,
    coalesce(does_surgery, false) AS does_surgery, coalesce(offers_emergency, false) AS offers_emergency
  FROM singles LEFT JOIN signals USING (pk_unique_id)
),
facilities AS (
  SELECT *,
    num_procedures > 5 AND coalesce("numberDoctors", 0) < 2 AS flag_procedures_no_doctors,
    coalesce(capacity, 0) > 50 AND num_equipment = 0 AS flag_capacity_no_equipment,
    coalesce("facilityTypeId", '') = 'clinic' AND claims_surgery AS flag_clinic_claims_surgery,
    num_specialties > 5 AND coalesce("numberDoctors", 0) < 5 AS flag_too_many_specialties,
    num_procedures = 0 AND num_equipment = 0 AND num_capabilities = 0 AND description IS NULL AS flag_sparse_record,
    coalesce(capacity, 0) > 50 AND NOT does_surgery AS flag_high_capacity_no_surgery,
    num_specialties > 5 AND coalesce(capacity, 0) < 20 AND coalesce(capacity, 0) > 0 AS flag_many_specialties_small_size,
    coalesce("facilityTypeId", '') = 'hospital' AND "numberDoctors" IS NULL AS flag_no_doctors_listed,
    claims_emergency AND NOT offers_emergency AS flag_emergency_not_offered
  FROM facility_base
)"""

REGIONS = """
regions AS (
  SELECT *, 100 - 2 * facility_count - total_doctors - 10 * has_surgery - 10 * has_emergency - 5 * has_obstetrics AS desert_score
  FROM (
    SELECT "address_stateOrRegion", count(*) AS facility_count,
      CAST(sum(coalesce("numberDoctors", 0)) AS BIGINT) AS total_doctors, CAST(sum(coalesce(capacity, 0)) AS BIGINT) AS total_beds,
      count(*) FILTER (WHERE "facilityTypeId" = 'hospital') AS hospital_count,
      count(*) FILTER (WHERE claims_surgery) AS has_surgery, count(*) FILTER (WHERE claims_emergency) AS has_emergency,
      count(*) FILTER (WHERE claims_obstetrics) AS has_obstetrics, count(*) FILTER (WHERE claims_pediatrics) AS has_pediatrics,
      count(*) FILTER (WHERE flag_sparse_record) AS sparse_records
    FROM facilities GROUP BY "address_stateOrRegion")
)"""


def weighted(where: str = "") -> str:
    return f"""
  SELECT *, round_even(round(40 * (1 - facility_count / greatest(max(facility_count) OVER (), 1))
      + 25 * (1 - total_doctors / (CASE max(total_doctors) OVER () WHEN 0 THEN 1 ELSE max(total_doctors) OVER () END))
      + 20 * (1 - total_beds / (CASE max(total_beds) OVER () WHEN 0 THEN 1 ELSE max(total_beds) OVER () END))
      + CASE WHEN has_surgery > 0 THEN 0 ELSE 10 END + CASE WHEN has_emergency > 0 THEN 0 ELSE 5 END, 9), 1) AS desert_score
  FROM (
    SELECT "address_stateOrRegion", count(*) AS facility_count,
      CAST(sum(coalesce("numberDoctors", 0)) AS BIGINT) AS total_doctors, CAST(sum(coalesce(capacity, 0)) AS BIGINT) AS total_beds,
      count(*) FILTER (WHERE does_surgery) AS has_surgery, count(*) FILTER (WHERE offers_emergency) AS has_emergency,
      count(*) FILTER (WHERE "facilityTypeId" = 'hospital') AS num_hospitals, round(avg(num_specialties), 6) AS avg_specialties
    FROM facilities {where} GROUP BY "address_stateOrRegion")"""


WEIGHTED = "\nweighted AS (" + weighted('WHERE "address_stateOrRegion" IS NOT NULL') + ")"

LOG = f"""
customer_count AS (SELECT count(*) AS n FROM customer),
question_log AS (
  SELECT event_id, ts, user_id,
    {pick([q[0] for q in QUESTIONS], 'event_id % 15')} AS question_id,
    {pick([q[1] for q in QUESTIONS], 'event_id % 15')} || ' Region: ' || {pick(REGION_TEXTS, 'event_id % 23')} AS question,
    {pick([q[2] for q in QUESTIONS], 'event_id % 15')} AS question_category,
    {pick([q[3] for q in QUESTIONS], 'event_id % 15')} AS expected_route,
    {pick(REPLY_LABELS, f'event_id % {len(REPLY_LABELS)}')} AS reply,
    {pick(SQL_TEXTS, f'event_id % {len(SQL_TEXTS)}')} AS sql_text,
    event_type || ': ' || props AS answer,
    CAST(floor(value * 10) AS BIGINT) AS total_ms,
    list_transform(generate_series(1, event_id % 13), lambda i: CAST((event_id * 7 + i * 31) % n AS VARCHAR)) AS source_ids
  FROM events, customer_count
),
log_steps AS (
  SELECT event_id, 'classify' AS step, expected_route AS output, CAST(floor(total_ms / 5) AS BIGINT) AS ms, len(source_ids) AS sources FROM question_log
  UNION ALL
  SELECT event_id, CASE expected_route WHEN 'STRUCTURED' THEN 'sql' WHEN 'SEMANTIC' THEN 'rag' WHEN 'REASONING' THEN 'reasoning' ELSE 'desert' END,
    (event_id % 13) || ' sources', total_ms - CAST(floor(total_ms / 5) AS BIGINT), len(source_ids) FROM question_log
)"""

PEOPLE = f"""
people AS (SELECT user_id, count(*) AS requests, {pick(REGION_TEXTS, f'user_id % {len(REGION_TEXTS)}')} AS "address_stateOrRegion"
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"""

PARTS = """
parts AS (
  SELECT pk_unique_id, unnest([name, description, address_city, "address_stateOrRegion"]) AS txt FROM singles
  UNION ALL SELECT pk_unique_id, item FROM claims
)"""

PLACES = "\nplaces(place, plat, plon) AS (VALUES " + ", ".join(
    f"({text(n)}, {lat}::DOUBLE, {lon}::DOUBLE)" for n, lat, lon in REGION_COORDS) + ")"

ASKED = "\nasked(question_id, question) AS (VALUES " + ", ".join(
    f"({text(q[0])}, {text(q[1])})" for q in QUESTIONS) + ")"

PRELUDE = "WITH " + ",".join([MENTIONS, CLAIMS, FACILITIES, REGIONS, WEIGHTED, LOG, PEOPLE, PARTS, PLACES, ASKED])
