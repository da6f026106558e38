"""One SELECT per registered query, over the shared expressions."""

from __future__ import annotations

import re

from ..sources.dimensions import (
    AFFILIATION_TYPES, BLOCKED_WORDS, CONTEXT_RULES, CONTEXT_TRIGGERS, CRITICAL_SPECIALTIES, INTENT_KEYWORDS,
    NAME_RULES, NGO_WORDS, PHRASE_RULES, ROUTE_LABELS, SECRET_MASK, SPECIALTY_KEYWORDS, TERM_MAP,
)
from ..sources.mentions import OTHER_REGIONS
from .base import ANY_FLAG, CLAIMS, FLAGS, LISTS, PRELUDE, SINGLES, _singles, array, known, slot, text, weighted

R = '"address_stateOrRegion"'
ORACLE: dict[str, str] = {}


def sql(name: str, body: str, extra: str = "") -> None:
    ORACLE[name] = f"{PRELUDE}{',' + extra if extra else ''}\n{body}"


def items(field: str) -> str:
    return f"array_to_string(coalesce((SELECT any_value(items) FROM lists l WHERE l.pk_unique_id = f.pk_unique_id AND l.field = '{field}'), []), '; ')"


# ---------------------------------------------------------------- merge
SAFE = ", ".join(f'"{c.replace(" ", "_")}"' for c in SINGLES)
sql("facility_mentions", "SELECT * FROM mentions")
sql("merge_by_key",
    f"SELECT pk_unique_id, {SAFE}, source_count, CAST(0 AS BIGINT) AS list_page, CAST(1 AS BIGINT) AS list_pages, "
    + ", ".join(f'{items(f)} AS "{f}"' for f in LISTS) + " FROM singles f")
sql("merged_list_pages", """SELECT pk_unique_id, field, CAST(0 AS BIGINT) AS page, CAST(1 AS BIGINT) AS n_pages,
  array_to_string(items, '; ') AS items FROM lists""")
sql("source_urls_by_facility", """SELECT pk_unique_id, CAST(0 AS BIGINT) AS page, CAST(1 AS BIGINT) AS n_pages,
  string_agg(DISTINCT source_url, '; ' ORDER BY source_url) AS source_urls FROM mentions GROUP BY pk_unique_id""")
RAW_TEXTS = " UNION ALL ".join(
    f"SELECT DISTINCT pk_unique_id, '{f}' AS field, {f} AS txt FROM mentions WHERE {f} IS NOT NULL"
    for f in ["specialties", "procedure", "equipment", "capability", "description"])
sql("merged_raw_text", f"""SELECT pk_unique_id, field, CAST(0 AS BIGINT) AS page, CAST(1 AS BIGINT) AS n_pages,
  string_agg(txt, ' | ' ORDER BY txt) AS merged_text FROM ({RAW_TEXTS}) GROUP BY pk_unique_id, field""")
sql("duplicate_statistics", """SELECT count(*) AS total_rows, count(DISTINCT pk_unique_id) AS unique_keys,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM mentions GROUP BY pk_unique_id)) AS most_mentions,
  count(*) - count(DISTINCT pk_unique_id) AS duplicate_rows FROM mentions""")
sql("duplicate_keys", """SELECT pk_unique_id, count(*) AS row_count FROM mentions GROUP BY pk_unique_id HAVING count(*) > 1""")
sql("corroborated_claims", """SELECT field, item, count(*) AS facilities, count(*) FILTER (WHERE hosts >= 2) AS corroborated
  FROM (SELECT pk_unique_id, field, item, count(DISTINCT split_part(source_url, '/', 3)) AS hosts
        FROM claim_sources WHERE field IN ('procedure', 'equipment') GROUP BY ALL) GROUP BY field, item""")
sql("list_field_coverage", """SELECT total_rows, field, rows_with_data, CAST(floor(100 * rows_with_data / total_rows) AS BIGINT) AS percent
  FROM (SELECT field, count(DISTINCT source_url) AS rows_with_data FROM claim_sources
        WHERE field IN ('procedure', 'equipment', 'capability') GROUP BY field),
       (SELECT count(*) AS total_rows FROM mentions)""")
ORACLE["table_columns"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, CAST(row_number() OVER () - 1 AS INT) AS position, column_name AS col_name,
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE column_type END AS data_type FROM (DESCRIBE SELECT * FROM {t})"""
    for t in ("customer", "events", "lineitem", "nation", "orders", "part"))
sql("domain_value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, \"{c}\" AS value, count(*) AS row_count FROM singles WHERE \"{c}\" IS NOT NULL GROUP BY \"{c}\""
    for c in ["facilityTypeId", "operatorTypeId", "address_stateOrRegion"]))
sql("organization_type_counts", "SELECT organization_type, count(*) AS row_count FROM mentions GROUP BY organization_type")
sql("raw_facility_type_counts", 'SELECT "facilityTypeId", count(*) AS row_count FROM mentions GROUP BY 1')
PROFILED = ["name", "email", "officialPhone", "address_countryCode", "facilityTypeId", "numberDoctors", "capacity",
            "description", "acceptsVolunteers", "address_stateOrRegion"]
sql("column_profile", " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({known(chr(34) + c + chr(34))}) AS missing, "
     f"count(DISTINCT {known(chr(34) + c + chr(34))}) AS distinct_values FROM mentions" for c in PROFILED]
    + [f"SELECT '{c}', count(*), count(*) FILTER (WHERE n IS NULL OR n = ''), count(DISTINCT n) FILTER (WHERE n <> '') "
       f"FROM mentions LEFT JOIN (SELECT source_url, string_agg(item, '|') AS n FROM (SELECT source_url, unnest(items) AS item "
       f"FROM parsed_lists WHERE field = '{c}') WHERE trim(item) <> '' GROUP BY source_url) USING (source_url)"
       for c in ["specialties", "procedure", "equipment", "capability"]]))

# ---------------------------------------------------------------- facilities and flags
sql("facilities_enriched", "SELECT * FROM facilities")


def label(flag: str) -> str:
    return " ".join(w.capitalize() for w in flag.removeprefix("flag_").split("_"))


sql("flag_summary", " UNION ALL ".join(
    f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS facilities, {text(label(f))} AS label FROM facilities" for f in FLAGS))
SHOWN = ["name", "address_stateOrRegion", "facilityTypeId", "numberDoctors", "capacity",
         "num_procedures", "num_equipment", "num_specialties"]
sql("flagged_facilities", "SELECT pk_unique_id, "
    + ", ".join(f"coalesce(CAST(\"{c}\" AS VARCHAR), 'N/A') AS \"{c}\"" for c in SHOWN)
    + ", concat_ws(', ', " + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in FLAGS) + f") AS flags FROM facilities WHERE {ANY_FLAG}")
sql("flagged_hospitals_in_region", f"""SELECT pk_unique_id, name, "facilityTypeId", capacity, num_procedures FROM facilities
  WHERE flag_no_doctors_listed AND {R} = 'Ashanti'""")
BASE = f'pk_unique_id, name, {R}, "facilityTypeId"'
sql("anomaly_unrealistic_procedures", f"""SELECT {BASE}, "numberDoctors", num_procedures, num_equipment, num_specialties
  FROM facilities WHERE num_procedures > 5 AND ("numberDoctors" IS NULL OR "numberDoctors" < 2)""")
sql("anomaly_mismatched_capabilities", f"""SELECT {BASE}, num_equipment, "numberDoctors", CAST(0 AS BIGINT) AS list_page, {items('specialties')} AS specialties
  FROM facilities f WHERE lower({items('specialties')}) LIKE '%surgery%' AND num_equipment = 0""")
sql("anomaly_clinic_claims_surgery", f"""SELECT pk_unique_id, name, address_city, {R}, num_procedures, "numberDoctors",
  CAST(0 AS BIGINT) AS list_page, {items('specialties')} AS specialties FROM facilities f WHERE flag_clinic_claims_surgery""")
sql("anomaly_high_capacity_no_equipment", f"""SELECT {BASE}, capacity, "numberDoctors", num_equipment, num_procedures
  FROM facilities WHERE capacity > 50 AND num_equipment = 0""")
sql("anomaly_too_many_specialties", f"""SELECT {BASE}, num_specialties, "numberDoctors", capacity, CAST(0 AS BIGINT) AS list_page, {items('specialties')} AS specialties
  FROM facilities f WHERE flag_too_many_specialties""")
sql("anomaly_correlated_features", f"""SELECT {BASE}, "numberDoctors", capacity, num_procedures, num_equipment, num_specialties,
  CASE WHEN capacity > 100 AND num_equipment < 3 THEN 'Large capacity, minimal equipment'
       WHEN num_specialties > 5 AND "numberDoctors" < 3 THEN 'Many specialties, few doctors'
       WHEN num_procedures > 10 AND num_equipment < 2 THEN 'Many procedures, almost no equipment'
       ELSE 'Other mismatch' END AS mismatch_type
  FROM facilities WHERE (capacity > 100 AND num_equipment < 3)
    OR (num_specialties > 5 AND ("numberDoctors" IS NULL OR "numberDoctors" < 3)) OR (num_procedures > 10 AND num_equipment < 2)""")
sql("anomaly_single_facility_dependency", f"""SELECT {R}, "facilityTypeId", count(*) AS facility_count,
  CAST(sum(coalesce("numberDoctors", 0)) AS BIGINT) AS total_doctors FROM facilities WHERE claims_surgery GROUP BY ALL HAVING count(*) <= 2""")
sql("anomaly_breadth_outliers", """SELECT pk_unique_id, name, num_procedures, num_equipment, "numberDoctors", round(ratio, 6) AS ratio,
  round(z, 6) AS z_score FROM (
    SELECT *, (ratio - avg(ratio) OVER ()) / stddev_pop(ratio) OVER () AS z FROM (
      SELECT *, num_procedures / (1 + num_equipment + coalesce("numberDoctors", 0)) AS ratio FROM facilities)) WHERE z > 1.5""")
CHECKS = """
checks AS (
  SELECT pk_unique_id, 'surgery' AS rule, bool_or(field = 'procedure' AND item ILIKE '%surgery%') AS claimed,
    bool_or(field = 'equipment' AND item LIKE 'Brand#1%') AS owns FROM claims GROUP BY 1
  UNION ALL SELECT pk_unique_id, 'ring work', bool_or(field = 'procedure' AND regexp_matches(item, '\\bring\\b')),
    bool_or(field = 'equipment' AND item LIKE 'Brand#2%') FROM claims GROUP BY 1
  UNION ALL SELECT pk_unique_id, 'gear work', bool_or(field = 'procedure' AND regexp_matches(item, '\\bgear\\b')),
    bool_or(field = 'equipment' AND item IN ('Brand#3', 'Brand#4', 'Brand#5')) FROM claims GROUP BY 1
)"""
sql("missing_equipment", "SELECT pk_unique_id, rule FROM checks WHERE claimed AND NOT owns", CHECKS)
sql("equipment_compliance", """SELECT rule, count(*) AS claiming, count(*) FILTER (WHERE owns) AS equipped,
  round(count(*) FILTER (WHERE owns) / count(*), 6) AS share FROM checks WHERE claimed GROUP BY rule""", CHECKS)
sql("type_claim_mismatch", """SELECT pk_unique_id, name, "facilityTypeId", count(*) AS odd_claims FROM facilities JOIN claims USING (pk_unique_id)
  WHERE ("facilityTypeId" = 'pharmacy' AND field = 'procedure' AND item ILIKE '%surg%')
     OR ("facilityTypeId" = 'dentist' AND field = 'specialties' AND item ILIKE '%cardi%')
     OR ("facilityTypeId" = 'clinic' AND field = 'capability' AND (item ILIKE '%emergency%' OR item ILIKE '%trauma%')) GROUP BY ALL""")
POINTS = ("CAST((source_count >= 2) AS INT) + CAST((source_count >= 5) AS INT) + CAST((num_equipment >= 1) AS INT) + "
          "CAST((num_equipment >= 3) AS INT) + CAST((\"numberDoctors\" IS NOT NULL) AS INT) - ("
          + " + ".join(f"CAST({f} AS INT)" for f in FLAGS) + ")")
sql("credibility", f"""SELECT pk_unique_id, CAST(p AS INT) AS points, CASE WHEN p >= 4 THEN 'HIGH' WHEN p >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS credibility
  FROM (SELECT pk_unique_id, {POINTS} AS p FROM facilities)""")

# ---------------------------------------------------------------- profiles
sql("type_profile", """SELECT "facilityTypeId", count(*) AS facility_count, round(avg("numberDoctors"), 6) AS avg_doctors,
  round(avg(capacity), 6) AS avg_beds FROM facilities GROUP BY 1""")
sql("facility_type_counts", 'SELECT "facilityTypeId", count(*) AS row_count FROM singles GROUP BY 1')
sql("operator_counts", """SELECT coalesce("operatorTypeId", 'Unknown') AS "operatorTypeId", count(*) AS row_count FROM singles GROUP BY 1""")
sql("facility_type_shares", """SELECT "facilityTypeId", count(*) AS row_count, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS percent
  FROM singles WHERE "facilityTypeId" IS NOT NULL GROUP BY 1""")
sql("key_figures", f"""SELECT count(*) AS facilities, count(*) FILTER (WHERE "facilityTypeId" = 'hospital') AS hospitals,
  count(*) FILTER (WHERE "facilityTypeId" = 'clinic') AS clinics, count(DISTINCT {R}) AS regions,
  CAST(sum("numberDoctors") AS BIGINT) AS doctors, CAST(sum(capacity) AS BIGINT) AS beds,
  count(*) FILTER (WHERE {ANY_FLAG}) AS flagged FROM facilities""")
FEATURES = ["numberDoctors", "capacity", "num_procedures", "num_equipment", "num_specialties"]
sql("feature_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(\"{a}\", \"{b}\"), 6) AS corr FROM facilities"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]))
sql("contact_quality_correlation", """SELECT count(*) AS facilities, round(avg(s), 6) AS avg_contact_score, round(corr(s, c), 6) AS corr
  FROM (SELECT CAST((email IS NOT NULL) AS INT) + CAST(("officialWebsite" IS NOT NULL) AS INT) + CAST(("officialPhone" IS NOT NULL) AS INT)
    + CAST(("facebookLink" IS NOT NULL) AS INT) AS s, num_procedures + num_equipment + num_capabilities AS c FROM facilities)""")
sql("default_specialty_share", """SELECT count(*) AS with_specialty, count(*) FILTER (WHERE items = ['internalMedicine']) AS only_default,
  round(count(*) FILTER (WHERE items = ['internalMedicine']) / count(*), 6) AS share FROM lists WHERE field = 'specialties'""")
sql("service_bundles", """SELECT a.item AS item_a, b.item AS item_b, count(*) AS facilities FROM services a JOIN services b
  ON a.pk_unique_id = b.pk_unique_id AND a.item < b.item GROUP BY ALL
  HAVING count(*) >= (SELECT ceil(round(0.05 * count(DISTINCT pk_unique_id), 9)) FROM services)""",
    "\nservices AS (SELECT DISTINCT pk_unique_id, item FROM claims WHERE field IN ('procedure', 'equipment'))")
sql("service_bundles_by_region", f"""SELECT a.{R}, a.item AS item_a, b.item AS item_b, count(*) AS facilities
  FROM services a JOIN services b ON a.pk_unique_id = b.pk_unique_id AND a.item < b.item
  JOIN (SELECT {R}, ceil(round(0.3 * count(DISTINCT pk_unique_id), 9)) AS least FROM services GROUP BY 1) r
    ON a.{R} IS NOT DISTINCT FROM r.{R}
  GROUP BY ALL HAVING count(*) >= any_value(least)""", f"""
services AS (SELECT DISTINCT pk_unique_id, item, {R} FROM claims JOIN singles USING (pk_unique_id)
             WHERE field IN ('procedure', 'equipment'))""")

sql("closed_service_bundles", """SELECT array_to_string(items, '; ') AS items, len(items) AS n_items, n AS facilities FROM shared s
  WHERE len(items) >= 2 AND NOT EXISTS (SELECT 1 FROM shared t WHERE t.n = s.n AND len(t.items) > len(s.items) AND list_has_all(t.items, s.items))""",
    """
services AS MATERIALIZED (SELECT DISTINCT pk_unique_id, item FROM claims WHERE field IN ('procedure', 'equipment')),
least AS MATERIALIZED (SELECT ceil(round(0.15 * count(DISTINCT pk_unique_id), 9)) AS least FROM services),
often AS MATERIALIZED (SELECT item FROM services GROUP BY item HAVING count(*) >= (SELECT least FROM least)),
baskets AS MATERIALIZED (SELECT pk_unique_id, list(item) AS basket FROM services WHERE item IN (SELECT item FROM often) GROUP BY 1),
shared AS MATERIALIZED (WITH RECURSIVE grown(items, n) AS (
    SELECT [item], count(*) FROM services WHERE item IN (SELECT item FROM often) GROUP BY item
    UNION ALL
    SELECT list_append(items, o.item), count(*) FROM grown, often o, baskets b
    WHERE o.item > items[-1] AND list_contains(b.basket, o.item) AND list_has_all(b.basket, items)
    GROUP BY items, o.item HAVING count(*) >= (SELECT least FROM least))
  SELECT * FROM grown)""")

# ---------------------------------------------------------------- regions
sql("regional_stats", f"""SELECT {R}, count(*) AS facility_count, CAST(sum(coalesce("numberDoctors", 0)) AS BIGINT) AS total_doctors,
  CAST(sum(coalesce(capacity, 0)) AS BIGINT) AS total_beds, count(DISTINCT "facilityTypeId") AS facility_types FROM facilities GROUP BY 1""")
sql("specialty_coverage", f"""SELECT {R}, CAST(sum(num_specialties) AS BIGINT) AS total_specialty_slots,
  round(avg(num_specialties), 6) AS avg_specialties_per_facility FROM facilities GROUP BY 1""")
sql("regional_analysis", "SELECT * FROM regions")
sql("desert_score_weighted", "SELECT * FROM weighted")
sql("desert_score_weighted_all_regions", weighted())
sql("region_map_rows", f"""SELECT {R}, facility_count, desert_score,
  CASE WHEN desert_score > 80 THEN 'Critical' WHEN desert_score > 50 THEN 'High' WHEN desert_score > 20 THEN 'Moderate' ELSE 'Adequate' END AS band,
  greatest(15, 50 - 2 * facility_count) AS marker_radius, desert_score > 50 AND has_emergency = 0 AS lives_at_risk,
  has_surgery > 10 AS expertise_hub FROM weighted""")
sql("region_priority_ranking", f"""SELECT {R}, desert_score, CAST(dense_rank() OVER (ORDER BY desert_score DESC) AS INT) AS priority FROM regions""")
sql("most_underserved_regions", f"""SELECT {R}, facility_count, total_doctors, desert_score FROM regions
  ORDER BY desert_score DESC, {R} NULLS FIRST LIMIT 5""")
sql("critical_regions", f"""SELECT {R}, facility_count, desert_score FROM weighted WHERE desert_score > 50 ORDER BY desert_score DESC, {R} LIMIT 5""")
sql("region_with_most_hospitals", f"""SELECT {R}, n AS facility_count FROM (SELECT {R}, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r
  FROM facilities WHERE "facilityTypeId" = 'hospital' GROUP BY 1) WHERE r = 1""")
sql("prioritised_facilities", f"""SELECT pk_unique_id, name, {R}, {ANY_FLAG} AS has_flag, source_count FROM facilities
  ORDER BY has_flag DESC, source_count DESC, pk_unique_id LIMIT 20""")
sql("top_facilities_per_region", f"""SELECT {BASE}, source_count, CAST(r AS INT) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY {R} ORDER BY source_count DESC, pk_unique_id) AS r FROM facilities) WHERE r <= 30""")
sql("facilities_with_region_scores", f"""SELECT pk_unique_id, name, f.{R}, desert_score, facility_count
  FROM facilities f LEFT JOIN weighted w ON f.{R} = w.{R}""")
sql("resource_concentration", f"""SELECT {R}, round(max("numberDoctors") / nullif(sum("numberDoctors"), 0), 6) AS doctor_share,
  round(max(capacity) / nullif(sum(capacity), 0), 6) AS bed_share FROM facilities GROUP BY 1""")
sql("region_problem_type", f"""SELECT {R}, round(d, 6) AS doctors_per_facility, round(e, 6) AS equipment_per_facility,
  CASE WHEN d < ad AND e < ae THEN 'both' WHEN e < ae THEN 'equipment' WHEN d < ad THEN 'practitioners' ELSE 'neither' END AS shortage
  FROM (SELECT {R}, avg(coalesce("numberDoctors", 0)) AS d, avg(num_equipment) AS e FROM facilities GROUP BY 1),
       (SELECT quantile_cont(d, 0.5) AS ad, quantile_cont(e, 0.5) AS ae
        FROM (SELECT avg(coalesce("numberDoctors", 0)) AS d, avg(num_equipment) AS e FROM facilities GROUP BY {R}))""")
REGIONAL = f"""
regional_items AS (
  SELECT f.{R}, c.field, c.item, count(DISTINCT pk_unique_id) AS n, min(pk_unique_id) AS first_facility
  FROM facilities f JOIN claims c USING (pk_unique_id) GROUP BY ALL
)"""
sql("missing_critical_specialties", f"""SELECT {R}, array_to_string(list_filter({array(CRITICAL_SPECIALTIES)},
  lambda s: NOT list_contains(coalesce(offered, []), s)), '; ') AS missing
  FROM (SELECT f.{R}, list(DISTINCT item) FILTER (WHERE field = 'specialties') AS offered
        FROM facilities f LEFT JOIN claims c USING (pk_unique_id) GROUP BY 1)""")
sql("specialties_by_region", f"""SELECT {R}, CAST(0 AS BIGINT) AS page, CAST(1 AS BIGINT) AS n_pages, string_agg(item, '; ' ORDER BY item) AS specialties FROM regional_items
  WHERE field = 'specialties' GROUP BY 1""", REGIONAL)
sql("single_point_specialties", f"SELECT {R}, item, first_facility FROM regional_items WHERE field = 'specialties' AND n = 1", REGIONAL)
sql("single_point_procedures", f"SELECT {R}, item, first_facility FROM regional_items WHERE field = 'procedure' AND n = 1", REGIONAL)
sql("scarce_procedures", f"SELECT {R}, item, n AS facilities FROM regional_items WHERE field = 'procedure' AND n <= 2", REGIONAL)
sql("procedure_supply_bands", f"""SELECT i.{R}, item, n AS facilities, total AS region_facilities, round(n / total, 6) AS share,
  CASE WHEN n / total >= 0.25 THEN 'oversupply' WHEN n / total <= 0.02 THEN 'scarce' ELSE 'normal' END AS supply
  FROM regional_items i JOIN (SELECT {R}, count(*) AS total FROM facilities GROUP BY 1) t ON i.{R} IS NOT DISTINCT FROM t.{R}
  WHERE field = 'procedure'""", REGIONAL)
sql("ngo_gap_regions", f"""SELECT {R}, facility_count, desert_score FROM weighted w WHERE desert_score > 50
  AND NOT EXISTS (SELECT 1 FROM facilities f WHERE f.organization_type = 'ngo' AND f.{R} = w.{R})""")
sql("ngo_service_overlaps", f"""SELECT {R}, item AS specialty, count(*) AS ngos FROM facilities JOIN claims USING (pk_unique_id)
  WHERE organization_type = 'ngo' AND field = 'specialties' GROUP BY ALL HAVING count(*) >= 2""")
POPULATION = f"""
population AS (SELECT {R}, count(*) AS population FROM people GROUP BY 1)"""
sql("population_table", "SELECT * FROM population", POPULATION)
sql("resources_per_head", f"""SELECT r.{R}, population, round(facility_count * 100000 / population, 6) AS facilities_per_head,
  round(total_doctors * 100000 / population, 6) AS doctors_per_head, round(total_beds * 100000 / population, 6) AS beds_per_head
  FROM regions r LEFT JOIN population p ON r.{R} = p.{R}""", POPULATION)
sql("surgery_workforce", f"""SELECT {R}, count(*) AS facilities, CAST(sum(coalesce("numberDoctors", 0)) AS BIGINT) AS doctors,
  count(*) FILTER (WHERE "numberDoctors" IS NULL) AS doctors_unknown FROM facilities WHERE claims_surgery GROUP BY 1""")
sql("specialists_unclear_location", f"""SELECT {R}, count(*) AS specialist_facilities,
  count(*) FILTER (WHERE "numberDoctors" IS NULL OR coalesce(email, "officialWebsite", "officialPhone") IS NULL) AS unclear
  FROM facilities WHERE num_specialties > 0 GROUP BY 1""")
sql("hospitals_with_cardiology", f"""SELECT {R}, count(*) AS hospitals FROM facilities f WHERE "facilityTypeId" = 'hospital'
  AND EXISTS (SELECT 1 FROM claims c WHERE c.pk_unique_id = f.pk_unique_id AND field = 'specialties' AND item ILIKE '%cardiology%') GROUP BY 1""")
sql("action_plan_inputs", f"""(SELECT 'region' AS kind, {R} AS subject, desert_score AS weight FROM weighted WHERE desert_score > 50
  ORDER BY desert_score DESC, {R} LIMIT 5) UNION ALL
  (SELECT 'facility', name, CAST(source_count AS DOUBLE) FROM facilities WHERE {ANY_FLAG} ORDER BY source_count DESC, pk_unique_id LIMIT 10)""")

# ---------------------------------------------------------------- geography
# District words of the region texts that are no region names themselves, found by hand.
DISTRICTS = {"Kumasi Metropolitan": "Ashanti", "Bolgatanga Municipal": "Upper East", "Ga East": "Greater Accra",
             "Ho": "Volta", "Wa West": "Upper West"}
assert set(DISTRICTS) < set(OTHER_REGIONS)
KNOWN = f"CASE {R} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in DISTRICTS.items()) + " END"
LOCATED = f"""
coords AS (SELECT pk_unique_id, coalesce(p.place, {KNOWN}) AS known_region, f.* EXCLUDE (pk_unique_id)
  FROM facilities f LEFT JOIN places p ON lower(p.place) = lower({R})),
located AS (
  SELECT c.*, round(plat + {slot("pk_unique_id || 'lat'", 300000)} / 300000.0::DOUBLE * 0.3::DOUBLE - 0.15::DOUBLE, 6) AS lat,
    round(plon + {slot("pk_unique_id || 'lon'", 300000)} / 300000.0::DOUBLE * 0.3::DOUBLE - 0.15::DOUBLE, 6) AS lon
  FROM coords c JOIN places ON known_region = place
),
distances AS (
  SELECT l.*, p.place, 2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin(radians(plat - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2)))) AS km
  FROM located l, places p
)"""
sql("region_coordinates", f"""SELECT {R}, count(*) AS facilities, known_region, plat AS lat, plon AS lon
  FROM coords LEFT JOIN places ON known_region = place GROUP BY ALL""", LOCATED)
sql("facility_positions", "SELECT pk_unique_id, known_region, lat, lon FROM located", LOCATED)
sql("facilities_within_km", "SELECT pk_unique_id, place, round(km, 6) AS km FROM distances WHERE claims_surgery AND km <= 60", LOCATED)
sql("hospitals_near_places", """SELECT place, count(pk_unique_id) AS facilities, round(min(km), 6) AS nearest_km
  FROM places LEFT JOIN (SELECT place, pk_unique_id, km FROM distances WHERE "facilityTypeId" = 'hospital' AND claims_surgery AND km <= 100)
  USING (place) GROUP BY place""", LOCATED)
sql("emergency_cold_spots", """SELECT place, plat AS lat, plon AS lon FROM places p
  WHERE NOT EXISTS (SELECT 1 FROM distances d WHERE d.place = p.place AND offers_emergency AND km <= 40)""", LOCATED)

KM = """2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"""
sql("nearest_emergency_provider", f"""SELECT facility, pk_unique_id, round(km, 6) AS km FROM (
  SELECT a.pk_unique_id AS facility, b.pk_unique_id, {KM} AS km,
    row_number() OVER (PARTITION BY a.pk_unique_id ORDER BY {KM}, b.pk_unique_id) AS r
  FROM located a, located b WHERE NOT a.offers_emergency AND b.offers_emergency) WHERE r = 1""", LOCATED)
sql("nearest_surgical_hospitals", """SELECT place, CAST(r AS INT) AS rank, pk_unique_id, round(km, 6) AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY km, pk_unique_id) AS r
  FROM distances WHERE "facilityTypeId" = 'hospital' AND claims_surgery) WHERE r <= 3""", LOCATED)
sql("demand_against_supply", f"""SELECT place, lat AS place_lat, lon AS place_lon, demand, coalesce(suppliers, 0) AS suppliers,
  round(coalesce(access, 0), 6) AS access, CASE WHEN suppliers IS NULL THEN 'none'
    WHEN coalesce(access, 0) < 0.5 * (SELECT sum("numberDoctors") FROM located WHERE "numberDoctors" > 0)::DOUBLE / (SELECT sum(demand) FROM cells)
    THEN 'low' ELSE 'served' END AS band
  FROM cells LEFT JOIN (
    SELECT place, sum(supply / load * weight) AS access, count(*) AS suppliers FROM pairs
    JOIN (SELECT pk_unique_id, sum(demand * weight) AS load FROM pairs GROUP BY 1) USING (pk_unique_id) WHERE load > 0 GROUP BY 1)
  USING (place)""", LOCATED + f""",
asking AS (SELECT *, coalesce(p.place, {KNOWN}) AS known_region FROM people LEFT JOIN places p ON lower(p.place) = lower({R})),
asking_at AS (SELECT requests, round(q.plat + {slot("user_id || 'lat'", 300000)} / 300000.0::DOUBLE * 0.3::DOUBLE - 0.15::DOUBLE, 6) AS lat,
    round(q.plon + {slot("user_id || 'lon'", 300000)} / 300000.0::DOUBLE * 0.3::DOUBLE - 0.15::DOUBLE, 6) AS lon
  FROM asking JOIN places q ON known_region = q.place),
cells AS (SELECT i || ':' || j AS place, round((i + 0.5::DOUBLE) * 0.1::DOUBLE, 6) AS lat, round((j + 0.5::DOUBLE) * 0.1::DOUBLE, 6) AS lon, demand
  FROM (SELECT CAST(floor(lat / 0.1::DOUBLE) AS BIGINT) AS i, CAST(floor(lon / 0.1::DOUBLE) AS BIGINT) AS j,
          CAST(sum(requests) AS BIGINT) AS demand FROM asking_at GROUP BY ALL)),
pairs AS (SELECT place, pk_unique_id, demand, supply, (exp(-0.5::DOUBLE * (km / 60) * (km / 60)) - exp(-0.5::DOUBLE)) / (1 - exp(-0.5::DOUBLE)) AS weight
  FROM (SELECT a.place, b.pk_unique_id, a.demand, b."numberDoctors" AS supply, {KM} AS km FROM cells a, located b
        WHERE b."numberDoctors" > 0) WHERE km <= 60)""")

# ---------------------------------------------------------------- search


def list_text(label_: str, field: str) -> str:
    return (f"(SELECT '{label_}: ' || array_to_string(any_value(items), ', ') FROM lists l "
            f"WHERE l.pk_unique_id = f.pk_unique_id AND l.field = '{field}')")


SEARCH_TEXT = """concat_ws(' | ', 'Facility Name: ' || name, 'Type: ' || "facilityTypeId", 'City: ' || address_city,
    'Region: ' || "address_stateOrRegion", 'Number of doctors: ' || "numberDoctors", 'Bed capacity: ' || capacity,
    'Description: ' || description, """ + ", ".join(list_text(a, b) for a, b in [
        ("Specialties", "specialties"), ("Procedures", "procedure"), ("Equipment", "equipment"),
        ("Capabilities", "capability")]) + ")"
sql("search_text", f"SELECT pk_unique_id, CAST(0 AS BIGINT) AS page, {SEARCH_TEXT} AS search_text FROM singles f")
PLAIN_LISTS = ", ".join(f"nullif({items(c)}, '')".replace("'; '", "' '") for c in ("specialties", "procedure", "equipment", "capability"))
sql("plain_search_text", f"SELECT pk_unique_id, CAST(0 AS BIGINT) AS page, concat_ws(' ', name, description, {PLAIN_LISTS}, address_city, {R}) AS search_text FROM singles f")
sql("keyword_search", """SELECT question_id, pk_unique_id, score, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pk_unique_id) AS r FROM (
    SELECT question_id, pk_unique_id, count(DISTINCT word) AS score
    FROM (SELECT question_id, unnest(regexp_split_to_array(lower(question), '\\s+')) AS word FROM asked) w
    JOIN parts ON contains(lower(txt), word) GROUP BY ALL)) WHERE r <= 10""")
sql("logged_question_keywords", """SELECT question_id, pk_unique_id, score, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pk_unique_id) AS r FROM (
    SELECT question_id, pk_unique_id, count(DISTINCT word) AS score
    FROM (SELECT question_id, unnest(regexp_split_to_array(lower(question_id), '\\s+')) AS word
          FROM (SELECT DISTINCT question AS question_id FROM question_log)) w
    JOIN parts ON contains(lower(txt), word) GROUP BY ALL)) WHERE r <= 3""")


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: t <> '')"


def tfidf(k: int, source: str = "parts", asked: str = "asked") -> str:
    return f"""
words AS (SELECT pk_unique_id, unnest({tokens('txt')}) AS term FROM {source}),
term_counts AS (SELECT pk_unique_id, term, count(*) AS tf FROM words GROUP BY ALL),
idfs AS (SELECT term, ln(((SELECT count(DISTINCT pk_unique_id) FROM term_counts) + 1) / (count(*) + 1)) AS idf FROM term_counts GROUP BY term),
doc_weights AS (SELECT pk_unique_id, term, tf * idf AS w FROM term_counts JOIN idfs USING (term)),
doc_norms AS (SELECT pk_unique_id, sqrt(sum(w * w)) AS norm FROM doc_weights GROUP BY 1),
question_weights AS (
  SELECT question_id, term, count(*) * any_value(idf) AS qw
  FROM (SELECT question_id, unnest({tokens('question')}) AS term FROM {asked}) JOIN idfs USING (term) GROUP BY ALL
),
question_norms AS (SELECT question_id, sqrt(sum(qw * qw)) AS q_norm FROM question_weights GROUP BY 1),
hits AS (
  SELECT question_id, pk_unique_id, score, CAST(r AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pk_unique_id) AS r FROM (
      SELECT question_id, pk_unique_id, round(sum(w * qw) / any_value(norm) / any_value(q_norm), 6) AS score
      FROM doc_weights JOIN question_weights USING (term) JOIN doc_norms USING (pk_unique_id) JOIN question_norms USING (question_id)
      WHERE q_norm > 0 GROUP BY ALL)) WHERE r <= {k}
)"""


sql("tfidf_search", "SELECT * FROM hits", tfidf(10))
LOGGED = "logged AS (SELECT DISTINCT question AS question_id, question FROM question_log),"
sql("logged_question_search", "SELECT * FROM hits", LOGGED + tfidf(3, asked="logged"))
sql("search_hits_with_facilities", f"""SELECT question_id, rank, score, pk_unique_id, name, {R}, "facilityTypeId", num_specialties
  FROM hits JOIN facilities USING (pk_unique_id)""", tfidf(5))
sql("filtered_search", "SELECT * FROM hits", """
hospital_parts AS (SELECT parts.* FROM parts JOIN singles USING (pk_unique_id) WHERE "facilityTypeId" = 'hospital'),""" + tfidf(5, "hospital_parts"))
CONTEXT = f"""concat_ws(chr(10), '[Facility ' || rank || ']', 'Name: ' || name, 'City: ' || address_city, 'Region: ' || {R},
    'Type: ' || "facilityTypeId", 'Operator: ' || "operatorTypeId", 'Doctors: ' || CAST(TRY_CAST("numberDoctors" AS DOUBLE) AS INT),
    'Bed Capacity: ' || CAST(TRY_CAST(capacity AS DOUBLE) AS INT), """ + ", ".join(list_text(a, b) for a, b in [
        ("Specialties", "specialties"), ("Procedures", "procedure"), ("Equipment", "equipment"),
        ("Capabilities", "capability")]) + ", 'Description: ' || left(description, 300))"
sql("question_retrieval_contexts", f"""SELECT question_id, count(*) AS hits, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context
  FROM (SELECT question_id, rank, {CONTEXT} AS block FROM hits JOIN singles f USING (pk_unique_id)) GROUP BY 1""", tfidf(5))
sql("logged_question_contexts", f"""SELECT question_id, count(*) AS hits, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context
  FROM (SELECT question_id, rank, {CONTEXT} AS block FROM hits JOIN singles f USING (pk_unique_id)) GROUP BY 1""",
    LOGGED + tfidf(3, asked="logged"))
sql("hashed_text_vectors", f"""SELECT pk_unique_id, count(*) AS entries, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots,
    round(sum(w) / nullif(sqrt(sum(w * w)), 0), 6) AS weight_sum
  FROM (SELECT pk_unique_id, slot, tf * ln((total + 1) / (count(*) OVER (PARTITION BY slot) + 1)) AS w
        FROM (SELECT pk_unique_id, {slot('term', 4096)} AS slot, count(*) AS tf FROM words GROUP BY ALL),
             (SELECT count(DISTINCT pk_unique_id) AS total FROM words)) GROUP BY 1""", f"""
words AS (SELECT pk_unique_id, unnest({tokens('txt')}) AS term FROM parts)""")

NEAREST = """
dims AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x::DOUBLE) AS m FROM dims GROUP BY ALL),
queries AS (SELECT label AS query_id, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM means GROUP BY 1),
unit_queries AS (SELECT query_id, list_transform(v, lambda y: y / n) AS q FROM queries)"""


def nearest(score: str, where: str = "") -> str:
    return f"""SELECT query_id, vec_id, score, CAST(r AS INT) AS rank FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
      SELECT query_id, vec_id, round({score}, 9) AS score FROM embeddings, unit_queries {where})) WHERE r <= 10"""


sql("vectors_nearest_cosine", nearest("list_inner_product(embedding::DOUBLE[], q)"), NEAREST)
sql("vectors_nearest_l2", nearest("-list_distance(embedding::DOUBLE[], q)"), NEAREST)
sql("vectors_nearest_filtered", nearest("list_inner_product(embedding::DOUBLE[], q)", "WHERE label < 5"), NEAREST)
EVERY_FIFTIETH = """
queries AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
unit_queries AS (SELECT query_id, list_transform(v, lambda y: y / sqrt(list_inner_product(v, v))) AS q FROM queries),
unit_vectors AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y: y / sqrt(
    list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS embedding FROM embeddings)"""
sql("vectors_index_exact", nearest("list_inner_product(embedding, q)").replace("FROM embeddings", "FROM unit_vectors"),
    EVERY_FIFTIETH)
sql("vectors_index_recall", "SELECT count(*) AS queries, true AS at_least_nine_tenths FROM embeddings WHERE vec_id % 50 = 0")
CLAIM_SLOTS = f"""
words AS (SELECT pk_unique_id, unnest({tokens('item')}) AS term FROM claims WHERE field IN ('specialties', 'capability')),
slot_counts AS (SELECT pk_unique_id, {slot('term', 4096)} AS slot, count(*) AS tf FROM words GROUP BY ALL),
idfs AS (SELECT slot, ln(((SELECT count(DISTINCT pk_unique_id) FROM words) + 1) / (count(*) + 1)) AS idf FROM slot_counts GROUP BY slot),
sparse AS (SELECT pk_unique_id, slot, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY pk_unique_id)) AS w
  FROM slot_counts JOIN idfs USING (slot))"""
sql("dense_claim_similarity", """SELECT query_id, pk_unique_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, pk_unique_id) AS r FROM (
    SELECT q.pk_unique_id AS query_id, a.pk_unique_id, coalesce(any_value(s), 0.0) AS s
    FROM (SELECT DISTINCT pk_unique_id FROM sparse WHERE pk_unique_id % 50 = 0) q
    CROSS JOIN (SELECT DISTINCT pk_unique_id FROM sparse) a
    LEFT JOIN (SELECT x.pk_unique_id AS one, y.pk_unique_id AS other, sum(x.w * y.w) AS s
               FROM sparse x JOIN sparse y USING (slot) WHERE x.pk_unique_id % 50 = 0 GROUP BY ALL)
      ON one = q.pk_unique_id AND other = a.pk_unique_id GROUP BY ALL)) WHERE r <= 10""", CLAIM_SLOTS)
sql("facility_services", """SELECT pk_unique_id, name, field, item FROM claims JOIN singles USING (pk_unique_id) WHERE name ILIKE '%heart centre%'""")
sql("specialty_keyword_counts", " UNION ALL ".join(
    f"SELECT '{w}' AS keyword, count(DISTINCT pk_unique_id) AS facilities FROM claims WHERE field = 'specialties' AND item ILIKE '%{s}%'"
    for w, s in SPECIALTY_KEYWORDS.items()))
PHRASES = "\nphrases AS (" + " UNION ALL ".join(
    f"SELECT pk_unique_id, {R}, '{name}' AS label FROM singles WHERE regexp_matches(description, {text(p)})"
    for name, p in PHRASE_RULES.items()) + ")"
sql("facility_phrases", "SELECT * FROM phrases", PHRASES)
sql("region_phrase_counts", f"SELECT {R}, label, count(*) AS facilities FROM phrases GROUP BY ALL", PHRASES)

# ---------------------------------------------------------------- rules and validation


def rule_sql(column: str, rules: list[tuple], where: str, columns: str) -> str:
    """Matches as rows; a match goes when a blocking or, of a lower level, any higher match exists."""
    rows = " UNION ALL ".join(
        f"SELECT pk_unique_id, '{name}' AS s, {level} AS lvl, CAST({array(blocked) if blocked else '[]'} AS VARCHAR[]) AS blocked "
        f"FROM singles WHERE regexp_matches({column}, {text(pattern)})" for pattern, name, level, blocked in rules)
    return f"""WITH hits AS ({rows}),
  best AS (SELECT h.* FROM hits h JOIN (SELECT pk_unique_id, max(lvl) AS top FROM hits GROUP BY 1) USING (pk_unique_id) WHERE lvl = top),
  kept AS (SELECT DISTINCT pk_unique_id, s FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.pk_unique_id = b.pk_unique_id AND list_contains(b.blocked, o.s)))
SELECT {columns}, coalesce((SELECT string_agg(s, '; ' ORDER BY s) FROM kept WHERE kept.pk_unique_id = f.pk_unique_id), '') AS specialties
FROM singles f {where}"""


ORACLE["specialties_from_names"] = PRELUDE + " SELECT * FROM (" + rule_sql("name", NAME_RULES, "", "pk_unique_id, name") + ")"
ORACLE["specialties_from_text"] = (PRELUDE + " SELECT * FROM ("
                                   + rule_sql("description", CONTEXT_RULES, "WHERE description IS NOT NULL", "pk_unique_id") + ")")
sql("canonical_specialties", "SELECT DISTINCT pk_unique_id, CASE lower(item) "
    + " ".join(f"WHEN {text(k.lower())} THEN {text(v)}" for k, v in TERM_MAP.items())
    + " ELSE item END AS specialty FROM claims WHERE field = 'specialties'")
sql("enum_violations", f"""SELECT 'affiliationTypeIds' AS column_name, item AS value, count(*) AS rows FROM claim_sources
    WHERE field = 'affiliationTypeIds' AND NOT list_contains({array(AFFILIATION_TYPES)}, item) GROUP BY 2
  UNION ALL SELECT 'facilityTypeId', "facilityTypeId", count(*) FROM mentions
    WHERE "facilityTypeId" NOT IN ('hospital','pharmacy','doctor','clinic','dentist','null') GROUP BY 2
  UNION ALL SELECT 'operatorTypeId', "operatorTypeId", count(*) FROM mentions WHERE "operatorTypeId" NOT IN ('public','private','null') GROUP BY 2""")
sql("phone_check", """SELECT DISTINCT pk_unique_id, phone, regexp_full_match(phone, '\\+[1-9][0-9]{1,14}') AS valid FROM (
  SELECT pk_unique_id, "officialPhone" AS phone FROM mentions UNION ALL
  SELECT pk_unique_id, item FROM claim_sources WHERE field = 'phone_numbers')""")
HOST = "regexp_replace(lower(split_part(split_part(split_part(regexp_replace({0}, '^[a-zA-Z]+://', ''), '/', 1), '?', 1), '#', 1)), '^www\\.', '')"
sql("website_hosts", f"""SELECT DISTINCT pk_unique_id, {HOST.format('u')} AS host FROM (
  SELECT pk_unique_id, "officialWebsite" AS u FROM mentions WHERE "officialWebsite" IS NOT NULL UNION ALL
  SELECT pk_unique_id, item FROM claim_sources WHERE field = 'websites')""")
ORACLE["page_hosts"] = f"SELECT {HOST.format('url')} AS host, count(*) AS pages FROM pages GROUP BY 1"
sql("country_code_check", """SELECT CASE WHEN "address_countryCode" = 'GH' THEN 'ok' WHEN "address_countryCode" IS NOT NULL THEN 'malformed'
  ELSE 'required' END AS state, count(*) AS rows FROM mentions GROUP BY 1""")
sql("cleaned_names", """SELECT pk_unique_id, name, trim(regexp_replace(regexp_replace(name, '[,\\s]+(Ltd|LLC|Inc)\\b\\.?', '', 'gi'), '\\s+', ' ', 'g'))
  AS clean_name FROM singles""")
sql("organisation_hints", f"""SELECT organization_type, CASE WHEN regexp_matches(name, '(?i)\\b({'|'.join(NGO_WORDS)})\\b') THEN 'ngo' ELSE 'facility' END
  AS hint, count(*) AS facilities FROM singles GROUP BY ALL""")
sql("repeated_facts", """SELECT pk_unique_id, lower(item) AS fact, count(DISTINCT field) AS categories FROM claims
  WHERE field IN ('procedure', 'equipment', 'capability') GROUP BY ALL HAVING count(DISTINCT field) > 1""")
HEX = 'token = "[0-9a-f]{40}"'
ORACLE["scrubbed_documents"] = f"""SELECT doc_id, len(regexp_extract_all(text, 'gsk_[a-zA-Z0-9]+')) AS api_key_hits,
  len(regexp_extract_all(text, '{HEX}')) AS hex_token_hits,
  regexp_replace(regexp_replace(text, 'gsk_[a-zA-Z0-9]+', '{SECRET_MASK}', 'g'), '{HEX}', '{SECRET_MASK}', 'g') AS masked_text FROM documents"""

# ---------------------------------------------------------------- questions


def hits(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), {text(w)}) AS INT)" for w in words) + ")"


INTENT = (f"CASE WHEN greatest(s, m, r) = 0 THEN 'SEMANTIC' WHEN s >= m AND s >= r THEN 'SQL' WHEN m >= r THEN 'SEMANTIC' ELSE 'REASONING' END")
INTENTS = f"""
intents AS (
  SELECT *, {INTENT} AS intent,
    CASE expected_route WHEN 'STRUCTURED' THEN 'SQL' WHEN 'DESERT' THEN 'REASONING' ELSE expected_route END AS expected
  FROM (SELECT *, {hits('question', INTENT_KEYWORDS['SQL'])} AS s, {hits('question', INTENT_KEYWORDS['SEMANTIC'])} AS m,
          {hits('question', INTENT_KEYWORDS['REASONING'])} AS r FROM question_log)
)"""
sql("intent_keywords", "SELECT event_id, question, intent FROM intents", INTENTS)
sql("intent_counts", "SELECT intent, count(*) AS questions FROM intents GROUP BY 1", INTENTS)
sql("repaired_labels", "SELECT event_id, CASE " + " ".join(
    f"WHEN contains(upper(reply), '{x}') THEN '{x}'" for x in ROUTE_LABELS) + " ELSE 'SEMANTIC' END AS label FROM question_log")
WORD = f"(?i)\\b({'|'.join(BLOCKED_WORDS)})\\b"
sql("sql_audit", f"""SELECT CASE WHEN w <> '' THEN 'blocked word' WHEN regexp_matches(sql_text, ';\\s*\\w') THEN 'several statements' ELSE 'allowed' END AS verdict,
  nullif(upper(w), '') AS blocked_word, count(*) AS statements
  FROM (SELECT sql_text, regexp_extract(sql_text, '{WORD}', 1) AS w FROM question_log) GROUP BY ALL""")
sql("guarded_select", f"""SELECT {R}, "facilityTypeId", count(*) AS facilities, max(num_procedures) AS most_procedures FROM facilities
  WHERE capacity > 50 GROUP BY ALL ORDER BY facilities DESC, {R} NULLS FIRST, "facilityTypeId" NULLS FIRST LIMIT 50""")
# A region is named where its words occur in a row in the question's words.
PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
FACTS = f"""
facts AS (
  SELECT event_id, question, CASE WHEN contains(lower(question), 'hospital') THEN 'hospital' WHEN contains(lower(question), 'clinic') THEN 'clinic'
      WHEN contains(lower(question), 'pharmacy') THEN 'pharmacy' WHEN contains(lower(question), 'dentist') THEN 'dentist' END AS type,
    (SELECT arg_max(n.{R}, (length(n.{R}), n.{R})) FROM (SELECT DISTINCT {R} FROM singles WHERE {R} IS NOT NULL) n
     WHERE contains(' ' || {PLAIN.format('question')} || ' ', ' ' || {PLAIN.format('n.' + R)} || ' ')) AS region
  FROM question_log
)"""


def cell(column: str) -> str:
    return f"left(coalesce(CAST(\"{column}\" AS VARCHAR), 'N/A'), 200)"


FACILITY_LINE = (f"'- ' || {cell('name')} || ' [' || {cell('facilityTypeId')} || '] in ' || {cell('address_city')} || ', ' || "
                 f"{cell('address_stateOrRegion')} || ' | Doctors: ' || {cell('numberDoctors')} || ' | Beds: ' || {cell('capacity')} || "
                 "' | Specialties: ' || left(coalesce((SELECT CAST(to_json(items) AS VARCHAR) FROM lists l WHERE l.pk_unique_id = f.pk_unique_id AND l.field = 'specialties'), '[]'), 200) || "
                 f"' | Procedures: ' || {cell('num_procedures')} || ' | Equipment: ' || {cell('num_equipment')}")
CONTEXTS = f"""
options AS (
  SELECT DISTINCT * FROM (
    SELECT {R} AS region, "facilityTypeId" AS type, pk_unique_id FROM facilities
    UNION ALL SELECT {R}, NULL, pk_unique_id FROM facilities UNION ALL SELECT NULL, "facilityTypeId", pk_unique_id FROM facilities
    UNION ALL SELECT NULL, NULL, pk_unique_id FROM facilities)
),
reasoning AS (
  SELECT region, type, count(*) AS facilities, string_agg(line, chr(10) ORDER BY r) AS context FROM (
    SELECT o.region, o.type, {FACILITY_LINE} AS line, row_number() OVER (PARTITION BY o.region, o.type
      ORDER BY {ANY_FLAG} DESC, source_count DESC, pk_unique_id) AS r FROM options o JOIN facilities f USING (pk_unique_id)) WHERE r <= 20
  GROUP BY region, type
)"""
sql("question_facts", "SELECT event_id, type, region FROM facts", FACTS)
sql("reasoning_contexts", "SELECT * FROM reasoning", CONTEXTS)
sql("question_reasoning", """SELECT event_id, f.region, f.type, coalesce(facilities, 0) AS facilities,
  coalesce(context, 'No matching facilities found.') AS context FROM facts f
  LEFT JOIN reasoning r ON f.region IS NOT DISTINCT FROM r.region AND f.type IS NOT DISTINCT FROM r.type""", FACTS + "," + CONTEXTS)
YES = "CASE WHEN {0} > 0 THEN 'Yes' ELSE 'No' END"
sql("region_lines", f"""SELECT {R}, coalesce({R}, 'N/A') || ' | Facilities: ' || facility_count || ' | Doctors: ' || total_doctors || ' | Beds: ' || total_beds
  || ' | Hospitals: ' || hospital_count || ' | Surgery: ' || {YES.format('has_surgery')} || ' | Emergency: ' || {YES.format('has_emergency')}
  || ' | Obstetrics: ' || {YES.format('has_obstetrics')} || ' | Pediatrics: ' || {YES.format('has_pediatrics')} || ' | Score: ' || desert_score AS line FROM regions""")
BLOCK_ORDER = ["totals", "regions", *[f"specialty {w}" for w in SPECIALTY_KEYWORDS], "anomalies", "deserts"]
BLOCKS = LOCATED + f""",
known_regions AS (
  SELECT *, 100 - 2 * facility_count - total_doctors - 10 * has_surgery - 10 * has_emergency - 5 * has_obstetrics AS desert_score
  FROM (SELECT known_region AS {R}, count(*) AS facility_count, CAST(sum(coalesce("numberDoctors", 0)) AS BIGINT) AS total_doctors,
          count(*) FILTER (WHERE claims_surgery) AS has_surgery, count(*) FILTER (WHERE claims_emergency) AS has_emergency,
          count(*) FILTER (WHERE claims_obstetrics) AS has_obstetrics FROM coords GROUP BY 1)),
blocks AS (
  SELECT 'totals' AS block, 'Total facilities: ' || sum(n) || chr(10) || 'By type: ' || string_agg(t || ': ' || n, ', ' ORDER BY n DESC, t) AS text
    FROM (SELECT coalesce("facilityTypeId", 'N/A') AS t, count(*) AS n FROM facilities GROUP BY 1)
  UNION ALL SELECT 'regions', string_agg('Region ' || g || ': ' || facility_count || ' facilities, ' || total_doctors || ' doctors', chr(10)
    ORDER BY facility_count DESC, g) FROM (SELECT *, coalesce({R}, 'N/A') AS g FROM known_regions)
  UNION ALL SELECT 'anomalies', {" || chr(10) || ".join(f"'Anomalies - {label(f)}: ' || count(*) FILTER (WHERE {f})" for f in FLAGS)} FROM facilities
  UNION ALL SELECT 'deserts', string_agg(coalesce({R}, 'N/A') || ': score=' || desert_score || ', facilities=' || facility_count
    || ', doctors=' || total_doctors || ', surgery=' || {YES.format('has_surgery')}, chr(10) ORDER BY desert_score DESC, coalesce({R}, ''))
    FROM (SELECT * FROM known_regions ORDER BY desert_score DESC, {R} NULLS FIRST LIMIT 5)
  UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'specialty {w}', 'Facilities with {w}: ' || count(DISTINCT pk_unique_id) FROM claims WHERE field = 'specialties' AND item ILIKE '%{s}%'"
    for w, s in SPECIALTY_KEYWORDS.items()) + ")"
TRIGGERS = CONTEXT_TRIGGERS | {f"specialty {w}": [w] for w in SPECIALTY_KEYWORDS}
ASKED_BLOCKS = "\nasked_blocks AS (" + " UNION ALL ".join(
    f"SELECT event_id, {i} AS pos, '{b}' AS block FROM question_log WHERE {hits('question', TRIGGERS[b])} > 0"
    for i, b in enumerate(BLOCK_ORDER)) + ")"
sql("structured_context_blocks", "SELECT * FROM blocks", BLOCKS)
sql("question_structured_context", """SELECT event_id, count(text) AS blocks, coalesce(string_agg(text, chr(10) ORDER BY pos), 'No structured data pulled.') AS context
  FROM question_log LEFT JOIN asked_blocks USING (event_id) LEFT JOIN blocks USING (block) GROUP BY event_id""", BLOCKS + "," + ASKED_BLOCKS)
CITED = f"""
cited AS (
  SELECT event_id, CAST(pos AS INT) AS pos, id, name, {R} AS region
  FROM (SELECT event_id, unnest(source_ids) AS id, generate_subscripts(source_ids, 1) - 1 AS pos FROM question_log)
  JOIN singles ON id = CAST(pk_unique_id AS VARCHAR) WHERE pos < 10
)"""
sql("citations", "SELECT * FROM cited", CITED)
sql("citation_lists", """SELECT event_id, count(*) AS citation_count,
  CAST(to_json(list({'id': id, 'name': name, 'region': region} ORDER BY pos)) AS VARCHAR) AS citations_json FROM cited GROUP BY 1""", CITED)
sql("trace_rows", """SELECT event_id, question, expected_route AS category, agent AS agent_used, length(answer) AS answer_length,
  least(len(source_ids), 10) AS citation_count, (total_ms // 10 + CASE WHEN total_ms % 10 > 5 OR (total_ms % 10 = 5 AND (total_ms // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS total_time_seconds, ts AS timestamp, left(answer, 500) AS answer_preview,
  CAST(to_json({'question': question, 'steps': steps}) AS VARCHAR) AS trace_json
  FROM question_log JOIN (SELECT event_id, list({'step': step, 'output': output, 'ms': ms} ORDER BY step <> 'classify') AS steps,
    max(step) FILTER (WHERE step <> 'classify') AS agent FROM log_steps GROUP BY 1) USING (event_id)""")
sql("trace_step_latency", """SELECT step, count(*) AS runs, round(avg(ms), 6) AS avg_ms, quantile_disc(ms, 0.5) AS median_ms,
  max(ms) AS max_ms, round(avg(sources), 6) AS avg_sources FROM log_steps GROUP BY 1""")
sql("evaluation_results", """SELECT event_id, question_id, question_category, expected_route, intent AS actual_intent,
  intent = expected AS correct_route, length(answer) AS answer_length, total_ms FROM intents""", INTENTS)
sql("evaluation_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE intent = expected) AS correct,
  round(100.0 * count(*) FILTER (WHERE intent = expected) / count(*), 6) AS accuracy_percent, round(avg(total_ms) / 1000, 6) AS avg_seconds,
  round(avg(length(answer)), 6) AS avg_answer_length FROM intents""", INTENTS)
sql("evaluation_by_category", """SELECT CASE WHEN grouping(question_category) = 1 THEN 'ALL' ELSE question_category END AS category, count(*) AS total,
  count(*) FILTER (WHERE intent = expected) AS correct, round(avg(total_ms) / 1000, 6) AS avg_seconds FROM intents GROUP BY ROLLUP (question_category)""", INTENTS)
sql("route_confusion", "SELECT expected_route, intent AS actual_intent, count(*) AS questions FROM intents GROUP BY ALL", INTENTS)

# ---------------------------------------------------------------- changes and streams
SNAPSHOT = ["name", "facilityTypeId", "address_city", "address_stateOrRegion", "description", "email"]


def snapshot(where: str) -> str:
    cells = ", ".join(
        f"arg_min({known(chr(34) + c + chr(34))}, source_url) FILTER (WHERE {known(chr(34) + c + chr(34))} IS NOT NULL) AS \"{c}\""
        for c in SNAPSHOT)
    return f"SELECT pk_unique_id, {cells}, count(*) AS source_count FROM mentions {where} GROUP BY 1"


SAME = " AND ".join(f'a."{c}" IS NOT DISTINCT FROM b."{c}"' for c in [*SNAPSHOT, "source_count"])
CHANGES = f"""
before AS ({snapshot("WHERE scraped_at < TIMESTAMP '1998-07-01'")}), after AS ({snapshot('')}),
changed AS (SELECT coalesce(a.pk_unique_id, b.pk_unique_id) AS pk_unique_id, CASE WHEN b.pk_unique_id IS NULL THEN 'insert'
    WHEN a.pk_unique_id IS NULL THEN 'delete' ELSE 'update' END AS change
  FROM after a FULL JOIN before b ON a.pk_unique_id = b.pk_unique_id
  WHERE a.pk_unique_id IS NULL OR b.pk_unique_id IS NULL OR NOT ({SAME}))"""
sql("snapshot_changes", "SELECT * FROM changed", CHANGES)
# The same tables over the mentions of the earlier snapshot.
EARLIER = re.sub(r"\b(raw_lists|parsed_lists|claim_sources|all_claims|claims|lists)\b", r"\1_before", CLAIMS).replace(
    "FROM mentions", "FROM mentions_before")
sql("incremental_index_sync", """SELECT coalesce(n.pk_unique_id, o.pk_unique_id) AS pk_unique_id, CAST(0 AS BIGINT) AS page,
  CASE WHEN o.pk_unique_id IS NULL THEN 'insert' WHEN n.pk_unique_id IS NULL THEN 'delete' ELSE 'update' END AS change,
  n.search_text FROM texts n FULL JOIN texts_before o ON n.pk_unique_id = o.pk_unique_id
  WHERE n.search_text IS DISTINCT FROM o.search_text""", f"""
mentions_before AS (SELECT * FROM mentions WHERE scraped_at < TIMESTAMP '1998-07-01'), {EARLIER},
singles_before AS ({_singles('mentions_before')}),
texts AS (SELECT pk_unique_id, {SEARCH_TEXT} AS search_text FROM singles f),
texts_before AS (SELECT pk_unique_id, {re.sub(r"FROM lists l", "FROM lists_before l", SEARCH_TEXT)} AS search_text FROM singles_before f)""")
USERS = """SELECT user_id, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLE["upserted_users"] = USERS
ORACLE["stream_keyed_users"] = USERS
ORACLE["stream_hourly_activity"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events,
  round(sum(value), 4) AS value_sum, max(value) AS value_max FROM events GROUP BY 1, 2"""
ORACLE["stream_activity_with_watermark"] = ORACLE["stream_hourly_activity"]
sql("stream_agent_latency", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, step AS agent,
  count(*) AS runs, round(avg(ms), 6) AS avg_ms, quantile_disc(ms, 0.5) AS median_ms, quantile_disc(ms, 0.95) AS p95_ms,
  max(ms) AS max_ms FROM log_steps JOIN events USING (event_id) WHERE step <> 'classify' GROUP BY ALL""")
sql("registry_from_csv", """SELECT pk_unique_id, count(*) + count(*) FILTER (WHERE scraped_at >= TIMESTAMP '1998-07-01') AS row_count,
  count(name) AS named, max(scraped_at) FILTER (WHERE scraped_at >= TIMESTAMP '1998-07-01') AS last_scraped
  FROM mentions GROUP BY 1""")
sql("list_sizes_and_texts", f"""SELECT m.pk_unique_id, m.source_url,
  CASE WHEN specialties LIKE '[%' THEN json_array_length(CAST(specialties AS JSON)) ELSE 0 END::BIGINT AS raw_items,
  CAST(to_json(list_sort(CASE WHEN specialties LIKE '[%' THEN CAST(CAST(specialties AS JSON) AS VARCHAR[]) ELSE [] END)) AS VARCHAR) AS cleaned
  FROM mentions m""")

