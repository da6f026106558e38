"""All registered queries: name -> function of (spark, data folder).

Arrays are shown as joined text so that any engine can compare the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lists import item_count, json_items, to_json_list
from ..operators import (
    bundles, catchment, changes, embedding, evaluation, flags, geo, merge, profile, regions, routing, rules, search,
    vector_index,
)
from ..session import apply_runtime_settings, new_path, stored
from ..sources.dimensions import QUESTIONS, REGION_COORDS
from ..sources.mentions import DERIVED_EQUIPMENT_RULES, logged_questions
from ..sources.tables import (
    KEY, REGISTRY_SCHEMA, SOURCE, describe_columns, domain_values, read_evolving, read_registry_csv, register_view,
    with_safe_names, write_table,
)
from ..streaming import jobs
from .tables import SNAPSHOT_CUT, Registry

REGION = "address_stateOrRegion"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ASKED = [(q[0], q[1]) for q in QUESTIONS]
PLACES = list(REGION_COORDS)
LIST_SEPARATOR = "; "
#: Queries that SQL cannot state; tests hold them against brute force.
NO_SQL = {"dense_text_search"}


def query(function: Callable[[Registry], DataFrame]) -> Callable[[Registry], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        apply_runtime_settings(spark)
        return function(Registry(spark, folder))

    QUERIES[function.__name__] = run
    return function


def joined(column: str):
    return F.array_join(column, LIST_SEPARATOR).alias(column)


# ---------------------------------------------------------------- merge

@query
def facility_mentions(t):
    return t.mentions


@query
def merge_by_key(t):
    merged = merge.merge_by_key(t.stored_mentions)
    lists = [f for f in ("specialties", "procedure", "equipment", "capability", "phone_numbers", "websites",
                         "affiliationTypeIds")]
    return merged.select(*[c for c in merged.columns if c not in lists], *[joined(c) for c in lists])


@query
def merged_list_pages(t):
    pages = merge.paged_lists(merge.distinct_claims(t.mentions))
    return pages.select(KEY, "field", "page", "n_pages", joined("items"))


@query
def source_urls_by_facility(t):
    return merge.source_url_lists(t.mentions).select(KEY, "page", "n_pages", joined("source_urls"))


@query
def merged_raw_text(t):
    return merge.merge_raw_text(t.mentions, ["specialties", "procedure", "equipment", "capability", "description"])


@query
def duplicate_statistics(t):
    return merge.duplicate_statistics(t.mentions)


@query
def duplicate_keys(t):
    return merge.duplicate_keys(t.mentions)


@query
def corroborated_claims(t):
    return merge.corroborated_claims(t.mentions, ["procedure", "equipment"])


@query
def list_field_coverage(t):
    return profile.list_coverage(t.mentions, ["procedure", "equipment", "capability"])


@query
def table_columns(t):
    """The columns of the tables that the registry is made from."""
    tables = ("customer", "events", "lineitem", "nation", "orders", "part")
    described = [describe_columns(t.table(name)).select(F.lit(name).alias("table_name"), "position", "col_name", "data_type")
                 for name in tables]
    return reduce(DataFrame.unionByName, described)


@query
def domain_value_counts(t):
    return domain_values(t.singles, ["facilityTypeId", "operatorTypeId", REGION])


@query
def organization_type_counts(t):
    return profile.value_counts(t.mentions, "organization_type")


@query
def raw_facility_type_counts(t):
    return profile.value_counts(t.mentions, "facilityTypeId")


@query
def column_profile(t):
    return profile.column_profile(
        t.mentions,
        ["name", "email", "officialPhone", "address_countryCode", "facilityTypeId", "numberDoctors", "capacity",
         "description", "acceptsVolunteers", REGION],
        ["specialties", "procedure", "equipment", "capability"],
    )


# ---------------------------------------------------------------- facilities and flags

@query
def facilities_enriched(t):
    return flags.enrich(t.stored_mentions)


@query
def flag_summary(t):
    return flags.flag_summary(t.facilities)


@query
def flagged_facilities(t):
    return flags.flagged_table(t.facilities)


@query
def flagged_hospitals_in_region(t):
    rows = flags.browse_flagged(t.facilities, "flag_no_doctors_listed", "Ashanti")
    return rows.select(KEY, "name", "facilityTypeId", "capacity", "num_procedures")


@query
def anomaly_unrealistic_procedures(t):
    return flags.unrealistic_procedures(t.signalled("specialties", "procedure", "equipment"))


@query
def anomaly_mismatched_capabilities(t):
    rows = flags.mismatched_capabilities(t.signalled("specialties", "equipment"))
    return flags.with_specialty_list(rows, t.mentions).withColumn("specialties", joined("specialties"))


@query
def anomaly_clinic_claims_surgery(t):
    rows = flags.clinic_claims_surgery(t.facilities)
    return flags.with_specialty_list(rows, t.mentions).withColumn("specialties", joined("specialties"))


@query
def anomaly_high_capacity_no_equipment(t):
    return flags.high_capacity_no_equipment(t.facilities)


@query
def anomaly_too_many_specialties(t):
    rows = flags.too_many_specialties(t.facilities)
    return flags.with_specialty_list(rows, t.mentions).withColumn("specialties", joined("specialties"))


@query
def anomaly_correlated_features(t):
    return flags.correlated_features(t.signalled("specialties", "procedure", "equipment"))


@query
def anomaly_single_facility_dependency(t):
    return flags.single_facility_dependency(t.signalled("specialties"))


@query
def anomaly_breadth_outliers(t):
    rows = flags.breadth_outliers(t.signalled("procedure", "equipment"))
    return rows.withColumns({"ratio": F.round("ratio", 6), "z_score": F.round("z_score", 6)})


@query
def missing_equipment(t):
    return flags.missing_equipment(t.claims_of("procedure", "equipment"), rules=DERIVED_EQUIPMENT_RULES)


@query
def equipment_compliance(t):
    return flags.equipment_compliance(t.claims_of("procedure", "equipment"), rules=DERIVED_EQUIPMENT_RULES)


@query
def type_claim_mismatch(t):
    return flags.type_claim_mismatch(t.facilities, t.claims)


@query
def credibility(t):
    return flags.credibility(t.facilities)


# ---------------------------------------------------------------- profiles

@query
def type_profile(t):
    return profile.type_profile(t.numbers)


@query
def facility_type_counts(t):
    return profile.value_counts(t.singles, "facilityTypeId")


@query
def operator_counts(t):
    return profile.value_counts(t.singles, "operatorTypeId", "Unknown")


@query
def facility_type_shares(t):
    return profile.value_shares(t.singles, "facilityTypeId")


@query
def key_figures(t):
    return profile.key_figures(t.facilities)


@query
def feature_correlation(t):
    return profile.feature_correlation(t.signalled("specialties", "procedure", "equipment"))


@query
def contact_quality_correlation(t):
    return profile.contact_quality(t.signalled("procedure", "equipment", "capability"))


@query
def default_specialty_share(t):
    return profile.default_tag_share(t.claims_of("specialties"))


@query
def service_bundles(t):
    return profile.service_bundles(t.claims_of("procedure", "equipment"), 0.05)


@query
def service_bundles_by_region(t):
    claims = t.claims_of("procedure", "equipment").join(t.singles.select(KEY, REGION), KEY)
    return profile.service_bundles(claims, 0.3, by=REGION)


@query
def closed_service_bundles(t):
    found = bundles.closed_bundles(t.claims_of("procedure", "equipment"), 0.15)
    return found.select(joined("items"), F.size("items").cast("bigint").alias("n_items"), "facilities")


# ---------------------------------------------------------------- regions

@query
def regional_stats(t):
    return regions.regional_stats(t.numbers)


@query
def specialty_coverage(t):
    return regions.specialty_coverage(t.signalled("specialties"))


@query
def regional_analysis(t):
    return t.regions


@query
def desert_score_weighted(t):
    return t.weighted


@query
def desert_score_weighted_all_regions(t):
    return regions.weighted_regions(t.facilities, drop_null_region=False)


@query
def region_map_rows(t):
    return regions.map_rows(t.weighted)


@query
def region_priority_ranking(t):
    return regions.priority_ranking(t.regions)


@query
def most_underserved_regions(t):
    return regions.most_underserved(t.regions).select(REGION, "facility_count", "total_doctors", "desert_score")


@query
def critical_regions(t):
    return regions.critical_regions(t.weighted).select(REGION, "facility_count", "desert_score")


@query
def region_with_most_hospitals(t):
    return regions.region_with_most(t.numbers)


@query
def prioritised_facilities(t):
    return regions.prioritised(t.facilities)


@query
def top_facilities_per_region(t):
    return regions.top_per_region(t.numbers)


@query
def facilities_with_region_scores(t):
    facilities = t.enriched_table
    scored = regions.with_region_scores(facilities, regions.weighted_regions(facilities))
    return scored.select(KEY, "name", REGION, "desert_score", "facility_count")


@query
def resource_concentration(t):
    return regions.concentration(t.numbers)


@query
def region_problem_type(t):
    return regions.problem_type(t.signalled("equipment"))


@query
def missing_critical_specialties(t):
    return regions.missing_specialties(t.facilities, t.claims_of("specialties")).select(REGION, joined("missing"))


@query
def specialties_by_region(t):
    listed = regions.specialties_by_region(t.facilities, t.claims_of("specialties"))
    return listed.select(REGION, "page", "n_pages", joined("specialties"))


@query
def single_point_specialties(t):
    return regions.single_point_dependencies(t.facilities, t.claims_of("specialties"))


@query
def single_point_procedures(t):
    return regions.single_point_dependencies(t.facilities, t.claims_of("procedure"), "procedure")


@query
def scarce_procedures(t):
    return regions.scarce_items(t.facilities, t.claims_of("procedure"))


@query
def procedure_supply_bands(t):
    return regions.supply_bands(t.facilities, t.claims_of("procedure"))


@query
def ngo_gap_regions(t):
    facilities = t.enriched_table
    return regions.ngo_gaps(facilities, regions.weighted_regions(facilities)).select(REGION, "facility_count", "desert_score")


@query
def ngo_service_overlaps(t):
    return regions.ngo_overlaps(t.facilities, t.claims_of("specialties"))


@query
def population_table(t):
    return _population(t)


def _population(t):
    """People per region text, from the side table of demand."""
    return t.people.groupBy(REGION).agg(F.count("*").alias("population"))


@query
def resources_per_head(t):
    return regions.per_head(t.regions, _population(t))


@query
def surgery_workforce(t):
    return regions.workforce(t.signalled("specialties"))


@query
def specialists_unclear_location(t):
    return regions.unclear_location(t.signalled("specialties"))


@query
def hospitals_with_cardiology(t):
    hospitals = t.facilities.where(F.col("facilityTypeId") == "hospital").select(KEY, REGION)
    cardio = t.claims_of("specialties").where(F.contains(F.lower("item"), F.lit("cardiology"))).select(KEY).distinct()
    return hospitals.join(cardio, KEY, "left_semi").groupBy(REGION).agg(F.count("*").alias("hospitals"))


@query
def action_plan_inputs(t):
    facilities = t.enriched_table
    areas = regions.critical_regions(regions.weighted_regions(facilities)).select(
        F.lit("region").alias("kind"), F.col(REGION).alias("subject"), F.col("desert_score").alias("weight"))
    sites = regions.prioritised(facilities.where(flags.any_flag()), 10).select(
        F.lit("facility").alias("kind"), F.col("name").alias("subject"), F.col("source_count").cast("double").alias("weight"))
    return areas.unionByName(sites)


# ---------------------------------------------------------------- geography

@query
def region_coordinates(t):
    return geo.region_coordinates(t.singles)


@query
def facility_positions(t):
    return t.located().select(KEY, "known_region", "lat", "lon")


@query
def facilities_within_km(t):
    surgical = t.located("specialties").where(F.col("claims_surgery")).select(KEY, "name", "lat", "lon")
    return geo.within_km(surgical, PLACES, 60.0).select(KEY, "place", F.round("km", 6).alias("km"))


@query
def hospitals_near_places(t):
    hospitals = t.located("specialties").where((F.col("facilityTypeId") == "hospital") & F.col("claims_surgery"))
    return geo.count_within_km(hospitals.select(KEY, "lat", "lon"), PLACES, 100.0)


@query
def emergency_cold_spots(t):
    offering = t.located("capability").where(F.col("offers_emergency")).select(KEY, "lat", "lon")
    return geo.cold_spots(offering, PLACES, 40.0)


@query
def nearest_emergency_provider(t):
    """For every facility without emergency care the nearest one that offers it, at any distance."""
    positions = stored(t.located("capability").select(KEY, "lat", "lon", "offers_emergency"), "positions")
    without = positions.where(~F.col("offers_emergency")).select(
        F.col(KEY).alias("place"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"))
    found = geo.nearest_points(positions.where("offers_emergency"), without)
    return found.select(F.col("place").alias("facility"), KEY, F.round("km", 6).alias("km"))


@query
def nearest_surgical_hospitals(t):
    hospitals = t.located("specialties").where((F.col("facilityTypeId") == "hospital") & F.col("claims_surgery"))
    return geo.nearest_points(hospitals, PLACES, 3).select("place", "rank", KEY, F.round("km", 6).alias("km"))


@query
def demand_against_supply(t):
    """Doctors per request that people can reach, by cells of a tenth of a degree."""
    demand = geo.located(t.people, "user_id").select("lat", "lon", F.col("requests").alias("demand"))
    supply = t.located().select(KEY, "lat", "lon", F.col("numberDoctors").alias("supply"))
    return catchment.catchment_access(catchment.demand_cells(demand), supply)


# ---------------------------------------------------------------- search

def asked(t):
    """The fixed question set as a table."""
    return search.question_table(t.spark, ASKED)


def logged(t):
    """The distinct questions of the log, each its own id."""
    return t.log.select(F.col("question").alias("question_id"), "question").distinct()


@query
def logged_question_keywords(t):
    return search.keyword_search(t.parts, logged(t), 3)


@query
def logged_question_search(t):
    return search.tfidf_search(t.parts, logged(t), 3)


@query
def logged_question_contexts(t):
    hits = stored(search.tfidf_search(t.parts, logged(t), 3), "hits")
    records = merge.merge_by_key(search.mentions_of(t.mentions, hits))
    return search.question_contexts(search.hit_rows(hits, records))


@query
def search_text(t):
    return search.search_chunks(t.mentions)


@query
def plain_search_text(t):
    return search.plain_search_chunks(t.mentions)


@query
def keyword_search(t):
    return search.keyword_search(t.parts, asked(t))


@query
def tfidf_search(t):
    return search.tfidf_search(t.parts, asked(t))


@query
def hashed_text_vectors(t):
    vectors = search.hashed_vectors(t.parts)
    return vectors.select(
        KEY, F.size("slots").cast("bigint").alias("entries"),
        F.array_join(F.transform("slots", lambda s: s.cast("string")), ",").alias("slots"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w), 6).alias("weight_sum"),
    )


@query
def search_hits_with_facilities(t):
    hits = stored(search.tfidf_search(t.parts, asked(t), 5), "hits")
    rows = search.hit_rows(hits, flags.enrich(search.mentions_of(t.mentions, hits)))
    return rows.select("question_id", "rank", "score", KEY, "name", REGION, "facilityTypeId", "num_specialties")


@query
def filtered_search(t):
    hospitals = t.singles.where(F.col("facilityTypeId") == "hospital").select(KEY)
    return search.tfidf_search(t.parts.join(hospitals, KEY, "left_semi"), asked(t), 5)


@query
def question_retrieval_contexts(t):
    hits = stored(search.tfidf_search(t.parts, asked(t), 5), "hits")
    records = merge.merge_by_key(search.mentions_of(t.mentions, hits))
    return search.question_contexts(search.hit_rows(hits, records))


@query
def vectors_nearest_cosine(t):
    vectors = t.table("embeddings")
    return search.nearest(vectors, search.centroids(vectors, "label"), 10)


@query
def vectors_nearest_l2(t):
    vectors = t.table("embeddings")
    return search.nearest(vectors, search.centroids(vectors, "label"), 10, "l2")


@query
def vectors_nearest_filtered(t):
    vectors = t.table("embeddings")
    return search.nearest(vectors.where(F.col("label") < 5), search.centroids(vectors, "label"), 10)


def every_fiftieth(vectors, key="vec_id", vector="embedding"):
    """The vectors of ids divisible by 50 as queries."""
    return vectors.where((F.col(key) % 50 == 0) & F.col(vector).isNotNull()).select(
        F.col(key).alias("query_id"), F.col(vector).alias("query"))


@query
def vectors_index_exact(t):
    vectors = t.table("embeddings")
    return vector_index.index_search(vector_index.build_index(vectors), every_fiftieth(vectors), exact=True)


@query
def vectors_index_recall(t):
    vectors = t.table("embeddings")
    index, asked = vector_index.build_index(vectors, metric="l2"), every_fiftieth(vectors)
    found = vector_index.recall(
        vector_index.index_search(index, asked), search.nearest(vectors, asked, metric="l2"))
    return found.select("queries", (F.col("recall") >= 0.9).alias("at_least_nine_tenths"))


@query
def dense_claim_similarity(t):
    # These claims have fewer than 384 words, so the projection keeps all inner products.
    claims = t.claims_of("specialties", "capability").select(KEY, F.col("item").alias("text"))
    vectors = stored(embedding.embed_facilities(claims)[0], "embeddings")
    found = search.nearest(vectors, every_fiftieth(vectors, KEY), key=KEY)
    return found.select("query_id", KEY, F.round("score", 6).alias("similarity"), "rank")


@query
def dense_text_search(t):
    # The index holds slots and weights, and projects what it reads: written vectors would be several times as large.
    rows, model = embedding.embed_facilities(t.parts, coded=True)
    asked_vectors = embedding.embedded(
        asked(t).select("question_id", F.col("question").alias("text")), model, "question_id")
    index = vector_index.build_index(rows, key=KEY, model=model)
    return vector_index.index_search(
        index, asked_vectors.select(F.col("question_id").alias("query_id"), F.col("embedding").alias("query")), exact=True)


@query
def facility_services(t):
    return search.services_of(t.singles, t.claims, "heart centre")


@query
def specialty_keyword_counts(t):
    return search.specialty_keyword_counts(t.claims_of("specialties"))


@query
def facility_phrases(t):
    return search.facility_phrases(t.singles)


@query
def region_phrase_counts(t):
    return search.phrase_counts(t.singles)


# ---------------------------------------------------------------- rules and validation

@query
def specialties_from_names(t):
    return rules.name_specialties(t.singles).withColumn("specialties", joined("specialties"))


@query
def specialties_from_text(t):
    return rules.text_specialties(t.singles).withColumn("specialties", joined("specialties"))


@query
def canonical_specialties(t):
    return rules.canonical_claims(t.claims_of("specialties"))


@query
def enum_violations(t):
    return rules.enum_violations(t.mentions)


@query
def phone_check(t):
    return rules.phone_check(t.mentions)


@query
def website_hosts(t):
    return rules.website_hosts(t.mentions)


@query
def page_hosts(t):
    return rules.page_hosts(t.table("pages"))


@query
def country_code_check(t):
    return rules.country_code_check(t.mentions)


@query
def cleaned_names(t):
    return rules.cleaned_names(t.singles)


@query
def organisation_hints(t):
    return rules.organisation_check(t.singles)


@query
def repeated_facts(t):
    return rules.repeated_facts(t.claims_of("procedure", "equipment", "capability"))


@query
def scrubbed_documents(t):
    return rules.scrub_documents(t.table("documents"))


# ---------------------------------------------------------------- questions

@query
def intent_keywords(t):
    return routing.with_intent(t.log.select("event_id", "question"))


@query
def intent_counts(t):
    return routing.intent_counts(t.log)


@query
def repaired_labels(t):
    return t.log.select("event_id", routing.repair_label(F.col("reply")).alias("label"))


@query
def sql_audit(t):
    return routing.sql_audit(t.log)


@query
def guarded_select(t):
    register_view(t.facilities, "facilities_enriched")
    return routing.guarded_select(
        t.spark,
        """```sql
        SELECT address_stateOrRegion, facilityTypeId, count(*) AS facilities, max(num_procedures) AS most_procedures
        FROM facilities_enriched WHERE capacity > :beds
        GROUP BY address_stateOrRegion, facilityTypeId
        ORDER BY facilities DESC, address_stateOrRegion NULLS FIRST, facilityTypeId NULLS FIRST;
        ```""",
        args={"beds": 50},
    )


@query
def question_facts(t):
    return routing.question_facts(t.log, t.singles).drop("question")


@query
def reasoning_contexts(t):
    rows = t.reasoning_mentions
    return routing.reasoning_contexts(flags.enrich(rows), merge.distinct_claims(rows, ["specialties"]))


@query
def question_reasoning(t):
    rows = t.reasoning_mentions
    facilities = stored(flags.enrich(rows).drop("description"), "facilities")
    return routing.question_reasoning(t.log, facilities, merge.distinct_claims(rows, ["specialties"]), facilities)


@query
def region_lines(t):
    return routing.region_lines(t.regions)


@query
def structured_context_blocks(t):
    return routing.context_texts(t.facilities, t.claims_of("specialties"))


@query
def question_structured_context(t):
    texts = routing.context_texts(t.facilities, t.claims_of("specialties"))
    return routing.question_structured_context(t.log, texts)


@query
def citations(t):
    return evaluation.citations(t.log, t.singles)


@query
def citation_lists(t):
    return evaluation.citation_lists(evaluation.citations(t.log, t.singles))


@query
def trace_rows(t):
    return evaluation.trace_rows(t.log)


@query
def trace_step_latency(t):
    return evaluation.step_latency(t.log)


@query
def evaluation_results(t):
    return evaluation.evaluated(t.log)


@query
def evaluation_summary(t):
    return evaluation.evaluation_summary(evaluation.evaluated(t.log))


@query
def evaluation_by_category(t):
    return evaluation.evaluation_by_category(evaluation.evaluated(t.log))


@query
def route_confusion(t):
    return evaluation.route_confusion(evaluation.evaluated(t.log))


# ---------------------------------------------------------------- changes and streams

@query
def snapshot_changes(t):
    return changes.snapshot_diff(t.snapshot(SNAPSHOT_CUT), t.snapshot())


@query
def incremental_index_sync(t):
    # Only facilities mentioned since the last snapshot can have another text.
    earlier = t.mentions.where(f"scraped_at < timestamp'{SNAPSHOT_CUT}'")
    touched = stored(t.mentions.where(f"scraped_at >= timestamp'{SNAPSHOT_CUT}'").select(KEY).distinct(), "touched")
    old, new = (search.search_chunks(m.join(touched, KEY, "left_semi")) for m in (earlier, t.mentions))
    return changes.sync_index(old, new)


@query
def upserted_users(t):
    events = t.table("events").select("user_id", "ts", "event_id", "event_type", "value")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    merged = changes.upsert(events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut),
                            "user_id", ["ts", "event_id"])
    return merged.select("user_id", "event_id", "event_type", "value")


@query
def stream_keyed_users(t):
    stream = jobs.read_event_stream(t.spark, t.folder).select("user_id", "ts", "event_id", "event_type", "value")
    table = jobs.keyed_table(stream, new_path(t.spark, "users"), "user_id", ["ts", "event_id"])
    return table.select("user_id", "event_id", "event_type", "value")


@query
def stream_activity_with_watermark(t):
    """Windows with what late rows, more than 60 days behind the newest of earlier batches, add to them."""
    stream = jobs.read_event_stream(t.spark, t.folder)
    windows = jobs.windowed(stream, new_path(t.spark, "late-activity"), jobs.ACTIVITY, delay="60 days")
    return windows.corrected().select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events",
        F.round("value_sum", 4).alias("value_sum"), "value_max",
    )


@query
def stream_agent_latency(t):
    """Times of the agents that answered the logged questions, per hour."""
    events = jobs.read_event_stream(t.spark, t.folder).withColumn("n_facilities", F.lit(1))
    steps = logged_questions(events).select("ts", F.get("steps", F.lit(1)).alias("s")).select(
        "ts", F.col("s.step").alias("agent"), F.col("s.ms").alias("ms"))
    windows = jobs.windowed(steps, new_path(t.spark, "latency"), jobs.LATENCY)
    return jobs.agent_latency(windows.corrected()).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def _registry_csv(t):
    """The registry as scraped files: CSV written by Spark and read back by header."""
    path = new_path(t.spark, "registry-csv")
    columns = [c for c in t.mentions.columns if c in REGISTRY_SCHEMA.names]
    t.mentions.select(columns).write.options(header=True, quote='"', escape='"', emptyValue='""', nullValue="").csv(path)
    return read_registry_csv(t.spark, path)


@query
def registry_from_csv(t):
    """Reads the CSV, replaces a table with it, appends a batch with a new column and reads both."""
    rows, path = _registry_csv(t), new_path(t.spark, "registry")
    write_table(with_safe_names(rows).withColumn(KEY, F.col(KEY).cast("bigint")), path)
    batch = t.mentions.where("scraped_at >= timestamp'1998-07-01'").select(KEY, SOURCE, "scraped_at")
    write_table(batch, path, "append")
    return read_evolving(t.spark, path).groupBy(KEY).agg(
        F.count("*").alias("row_count"), F.count("name").alias("named"), F.max("scraped_at").alias("last_scraped"))


@query
def list_sizes_and_texts(t):
    """Size of the raw specialty list of each mention, and of its cleaned form written back as JSON."""
    cleaned = json_items(F.col("specialties"))
    return t.mentions.select(KEY, SOURCE, item_count(F.col("specialties")).cast("bigint").alias("raw_items"),
                             to_json_list(cleaned).alias("cleaned"))


@query
def stream_hourly_activity(t):
    stream = jobs.read_event_stream(t.spark, t.folder)
    table = jobs.rolling_statistics(stream, new_path(t.spark, "activity"))
    return table.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events",
        F.round("value_sum", 4).alias("value_sum"), "value_max",
    )
