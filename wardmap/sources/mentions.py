"""Facility mentions and a question log derived from the order and event tables.

The registry itself is not public, so the same shape is derived from the given tables:
one mention per order, one facility per customer, one asked question per event. The
columns carry every defect the operators must handle (null words, bad JSON, numbers as
text, missing regions, repeated mentions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import QUESTIONS, REGION_COORDS
from .tables import read_table

NAME_SUFFIXES = [
    "General Hospital", "Family Clinic", "Dental Surgery", "Eye Hospital", "Emergency Centre",
    "Diagnostic Lab", "Heart Centre", "Women's Health Centre", "Children Hospital", "Heart Surgery Institute",
    "Cleft Care", "Trauma Unit", "Tropical Disease Institute", "Maternity Home", "SURGICAL HOME LTD",
    "Orthopaedic Clinic Inc", "Kidney Centre", "Rehabilitation House", "Hospice", "Imaging LLC",
    "ENT House", "Cancer Center", "Health Foundation", "Orthodontic Dental Clinic", "Medical Centre",
]
DESCRIPTION_ENDINGS = [
    " with a visiting surgeon twice a year",
    ". We refer patients to the regional hospital",
    ". Dr. Mensah leads the team",
    ". Uses a legacy film unit",
    ". Permanent staff, full-time emergency cover",
    "",
    " offering tropical medicine",
]
OTHER_REGIONS = ["Kumasi Metropolitan", "Bolgatanga Municipal", "Ga East", "Ho", "Unlisted District", "Wa West"]
REGION_TEXTS = [name for name, _, _ in REGION_COORDS] + OTHER_REGIONS


# Equipment that claimed procedures need, in the words of this data.
DERIVED_EQUIPMENT_RULES = [
    ("surgery", r"(?i)surgery", r"(?i)^Brand#1"),
    ("ring work", r"(?i)\bring\b", r"(?i)^Brand#2"),
    ("gear work", r"(?i)\bgear\b", r"(?i)^Brand#(3|4|5)$"),
]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _json_or_null(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.to_json(F.array_sort(items)))


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Per order the distinct part types, part names and brands that become claims.

    Every line gives one claim, of the kind that its return flag names. Each set is bounded by the vocabulary of its column, however many lines an order has.
    """
    line = read_table(spark, folder, "lineitem")
    part = read_table(spark, folder, "part")
    flag = F.col("l_returnflag")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .groupBy("l_orderkey")
        .agg(
            F.collect_set(F.when(flag == "N", F.col("p_type"))).alias("types"),
            F.collect_set(
                F.when(flag == "A", F.struct("p_name", (F.col("p_type") == "PROMO").alias("promo")))
            ).alias("parts"),
            F.collect_set(F.when(flag == "R", F.col("p_brand"))).alias("brands"),
        )
    )


def facility_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Raw mentions, every descriptive column as text; grain: one row per order."""
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer")
    # 25 rows at every scale.
    nation = F.broadcast(read_table(spark, folder, "nation"))
    lines = _order_lines(spark, folder)

    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    )
    cust, order, nat = F.col("o_custkey"), F.col("o_orderkey"), F.col("n_nationkey")
    cust_text, order_text = cust.cast("string"), order.cast("string")
    # Of the last nations, one customer in ten names the nation's own region, so that some regions are nearly
    # empty; the others name the first regions.
    moved = (nat >= 18) & (cust % 10 != 0)
    # Only these facilities say anything about procedures and equipment.
    talks = cust % 24 != 0

    specialty = lambda t: (
        F.when(t == "STANDARD", "internalMedicine")
        .when(t == "SMALL", "pediatrics")
        .when(t == "MEDIUM", "gynecologyAndObstetrics")
        .when(t == "ECONOMY", "cardiology")
        .when(t == "PROMO", F.when(nat % 5 == 0, "dermatology").otherwise("generalSurgery"))
        .otherwise(F.when(nat % 3 == 0, "familyMedicine").otherwise("emergencyMedicine"))
    )
    procedure = lambda p: F.concat(
        F.lit("Performs "), p["p_name"], F.when(p["promo"] & (nat % 5 != 0), " surgery").otherwise("")
    )
    name = F.concat(F.col("c_name"), F.lit(" "), _pick(NAME_SUFFIXES, cust % len(NAME_SUFFIXES)))
    city = F.concat(F.lit("City "), (cust % 40).cast("string"))
    host = F.concat(F.lit("src"), (order % 3).cast("string"), F.lit(".example.com"))
    priority = F.col("o_orderpriority")
    return base.select(
        cust.alias("pk_unique_id"),
        F.concat(F.lit("https://"), host, F.lit("/"), order_text).alias("source_url"),
        F.col("o_orderdate").alias("scraped_at"),
        name.alias("name"),
        F.when(cust % 17 == 0, "ngo").otherwise("facility").alias("organization_type"),
        F.when(order % 3 != 0, F.concat(F.lit("info"), cust_text, F.lit("@"), host)).alias("email"),
        F.when(cust % 3 != 0, F.concat(F.lit("https://www.site"), (cust % 50).cast("string"),
                                       F.lit(".example.org/home?id="), order_text)).alias("officialWebsite"),
        F.when(cust % 10 == 0, F.concat(F.lit("0"), (cust % 1000).cast("string")))
        .otherwise(F.concat(F.lit("+233"), F.lpad(cust_text, 9, "3"))).alias("officialPhone"),
        F.when(cust % 7 == 0, "null").otherwise((1950 + cust % 70).cast("string")).alias("yearEstablished"),
        F.when(cust % 4 == 0, "true").when(cust % 4 == 1, "false").alias("acceptsVolunteers"),
        F.when(cust % 5 == 0, F.concat(F.lit("https://facebook.com/f"), cust_text)).alias("facebookLink"),
        F.when(moved, _pick(REGION_TEXTS, nat % 18)).when(nat == 23, None).when(nat == 24, "null")
        .otherwise(_pick(REGION_TEXTS, nat))
        .alias("address_stateOrRegion"),
        city.alias("address_city"),
        F.lit("Ghana").alias("address_country"),
        F.when(cust % 11 == 0, F.when(cust % 2 == 0, "Ghana")).otherwise("GH").alias("address_countryCode"),
        F.when(F.col("c_mktsegment") == "BUILDING", "hospital")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "clinic")
        .when(F.col("c_mktsegment") == "FURNITURE", "dentist")
        .when(F.col("c_mktsegment") == "MACHINERY", "pharmacy")
        .otherwise("null").alias("facilityTypeId"),
        F.when(cust % 3 == 0, "public").when(cust % 3 == 1, "private").otherwise("null").alias("operatorTypeId"),
        F.when(cust % 6 != 0, F.concat(name, F.lit(" in "), city,
                                       _pick(DESCRIPTION_ENDINGS, order % len(DESCRIPTION_ENDINGS))))
        .alias("description"),
        F.when(cust % 4 == 0, "null")
        .when(cust % 4 != 1, F.concat((cust % 9).cast("string"), F.when(cust % 13 == 0, ".0").otherwise("")))
        .alias("numberDoctors"),
        F.when(cust % 5 == 0, "null").otherwise((cust % 120).cast("string")).alias("capacity"),
        F.when(cust % 17 == 0, F.concat(F.lit("Care for all in "), city)).alias("missionStatement"),
        F.md5(cust_text).alias("mongo DB"),
        _json_or_null(F.array_distinct(F.transform("types", specialty))).alias("specialties"),
        F.when(talks, _json_or_null(F.array_distinct(F.transform("parts", procedure)))).alias("procedure"),
        F.when(talks, _json_or_null(F.col("brands"))).alias("equipment"),
        F.when(cust % 12 == 0, None)
        .when(priority == "1-URGENT",
              F.when(nat % 3 == 0, '["Outpatient clinic"]').otherwise('["24-hour emergency care"]'))
        .when(priority == "2-HIGH", '["Inpatient ward"," Pharmacy ","brand#7"]')
        .when(priority == "3-MEDIUM", '[""]')
        .when(priority == "4-NOT SPECIFIED", "[]")
        .otherwise("Outpatient only").alias("capability"),
        F.concat(F.lit('["+233'), F.lpad(cust_text, 9, "3"), F.lit('","0'), (order % 5).cast("string"), F.lit('"]'))
        .alias("phone_numbers"),
        F.concat(F.lit('["http://www.site'), (cust % 50).cast("string"), F.lit('.example.org/","m'),
                 (order % 4).cast("string"), F.lit('.example.net/x"]')).alias("websites"),
        F.when(cust % 19 == 0, '["community","unknown-level"]').when(cust % 5 == 0, '["academic"]')
        .alias("affiliationTypeIds"),
    )


REPLY_LABELS = ["STRUCTURED", " semantic ", "Category: REASONING", "DESERT.", "no idea", "sql", "It is SEMANTIC"]
SQL_TEXTS = [
    "SELECT name FROM facilities WHERE capacity > 50",
    "SELECT last_updated, created_by FROM facilities",
    "drop table facilities",
    "SELECT 1; DELETE FROM facilities",
    "```sql\nSELECT name FROM facilities;\n```",
    "UPDATE facilities SET capacity = 0",
]


def people(spark: SparkSession, folder: str) -> DataFrame:
    """A side table of demand: one row per user of the events, with a region text and the number of requests."""
    user = F.col("user_id")
    return read_table(spark, folder, "events").where(user.isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("requests")).withColumn(
            "address_stateOrRegion", _pick(REGION_TEXTS, F.pmod(user, F.lit(len(REGION_TEXTS)))))


def question_log(spark: SparkSession, folder: str) -> DataFrame:
    """One asked question per event with its expected route, reply, timing and sources."""
    count = read_table(spark, folder, "customer").agg(F.count("*").alias("n")).scalar()
    return logged_questions(read_table(spark, folder, "events").withColumn("n_facilities", count))


def logged_questions(events: DataFrame) -> DataFrame:
    """The questions of events, a table or a stream, with the number of facilities in ``n_facilities``."""
    event, facilities = F.col("event_id"), F.col("n_facilities")
    pick = event % len(QUESTIONS)
    route = _pick([q[3] for q in QUESTIONS], pick)
    total_ms = F.floor(F.col("value") * 10).cast("bigint")
    classify_ms = F.floor(total_ms / 5).cast("bigint")
    answer = F.concat(F.col("event_type"), F.lit(": "), F.col("props"))
    return events.select(
        event.alias("event_id"),
        "ts",
        "user_id",
        _pick([q[0] for q in QUESTIONS], pick).alias("question_id"),
        F.concat(_pick([q[1] for q in QUESTIONS], pick), F.lit(" Region: "), _pick(REGION_TEXTS, event % 23))
        .alias("question"),
        _pick([q[2] for q in QUESTIONS], pick).alias("question_category"),
        route.alias("expected_route"),
        _pick(REPLY_LABELS, event % len(REPLY_LABELS)).alias("reply"),
        _pick(SQL_TEXTS, event % len(SQL_TEXTS)).alias("sql_text"),
        answer.alias("answer"),
        total_ms.alias("total_ms"),
        F.transform(
            F.when(event % 13 > 0, F.sequence(F.lit(1).cast("bigint"), event % 13))
            .otherwise(F.array().cast("array<bigint>")),
            lambda i: ((event * 7 + i * 31) % facilities).cast("string"),
        ).alias("source_ids"),
        F.array(
            F.struct(F.lit("classify").alias("step"), route.alias("output"), classify_ms.alias("ms")),
            F.struct(
                F.when(route == "STRUCTURED", "sql").when(route == "SEMANTIC", "rag")
                .when(route == "REASONING", "reasoning").otherwise("desert").alias("step"),
                F.concat((event % 13).cast("string"), F.lit(" sources")).alias("output"),
                (total_ms - classify_ms).alias("ms"),
            ),
        ).alias("steps"),
    )
