"""Rule tables over names and texts, field validation and secret masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import json_items
from ..functions.values import blank_to_null
from ..sources.dimensions import (
    AFFILIATION_TYPES, BUSINESS_SUFFIXES, CONTEXT_RULES, FACILITY_TYPES, NAME_RULES, NGO_WORDS, OPERATOR_TYPES,
    SECRET_MASK, SECRET_PATTERNS, TERM_MAP,
)
from ..sources.tables import KEY
from .merge import url_host


def rule_specialties(text: Column, rules: list[tuple]) -> Column:
    """Sorted specialties whose rules match a text.

    Rules of the highest matching level win; a rule does not count when one for a
    specialty it is blocked by matches too (the specific name beats the generic one).
    """
    result = None
    for level in sorted({r[2] for r in rules}):
        peers = [r for r in rules if r[2] == level]
        names = []
        for pattern, name, _, blocked in peers:
            hit = text.rlike(pattern)
            for blocker in (r[0] for r in peers if r[1] in blocked):
                hit = hit & ~text.rlike(blocker)
            names.append(F.when(hit, F.lit(name)))
        found = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
        result = found if result is None else F.when(F.size(found) > 0, found).otherwise(result)
    return result


def name_specialties(f: DataFrame) -> DataFrame:
    return f.select(KEY, "name", rule_specialties(F.col("name"), NAME_RULES).alias("specialties"))


def text_specialties(f: DataFrame) -> DataFrame:
    found = rule_specialties(F.col("description"), CONTEXT_RULES)
    return f.where(F.col("description").isNotNull()).select(KEY, found.alias("specialties"))


def canonical_term(term: Column, terms: dict[str, str] | None = None) -> Column:
    """Canonical specialty of a term; unmapped terms stay as they are."""
    terms = terms or TERM_MAP
    known = F.map_from_arrays(F.array(*[F.lit(k.lower()) for k in terms]), F.array(*[F.lit(v) for v in terms.values()]))
    return F.coalesce(F.try_element_at(known, F.lower(term)), term)


def canonical_claims(claims: DataFrame, field: str = "specialties") -> DataFrame:
    """Distinct claims of a field after terminology mapping."""
    return claims.where(F.col("field") == field).select(KEY, canonical_term(F.col("item")).alias("specialty")).distinct()


def enum_violations(mentions: DataFrame) -> DataFrame:
    """Per enumerated column the values outside its list, with their row counts."""
    single = lambda c, ok: F.filter(
        F.array(blank_to_null(F.col(c))), lambda x: x.isNotNull() & ~x.isin(*ok))
    bad = {
        "facilityTypeId": single("facilityTypeId", FACILITY_TYPES),
        "operatorTypeId": single("operatorTypeId", OPERATOR_TYPES),
        "affiliationTypeIds": F.array_except(json_items(F.col("affiliationTypeIds")),
                                             F.array(*[F.lit(a) for a in AFFILIATION_TYPES])),
    }
    tagged = lambda c, values: F.transform(
        values, lambda x: F.struct(F.lit(c).alias("column_name"), x.alias("value")))
    cells = F.concat(*[tagged(c, values) for c, values in bad.items()])
    return mentions.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count("*").alias("rows"))


E164 = r"^\+[1-9][0-9]{1,14}$"


def phone_check(mentions: DataFrame) -> DataFrame:
    """Distinct official and listed phone numbers, valid in E.164 form or not."""
    numbers = F.concat(
        F.filter(F.array(blank_to_null(F.col("officialPhone"))), F.isnotnull), json_items(F.col("phone_numbers"))
    )
    pairs = mentions.select(KEY, F.explode(F.array_distinct(numbers)).alias("phone")).distinct()
    return pairs.withColumn("valid", F.col("phone").rlike(E164))


def website_hosts(mentions: DataFrame) -> DataFrame:
    """Distinct hosts of the official and the listed websites of each facility."""
    urls = F.concat(
        F.filter(F.array(blank_to_null(F.col("officialWebsite"))), F.isnotnull), json_items(F.col("websites"))
    )
    return mentions.select(KEY, F.explode(F.transform(urls, url_host)).alias("host")).distinct()


def page_hosts(pages: DataFrame) -> DataFrame:
    """Pages per host."""
    return pages.groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def country_code_check(mentions: DataFrame) -> DataFrame:
    """Rows per state of the country code: ok, malformed, or missing although required."""
    code, country = blank_to_null(F.col("address_countryCode")), blank_to_null(F.col("address_country"))
    state = (
        F.when(code.rlike("^[A-Z]{2}$"), "ok").when(code.isNotNull(), "malformed")
        .when(country.isNotNull(), "required").otherwise("unknown country")
    )
    return mentions.groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


def clean_name(name: Column) -> Column:
    """Name without business suffixes, single blanks, capitals only at word starts.

    Words in mixed case keep their spelling; a name all in capitals is title-cased.
    """
    suffix = r"(?i)[,\s]+(" + "|".join(BUSINESS_SUFFIXES) + r")\b\.?"
    text = F.btrim(F.regexp_replace(F.regexp_replace(name, suffix, ""), r"\s+", " "))
    return F.when(text == F.upper(text), F.initcap(text)).otherwise(text)


def cleaned_names(f: DataFrame) -> DataFrame:
    return f.select(KEY, "name", clean_name(F.col("name")).alias("clean_name"))


def organisation_hint(text: Column) -> Column:
    """``ngo`` where a word of the NGO list occurs, else ``facility``."""
    return F.when(text.rlike(r"(?i)\b(" + "|".join(NGO_WORDS) + r")\b"), "ngo").otherwise("facility")


def organisation_check(f: DataFrame) -> DataFrame:
    """Facilities by stated organisation type and by the hint in their name."""
    return f.groupBy("organization_type", organisation_hint(F.col("name")).alias("hint")).agg(
        F.count("*").alias("facilities")
    )


def repeated_facts(claims: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Facts a facility states in more than one of the text categories, ignoring case."""
    fields = fields or ["procedure", "equipment", "capability"]
    return (
        claims.where(F.col("field").isin(*fields))
        .groupBy(KEY, F.lower("item").alias("fact")).agg(F.countDistinct("field").alias("categories"))
        .where(F.col("categories") > 1)
    )


def mask_secrets(text: Column, patterns: dict[str, str] | None = None, mask: str = SECRET_MASK) -> Column:
    for pattern in (patterns or SECRET_PATTERNS).values():
        text = F.regexp_replace(text, pattern, mask)
    return text


def scrub_documents(documents: DataFrame, key: str = "doc_id", text: str = "text",
                    patterns: dict[str, str] | None = None) -> DataFrame:
    """Masked text of every document with the hits per pattern."""
    patterns = patterns or SECRET_PATTERNS
    return documents.select(
        key,
        *[F.regexp_count(F.col(text), F.lit(p)).cast("bigint").alias(f"{name}_hits") for name, p in patterns.items()],
        mask_secrets(F.col(text), patterns).alias("masked_text"),
    )
