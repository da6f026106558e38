"""The derived tables of one data folder, built lazily from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import flags, geo, merge, regions, routing, search
from ..session import stored
from ..sources import mentions as derived
from ..sources.tables import KEY, SOURCE, bucketed_table, read_table

SNAPSHOT_CUT = "1998-07-01"


class Registry:
    """Plans for every derived table; nothing runs until a result is asked for.

    Each query takes the columns it needs from these plans and Catalyst prunes the rest,
    down to joins that only served unused columns.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def mentions(self) -> DataFrame:
        return derived.facility_mentions(self.spark, self.folder)

    @cached_property
    def stored_mentions(self) -> DataFrame:
        """The mentions bucketed by facility and sorted by URL, for queries that read them more than once."""
        return self._bucketed(self.mentions)

    @cached_property
    def reasoning_mentions(self) -> DataFrame:
        """``stored_mentions`` with only what the reasoning contexts need."""
        names = [KEY, SOURCE, *flags.SIGNAL_FIELDS, *routing.FACT_COLUMNS]
        return self._bucketed(self.mentions.select(*names))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return bucketed_table(rows, "mentions", KEY, [SOURCE], buckets)

    @cached_property
    def claims(self) -> DataFrame:
        return merge.distinct_claims(self.mentions, flags.SIGNAL_FIELDS)

    @cached_property
    def facilities(self) -> DataFrame:
        return flags.enrich(self.mentions)

    @cached_property
    def numbers(self) -> DataFrame:
        """Facilities with typed single values; no list is read."""
        return flags.typed_singles(self.mentions)

    def signalled(self, *fields: str) -> DataFrame:
        """Facilities with the counts and signals of the named lists only, without flags."""
        return flags.with_signals(self.mentions, list(fields))

    @cached_property
    def enriched_table(self) -> DataFrame:
        """Enriched facilities without their long texts, written once: for queries that
        read them more than once."""
        return stored(self.facilities.drop("description", "missionStatement", "mongo_DB"), "facilities")

    @cached_property
    def singles(self) -> DataFrame:
        return merge.merge_singles(self.mentions)

    @cached_property
    def regions(self) -> DataFrame:
        return regions.regional_analysis(self.facilities)

    @cached_property
    def weighted(self) -> DataFrame:
        return regions.weighted_regions(self.signalled("specialties", "procedure", "capability"))

    def located(self, *fields: str) -> DataFrame:
        return geo.located(self.signalled(*fields) if fields else self.numbers)

    @cached_property
    def parts(self) -> DataFrame:
        return search.text_parts(self.mentions)

    @cached_property
    def log(self) -> DataFrame:
        return derived.question_log(self.spark, self.folder)

    @cached_property
    def people(self) -> DataFrame:
        return derived.people(self.spark, self.folder)

    def claims_of(self, *fields: str) -> DataFrame:
        """Distinct claims of the named fields only; the other lists are not even parsed."""
        return merge.distinct_claims(self.mentions, list(fields))

    def snapshot(self, before: str | None = None) -> DataFrame:
        """Merged key fields as known from the mentions scraped before a date."""
        rows = self.mentions if before is None else self.mentions.where(f"scraped_at < timestamp'{before}'")
        fields = ["name", "facilityTypeId", "address_city", "address_stateOrRegion", "description", "email"]
        return merge.merge_singles(rows, fields=fields)

