import random

import pytest
from pyspark.sql import functions as F

from wardmap.session import drop_work
from wardmap.sources import tables
from wardmap.operators import changes, flags, merge, search

SCHEMA = "pk_unique_id string, source_url string, name string, facilityTypeId string, `mongo DB` string, specialties string, procedure string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def mentions(spark):
    return spark.createDataFrame([
        ("a", "http://1.org/x", "null", None, "m1", '["x ","y"]', "null"),
        ("a", "http://2.org/x", "Alpha", "hospital", "m2", '["y","z"]', "operates"),
        ("a", "http://3.org/x", "Beta", "clinic", None, "[]", '"operates"'),
        ("b", None, "Gamma", "null", None, None, '[""]'),
    ], SCHEMA)


def test_single_values_take_first_known_by_url(mentions):
    got = {r["pk_unique_id"]: r for r in merge.merge_singles(mentions).collect()}
    assert (got["a"]["name"], got["a"]["facilityTypeId"], got["a"]["mongo_DB"], got["a"]["source_count"]) == (
        "Alpha", "hospital", "m1", 3)
    # A value without a source URL still counts.
    assert (got["b"]["name"], got["b"]["facilityTypeId"]) == ("Gamma", None)


def test_lists_are_united(mentions):
    got = {r["pk_unique_id"]: r for r in merge.merge_by_key(mentions).collect()}
    assert got["a"]["specialties"] == ["x", "y", "z"] and got["a"]["procedure"] == ["operates"]
    assert got["b"]["specialties"] == [] and got["b"]["list_pages"] == 1


def test_merge_ignores_row_order_and_is_idempotent(spark, mentions):
    rows = mentions.collect()
    expected = rows_of(merge.merge_by_key(mentions))
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert rows_of(merge.merge_by_key(spark.createDataFrame(rows, SCHEMA))) == expected
    assert rows_of(merge.merge_by_key(mentions.union(mentions)).drop("source_count")) == rows_of(
        merge.merge_by_key(mentions).drop("source_count"))


def test_one_row_per_key(mentions):
    assert merge.duplicate_keys(merge.merge_by_key(mentions)).count() == 0
    assert merge.duplicate_statistics(mentions).first().asDict() == {
        "total_rows": 4, "unique_keys": 2, "most_mentions": 3, "duplicate_rows": 2}


@pytest.fixture(scope="module")
def hot(spark):
    """One facility holds a third of all mentions, each with its own source and items."""
    n = 3000
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 200).cast("string")))
        .alias("pk_unique_id"),
        F.format_string("https://s%d.org/%05d", F.col("id") % 7, F.col("id")).alias("source_url"),
        F.lit("n").alias("name"), F.lit("hospital").alias("facilityTypeId"), F.lit("m").alias("mongo DB"),
        F.format_string('["p%04d","all"]', F.col("id")).alias("specialties"),
        F.lit('["op"]').alias("procedure"),
    )


def test_long_lists_come_in_pages_and_stay_whole(hot):
    pages = merge.paged_lists(merge.distinct_claims(hot), page_size=100)
    big = pages.where("pk_unique_id = 'hot' AND field = 'specialties'").collect()
    assert {r["n_pages"] for r in big} == {11} and len(big) == 11
    items = [i for r in big for i in r["items"]]
    assert sorted(items) == sorted([f"p{i:04d}" for i in range(0, 3000, 3)] + ["all"])
    assert max(len(r["items"]) for r in big) < 200
    assert all(r["items"] == sorted(r["items"]) for r in big)
    small = pages.where("pk_unique_id <> 'hot' OR field = 'procedure'")
    assert small.where("n_pages <> 1 OR page <> 0").count() == 0


def test_records_hold_all_items_of_long_lists(hot):
    records = merge.merge_by_key(hot, page_size=100).where("pk_unique_id = 'hot'").collect()
    assert {r["list_pages"] for r in records} >= {11} and {r["source_count"] for r in records} == {1000}
    assert sorted(r["list_page"] for r in records) == list(range(11))
    assert sorted(i for r in records for i in r["specialties"]) == sorted([f"p{i:04d}" for i in range(0, 3000, 3)] + ["all"])
    # Lists without an item stay empty beside a long one, and a short list stands on one page only.
    assert sum(r["procedure"] == [] for r in records) == 10
    assert [i for r in records for i in r["procedure"]] == ["op"]


def test_anomaly_and_context_rows_hold_all_items_of_long_lists(spark, hot):
    named = spark.createDataFrame([("hot", "n")], "pk_unique_id string, name string")
    rows = flags.with_specialty_list(named, hot, page_size=100).collect()
    assert sum(len(r["specialties"]) for r in rows) == 1001 and len(rows) == 11
    records = merge.merge_by_key(hot, page_size=100)
    singles = ["address_city", "address_stateOrRegion", "operatorTypeId", "numberDoctors", "capacity", "description"]
    lists = ["equipment", "capability"]
    records = records.withColumns({
        **{c: F.lit(None).cast("string") for c in singles if c not in records.columns},
        **{c: F.array().cast("array<string>") for c in lists if c not in records.columns}})
    hits = spark.createDataFrame([("q", 1, "hot")], "question_id string, rank int, pk_unique_id string")
    found = search.question_contexts(search.hit_rows(hits, records)).first()
    assert found["hits"] == 1 and all(f"p{i:04d}" in found["context"] for i in range(0, 3000, 3))


def test_source_urls_stay_whole(hot):
    pages = merge.source_url_lists(hot, page_size=64).collect()
    urls = [u for r in pages for u in r["source_urls"]]
    assert len(urls) == len(set(urls)) == 3000


def test_raw_text_merge(mentions):
    got = {(r[0], r[1]): r["merged_text"] for r in merge.merge_raw_text(mentions, ["specialties", "procedure"]).collect()}
    assert got[("a", "specialties")] == '["x ","y"] | ["y","z"] | []'


def test_corroboration_counts_hosts_not_urls(spark):
    rows = [("a", "https://www.h.org/1", '["x"]'), ("a", "http://h.org/2", '["x"]'), ("b", "h.org/3", '["x"]'),
            ("b", "http://g.org/3", '["x"]')]
    df = spark.createDataFrame(rows, "pk_unique_id string, source_url string, procedure string")
    assert rows_of(merge.corroborated_claims(df, ["procedure"])) == [("procedure", "x", 2, 1)]


def test_signals_on_a_hot_facility(hot):
    signals = flags.claim_signals(merge.distinct_claims(hot)).where("pk_unique_id = 'hot'").first()
    assert signals["num_specialties"] == 1001 and signals["num_procedures"] == 1


def test_snapshot_diff_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "pk_unique_id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "pk_unique_id int, v string")
    assert rows_of(changes.snapshot_diff(old, new)) == [(2, "update"), (4, "insert")]
    assert rows_of(changes.snapshot_diff(new, old)) == [(2, "update"), (4, "delete")]
    current = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, ver int, v string")
    change = spark.createDataFrame([(2, 3, "d"), (2, 2, "c"), (1, 0, "old")], "k int, ver int, v string")
    assert rows_of(changes.upsert(current, change, "k", ["ver"])) == [(1, 1, "a"), (2, 3, "d")]
    schema = "pk_unique_id int, page long, search_text string"
    before = spark.createDataFrame([(1, 0, "one"), (2, 0, "two"), (2, 1, "more"), (9, 0, "gone")], schema)
    after = spark.createDataFrame([(1, 0, "one"), (2, 0, "new"), (4, 0, "four")], schema)
    assert rows_of(changes.sync_index(before, after)) == [
        (2, 0, "update", "new"), (2, 1, "delete", None), (4, 0, "insert", "four"), (9, 0, "delete", None)]


def test_a_value_that_changes_columns_is_a_change(spark):
    schema = "pk_unique_id int, a string, b string"
    old, new = (spark.createDataFrame([(1, *v), (2, None, None)], schema) for v in ((None, "x"), ("x", None)))
    assert rows_of(changes.snapshot_diff(old, new)) == [(1, "update")]


def test_bucketed_mentions_need_no_exchange_or_sort_before_the_first_aggregate(spark):
    rows = [(i % 7 if i % 3 else 7, f"u{(i * 37) % 1000:04d}" if i % 50 else None, f"n{i}" if i % 4 else "null",
             "x" if i > 900 else None, f'["a{i % 5}", "b"]') for i in range(1000)]
    mentions = spark.createDataFrame(
        rows, "pk_unique_id long, source_url string, name string, email string, specialties string")
    table = tables.bucketed_table(mentions, "mentions", "pk_unique_id", ["source_url"], 4)
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    plain = mentions.where("source_url is not null")
    kept = table.where("source_url is not null")
    assert as_rows(merge.merge_singles(kept)) == as_rows(merge.merge_singles(plain))
    assert as_rows(merge.distinct_claims(table)) == as_rows(merge.distinct_claims(mentions))
    for df in (merge.merge_singles(table).select("pk_unique_id", "source_count"), merge.distinct_claims(table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan and "Sort" not in plan
    by_field = merge.merge_singles(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in by_field
    drop_work(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("work_mentions")]


def test_lists_are_parsed_once_and_not_moved_for_their_page_counts(hot, spark):
    table = tables.bucketed_table(hot, "mentions", "pk_unique_id", ["source_url"], 4)
    plan = merge.paged_lists(merge.distinct_claims(table))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows_of(merge.merge_by_key(table, page_size=100)) == rows_of(merge.merge_by_key(hot, page_size=100))
    drop_work(spark)


def test_values_are_trimmed_in_the_rows_that_give_them_only(spark):
    rows = [("a", "u1", " null "), ("a", "u2", "\tBeta \n"), ("a", "u3", "Alpha"), ("b", "u1", None), ("b", "u2", " NaN")]
    mentions = spark.createDataFrame(rows, "pk_unique_id string, source_url string, name string")
    table = tables.bucketed_table(mentions, "mentions", "pk_unique_id", ["source_url"], 2)
    merged = merge.merge_singles(table)
    assert rows_of(merged) == rows_of(merge.merge_singles(mentions)) == [("a", "Beta", 3), ("b", None, 2)]
    # The trim stands above the join that leaves a few rows of a key.
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(" not in plan[plan.index("Join Inner"):]
    drop_work(spark)
