import itertools
import random
import time

from wardmap.operators import bundles

SCHEMA = "pk_unique_id long, item string, region string"


def brute(rows, share, by=False, least_items=2):
    groups = {}
    for key, item, region in rows:
        if item is not None:
            groups.setdefault(region if by else None, {}).setdefault(key, set()).add(item)
    out = set()
    for region, baskets in groups.items():
        at_least = -(-round(share * len(baskets), 9) // 1)
        items = sorted(set().union(*baskets.values()))
        for n in range(least_items, len(items) + 1):
            for some in itertools.combinations(items, n):
                having = [b for b in baskets.values() if b >= set(some)]
                if having and len(having) >= at_least and len(set.intersection(*having)) == n:
                    out.add((region, some, len(having)))
    return out


def rows_of(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for key in range(n):
        has = {i for i in "abcdefg" if rng.random() < 0.35} | ({"h", "i"} if rng.random() < 0.4 else set())
        rows += [(key, i, "north" if key % 3 else None) for i in has] + [(key, "a", "north" if key % 3 else None)] * (key % 2)
    return rows + [(999, None, "north")]


def found(df, by=False):
    return {(r.region if by else None, tuple(r["items"]), r.facilities) for r in df.collect()}


def test_closed_sets_equal_brute_force(spark):
    rows = rows_of(1)
    services = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for share in (0.05, 0.2, 0.9):
        assert found(bundles.closed_bundles(services, share)) == brute(rows, share)
    assert found(bundles.closed_bundles(services, 0.1, by="region"), True) == brute(rows, 0.1, True)


def test_many_shared_items_are_one_bundle(spark):
    rows = [(key, f"item {i:02d}", None) for key in range(100) for i in range(25)]
    start = time.time()
    got = bundles.closed_bundles(spark.createDataFrame(rows, SCHEMA), 0.5).collect()
    assert [(len(r["items"]), r.facilities) for r in got] == [(25, 100)] and time.time() - start < 60


def test_no_services(spark):
    assert bundles.closed_bundles(spark.createDataFrame([], SCHEMA), 0.5).collect() == []
