import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardmap import session
from wardmap.operators import embedding, search, vector_index
from wardmap.plans.catalogue import ASKED, QUERIES, every_fiftieth
from wardmap.plans.tables import Registry
from wardmap.sources.tables import KEY

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA)


def clustered(seed, n=1200, dim=16):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(30, dim))[rng.integers(0, 30, n)] + rng.normal(size=(n, dim)) * 0.5


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "vec_id", "score", "rank").collect())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_reaches_nine_tenths_and_is_exact_on_demand(spark, metric):
    m = clustered(1)
    vectors = table(spark, m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" else m)
    index = vector_index.build_index(vectors, metric=metric, cells=40)
    asked = every_fiftieth(vectors)
    exact = search.nearest(vectors, asked, metric=metric)
    assert index.probes < 30
    share = vector_index.recall(vector_index.index_search(index, asked), exact).first()
    assert share.queries == 24 and share.recall >= 0.9
    # One probed cell is not enough; the bound finds the rest.
    one = vector_index.index_search(index, asked, probes=1)
    assert vector_index.recall(one, exact).first().recall < 1
    assert [r[:2] for r in rows(vector_index.index_search(index, asked, probes=1, exact=True))] == [r[:2] for r in rows(exact)]


def test_index_is_kept_and_grows(spark, tmp_path):
    m = clustered(2, 300)
    index = vector_index.build_index(table(spark, m[:200]), str(tmp_path / "index"), "l2", cells=8)
    index = vector_index.add_to_index(index, table(spark, m[200:], 200))
    again = vector_index.open_index(spark, str(tmp_path / "index"), metric="l2")
    assert np.allclose(again.centroids, index.centroids) and again.probes == index.probes
    vectors = table(spark, m)
    asked = every_fiftieth(vectors)
    assert rows(vector_index.index_search(index, asked, exact=True)) == rows(search.nearest(vectors, asked, metric="l2"))


def test_index_of_nothing_and_of_equal_rows(spark):
    empty = vector_index.build_index(table(spark, []))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    assert vector_index.index_search(empty, asked).collect() == []
    same = vector_index.build_index(table(spark, [[1.0, 0.0]] * 30))
    assert [r[1] for r in rows(vector_index.index_search(same, asked, 3, exact=True))] == [0, 1, 2]


def test_nearest_reads_many_queries_in_blocks(spark):
    m = np.round(np.random.default_rng(4).normal(size=(2500, 4)), 1)
    vectors = table(spark, m).repartition(3)
    asked = table(spark, m).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    expected = []
    for q in range(len(m)):
        scores = np.round(-np.sqrt(((m - m[q]) ** 2).sum(1)), 9)
        best = np.lexsort((np.arange(len(m)), -scores))[:3]
        expected += [(q, int(v), r + 1) for r, v in enumerate(best)]
    for size in (32 << 20, 40_000):
        found = search.nearest(vectors, asked, 3, "l2", query_bytes=size)
        assert sorted(tuple(r) for r in found.select("query_id", "vec_id", "rank").collect()) == sorted(expected)
    none = asked.limit(0)
    assert search.nearest(vectors, none).collect() == []


def texts(seed, n):
    rng = random.Random(seed)
    words = ["ärzte", "жена", "病院", "clinic", "heart", "surgery", "dental", "x-ray", "नमस्ते", "eye", "ward", "lab"]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(n)]


def test_projection_keeps_inner_products_where_it_can(spark):
    parts = spark.createDataFrame([*texts(1, 120), (900, "--"), (901, None)], "id long, text string")
    vectors, model = embedding.embed_facilities(parts, "id", slots=1024)
    model_rows = {r.id: np.array(r.embedding) for r in vectors.collect()}
    assert set(model_rows) == set(range(120)) and all(len(v) == 384 for v in model_rows.values())
    _, sparse = embedding.fit_text_model(parts, slots=1024, key="id")
    dense = {}
    for r in sparse.collect():
        dense[r.id] = np.zeros(1024)
        dense[r.id][r.slots] = r.weights
    for i in range(0, 120, 7):
        assert abs(np.linalg.norm(model_rows[i]) - 1) < 1e-9
        for j in range(120):
            assert abs(model_rows[i] @ model_rows[j] - dense[i] @ dense[j]) < 1e-9
    question = spark.createDataFrame([("q", "Ärzte 病院")], "question_id string, text string")
    asked = np.array(embedding.embedded(question, model, "question_id").first().embedding)
    best = max(model_rows, key=lambda i: asked @ model_rows[i])
    assert {"ärzte", "病院"} & set(dict(texts(1, 120))[best].split())


def test_projection_finds_the_leading_directions(spark):
    parts = spark.createDataFrame(texts(2, 200), "id long, text string")
    model, sparse = embedding.fit_text_model(parts, size=5, slots=256, key="id")
    m = np.zeros((200, 256))
    for r in sparse.collect():
        m[r.id, r.slots] = r.weights
    singular = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(np.linalg.norm(m @ model.basis, axis=0), singular[:5], rtol=1e-6)


def test_vectors_are_made_unit_length_once_before_cells_are_fitted(spark, monkeypatch):
    m = clustered(5, 60)
    seen = []
    fit = vector_index.KMeans.fit

    def watched(self, points):
        seen.append((points._jdf.queryExecution().optimizedPlan().toString(), [r.point.toArray() for r in points.collect()]))
        return fit(self, points)

    monkeypatch.setattr(vector_index.KMeans, "fit", watched)
    vector_index.build_index(table(spark, [*m, [0.0] * 16]), cells=4)
    plan, points = seen[0]
    # A norm inside of the function of an element would be taken again for every element.
    assert "lambda" not in plan
    assert sorted(round(float(np.linalg.norm(p)), 9) for p in points) == [0.0] + [1.0] * 60


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_are_multiplied_with_blocks_of_queries(spark, metric):
    m = np.round(clustered(6, 900, 4), 1)
    vectors = table(spark, m)
    asked = vector_index.stored(every_fiftieth(vectors).withColumn("query", F.col("query").cast("array<double>")), "queries")
    index = vector_index.build_index(vectors, metric=metric, cells=12)
    parts = [vector_index.scored(index, asked, 3, 12, size) for size in (32 << 20, 700)]
    best = [rows(search.top_k(p, "query_id", 3, key="vec_id")) for p in parts]
    assert best[0] == best[1] and len(best[0]) == 18 * 3
    # No pairs of a query and a vector are made: each task keeps the best of each query.
    assert parts[0].count() <= 18 * 3 * parts[0].rdd.getNumPartitions()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_of_coded_vectors_is_that_of_the_vectors(spark, tmp_path, metric):
    parts = spark.createDataFrame([*texts(3, 700), (900, "--"), (901, None)], "id long, text string")
    rows_coded, model = embedding.embed_facilities(parts, "id", coded=True, slots=512)
    vectors = embedding.projected(rows_coded, model, "id")
    path = str(tmp_path / "index")
    index = vector_index.build_index(rows_coded, path, metric, cells=9, key="id", model=model)
    asked = spark.createDataFrame([("a", "eye clinic"), ("b", "жена 病院 heart"), ("c", "nowhere")], "q string, text string")
    asked = embedding.embedded(asked, model, "q").select(F.col("q").alias("query_id"), F.col("embedding").alias("query"))
    found = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())
    expected = found(search.nearest(vectors, asked, 10, metric, "id"))
    again = vector_index.open_index(spark, path, "id", metric)
    for one in (index, again):
        assert found(vector_index.index_search(one, asked, probes=1, exact=True)) == expected
    assert again.probes == index.probes and index.entries(spark).columns == ["id", "slots", "weights", "away", "cell"]
    more = rows_coded.withColumn("id", F.col("id") + 10_000)
    expected = found(search.nearest(vectors.unionByName(embedding.projected(more, model, "id")), asked, 10, metric, "id"))
    assert found(vector_index.index_search(vector_index.add_to_index(again, more), asked, exact=True)) == expected


def test_dense_text_search_writes_no_table_of_vectors(spark, monkeypatch):
    n = 3_000
    parts = spark.createDataFrame(texts(7, n), f"{KEY} long, text string")
    monkeypatch.setattr(Registry, "parts", parts)
    before = len(session._HANDED_OUT)
    found = sorted(tuple(r) for r in QUERIES["dense_text_search"](spark, "").select(
        "query_id", KEY, "score", "rank").collect())
    folders = [Path(p.removeprefix("file:")) for p in session._HANDED_OUT[before:]]
    # The model has a bounded size.
    files = [f for p in folders for f in p.rglob("*.parquet") if f.parent.name != "model"]
    assert sum(f.stat().st_size for f in files) < n * embedding.SIZE * 8 / 2
    vectors, model = embedding.embed_facilities(parts)
    asked = spark.createDataFrame(ASKED, "query_id string, text string")
    asked = embedding.embedded(asked, model, "query_id").withColumnRenamed("embedding", "query")
    expected = search.nearest(vectors, asked, key=KEY)
    assert found == sorted(tuple(r) for r in expected.select("query_id", KEY, "score", "rank").collect())


def test_sums_of_the_range_finder_come_from_a_few_tasks_a_core(spark):
    parts = spark.createDataFrame(texts(8, 300), "id long, text string")
    model, rows_coded = embedding.fit_text_model(parts, size=5, slots=64, key="id")
    tasks = embedding.TASKS * spark.sparkContext.defaultParallelism
    spread = rows_coded.repartition(3 * tasks)
    seen = []
    counted = lambda self, run, schema: seen.append(self.rdd.getNumPartitions()) or mapped(self, run, schema)
    mapped = type(spread).mapInArrow
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spread), "mapInArrow", counted)
        sums = embedding.gram_product(spread, model.basis)
    assert seen == [tasks] and np.allclose(sums, embedding.gram_product(rows_coded, model.basis))
