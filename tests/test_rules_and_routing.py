import pytest
from pyspark.sql import functions as F

from wardmap.operators import evaluation, merge, routing, rules
from wardmap.plans import catalogue
from wardmap.plans.tables import Registry
from wardmap.session import drop_work
from wardmap.sources.dimensions import CONTEXT_RULES, NAME_RULES, QUESTIONS


def value(spark, expression, text=None):
    return spark.createDataFrame([(text,)], "c string").select(expression).first()[0]


@pytest.mark.parametrize("name, expected", [
    ("Tema General Hospital", ["internalMedicine"]), ("Community Clinic", ["familyMedicine"]),
    ("Dental Clinic", ["dentistry"]), ("Hospital Clinic", ["internalMedicine"]),
    ("Heart Surgery Centre", ["cardiacSurgery"]), ("Orthodontic Dental Clinic", ["orthodontics"]),
    ("ENT and Eye Unit", ["ophthalmology", "otolaryngology"]), ("Center for dentures", []), ("Trauma ER", ["criticalCareMedicine", "emergencyMedicine"]),
])
def test_name_rules(spark, name, expected):
    assert value(spark, rules.rule_specialties(F.col("c"), NAME_RULES), name) == expected


@pytest.mark.parametrize("text, expected", [
    ("cleft surgery camp", ["plasticSurgery"]), ("offers surgery and anesthesia", ["anesthesia", "generalSurgery"]),
    ("needed edges", []),
])
def test_context_rules(spark, text, expected):
    assert value(spark, rules.rule_specialties(F.col("c"), CONTEXT_RULES), text) == expected


@pytest.mark.parametrize("term, expected", [
    ("PMR", "physicalMedicineAndRehabilitation"), ("surgery", "generalSurgery"), ("cardiology", "cardiology")])
def test_terms(spark, term, expected):
    assert value(spark, rules.canonical_term(F.col("c")), term) == expected


@pytest.mark.parametrize("name, expected", [
    ("ACME CLINIC LTD", "Acme Clinic"), ("Care, Inc.", "Care"), ("St.  Mary  LLC", "St. Mary"), ("Lincoln Home", "Lincoln Home")])
def test_clean_name(spark, name, expected):
    assert value(spark, rules.clean_name(F.col("c")), name) == expected


@pytest.mark.parametrize("url, host", [
    ("https://www.a.org/x?y", "a.org"), ("b.org/path", "b.org"), ("HTTP://M.C.org:80/", "m.c.org"), (None, None)])
def test_hosts(spark, url, host):
    assert value(spark, merge.url_host(F.col("c")), url) == host


def test_secrets(spark):
    text = "key gsk_Ab12 and gsk_z9! token = \"" + "a1" * 20 + "\""
    masked = value(spark, rules.mask_secrets(F.col("c"), mask="***"), text)
    assert masked == "key *** and ***! ***"


@pytest.mark.parametrize("phone, valid", [("+233392022664", True), ("0392022664", False), ("+0123", False), ("+" + "1" * 16, False)])
def test_phone(spark, phone, valid):
    assert value(spark, F.col("c").rlike(rules.E164), phone) is valid


@pytest.mark.parametrize("question, intent", [
    ("How many services?", "SQL"), ("explain why", "REASONING"), ("hello", "SEMANTIC"), ("What does it offer", "SEMANTIC"),
    ("count the flagged", "SQL"), ("compare equipment", "SQL")])
def test_intent(spark, question, intent):
    asked = spark.createDataFrame([(question,)], "question string")
    assert routing.with_intent(asked).first()["intent"] == intent


@pytest.mark.parametrize("reply, label", [
    (" desert ", "DESERT"), ("It is REASONING.", "REASONING"), ("semantic or structured", "STRUCTURED"), ("?", "SEMANTIC")])
def test_labels(spark, reply, label):
    assert value(spark, routing.repair_label(F.col("c")), reply) == label


@pytest.mark.parametrize("text, verdict", [
    ("SELECT last_updated, created_at FROM t", "allowed"), ("```sql\nSELECT 1;\n```", "allowed"),
    ("drop table t", "blocked word"), ("SELECT 1; SELECT 2", "several statements"), ("select 1;;", "allowed"),
    ("SELECT 'a;b', \"c;\", `d;` FROM t", "allowed"), ("SELECT 'it''s;'; SELECT 2", "several statements")])
def test_sql_verdict(spark, text, verdict):
    assert value(spark, routing.sql_verdict(F.col("c")), text) == verdict


def test_guarded_select(spark):
    spark.range(100).createOrReplaceTempView("numbers")
    assert routing.guarded_select(spark, "```sql\nSELECT id FROM numbers WHERE id >= :low;\n```", args={"low": 10}).count() == 50
    for bad in ("DROP TABLE numbers", "SELECT 1; SELECT 2", "SHOW TABLES", "SELECT 1; delete from numbers"):
        with pytest.raises(ValueError):
            routing.guarded_select(spark, bad)
    for other in ("SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT * FROM elsewhere",
                  "WITH a AS (SELECT * FROM elsewhere) SELECT * FROM a",
                  "SELECT id FROM numbers WHERE id IN (SELECT id FROM other.table)",
                  "SELECT n.id FROM numbers n JOIN json.`/tmp/x` j ON true", "SELECT * FROM range(5)"):
        with pytest.raises(ValueError, match="not a registered view"):
            routing.guarded_select(spark, other)
    good = "WITH a AS (SELECT id FROM numbers WHERE id < 3), b AS (SELECT * FROM a) SELECT id, (SELECT max(id) FROM numbers) m FROM b"
    assert routing.guarded_select(spark, good).count() == 3


@pytest.mark.parametrize("text", [
    "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')",
    "SELECT * FROM IDENTIFIER('num' || 'bers')", "SELECT * FROM IDENTIFIER(:name)",
    "SELECT 1 FROM numbers WHERE EXISTS (SELECT * FROM IDENTIFIER(concat('csv.`', '/etc/passwd`')))",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.util.UUID', 'randomUUID')",
    "SELECT id, try_reflect('java.lang.System', 'exit') FROM numbers", "SELECT IDENTIFIER('java_method')('a', 'b')",
    "SELECT id FROM numbers WHERE id = (SELECT max(length(java_method('java.lang.System', 'getProperty', 'x'))))",
    "SELECT current_user", "SELECT current_user()", "SELECT input_file_name() FROM numbers", "SELECT version()",
    "SELECT doubled(id) FROM numbers", "SELECT * FROM numbers, LATERAL (SELECT * FROM text.`/etc/passwd`)",
    "SELECT * FROM VALUES (1) AS t(a) JOIN numbers2", "WITH numbers2 AS (SELECT 1), b AS (SELECT * FROM c) SELECT * FROM b",
    "WITH a AS (SELECT 1) INSERT INTO numbers SELECT * FROM a", "SELECT * FROM kept_table"])
def test_guard_refuses(spark, text):
    spark.range(100).createOrReplaceTempView("numbers")
    spark.udf.register("doubled", lambda x: x, "long")
    with pytest.raises(ValueError):
        routing.guarded_select(spark, text, args={"name": "numbers"} if ":name" in text else None)


@pytest.mark.parametrize("text, rows", [
    ("SELECT 'a;b' AS x, \"c;d\" AS y FROM numbers WHERE id = 1;", 1),
    ("WITH t AS (SELECT id, id % 3 AS g FROM numbers) SELECT g, count(*), nvl(max(id), 0) FROM t GROUP BY g HAVING sum(id) > 1", 3),
    ("SELECT id, row_number() OVER (ORDER BY id) FROM numbers WHERE id IN (SELECT id + 1 FROM numbers) AND id < 4", 3),
    ("SELECT x, date_trunc('month', current_timestamp()) FROM numbers LATERAL VIEW explode(array(1, 2)) AS x WHERE id < 2", 4),
    ("SELECT * FROM VALUES (1, 'x;y'), (2, 'z') AS t(a, b) WHERE b LIKE '%;%'", 1),
    ("SELECT to_json(named_struct('a', id)), transform(array(id), v -> v + 1), CASE WHEN id > 1 THEN 'x' END FROM numbers LIMIT 2", 2),
    ("SELECT ceil(id / 2), lpad(id, 3, '0'), contains('abc', 'b') FROM numbers WHERE id BETWEEN 2 AND 3", 2)])
def test_guard_allows(spark, text, rows):
    spark.range(100).createOrReplaceTempView("numbers")
    assert routing.guarded_select(spark, text).count() == rows


def test_mentioned_region_is_the_longest_whole_name(spark):
    log = spark.createDataFrame([(1, "hospitals in Bono East?"), (2, "Bono clinics"), (3, "homes"), (4, "Brong-Ahafo area")],
                                "event_id int, question string")
    names = spark.createDataFrame([("Bono",), ("Bono East",), ("Ho",), ("Brong-Ahafo",), (None,)], "address_stateOrRegion string")
    got = {r["event_id"]: (r["region"], r["type"]) for r in routing.question_facts(log, names).collect()}
    assert got == {1: ("Bono East", "hospital"), 2: ("Bono", "clinic"), 3: (None, None), 4: ("Brong-Ahafo", None)}


def test_question_set_and_accuracy(spark):
    rows = [(i, q[0], q[2], q[1], q[3], "a" * 10, 100) for i, q in enumerate(QUESTIONS)]
    log = spark.createDataFrame(rows, "event_id int, question_id string, question_category string, question string, "
                                      "expected_route string, answer string, total_ms long")
    evaluated = evaluation.evaluated(log)
    summary = evaluation.evaluation_summary(evaluated).first()
    assert len(QUESTIONS) == 15 and summary["total"] == 15 and summary["avg_seconds"] == 0.1
    assert summary["correct"] == evaluated.where("correct_route").count()
    by = {r["category"]: r["total"] for r in evaluation.evaluation_by_category(evaluated).collect()}
    assert by["ALL"] == 15 and sum(n for c, n in by.items() if c != "ALL") == 15
    nameless = evaluated.withColumn("question_category", F.lit(None).cast("string"))
    assert sorted(map(repr, (r["category"] for r in evaluation.evaluation_by_category(nameless).collect()))) == ["'ALL'", "None"]


def test_traces_of_one_step_and_bounded_median(spark):
    step = "struct<step: string, output: string, ms: long>"
    log = spark.createDataFrame(
        [(1, None, "q", "SQL", [("classify", "x", 5)], "a" * 600, 1234, ["1"]), (2, None, "q", "SQL", [], None, 1, [])],
        f"event_id int, ts timestamp, question string, expected_route string, steps array<{step}>, answer string, "
        "total_ms long, source_ids array<string>")
    rows = {r["event_id"]: r for r in evaluation.trace_rows(log).collect()}
    assert rows[1]["agent_used"] is None and len(rows[1]["answer_preview"]) == 500 and "timestamp" in rows[1]
    times = spark.createDataFrame([(i, [], [("s", "o", i)]) for i in range(1, 102)],
                                  f"event_id int, source_ids array<string>, steps array<{step}>")
    assert evaluation.step_latency(times).first()["median_ms"] == 51


def test_citations_compare_ids_as_text(spark):
    log = spark.createDataFrame([(1, ["7", "8", "x"] + ["7"] * 10)], "event_id int, source_ids array<string>")
    names = spark.createDataFrame([(7, "seven", None)], "pk_unique_id long, name string, address_stateOrRegion string")
    cited = evaluation.citations(log, names)
    assert sorted(r["pos"] for r in cited.collect()) == [0, 3, 4, 5, 6, 7, 8, 9]
    assert evaluation.citation_lists(cited).first()["citations_json"].startswith('[{"id":"7","name":"seven","region":null}')


def test_question_reasoning_makes_the_mentions_once(spark):
    columns = ["name", "facilityTypeId", "address_city", routing.REGION, "numberDoctors", "capacity", "description",
               "specialties", "procedure", "equipment", "capability", "email"]
    rows = [("a", "u2", "Alpha", "clinic", "Accra", "Ga East", "3", "60", "d", '["x"]', None, None, "text", "e"),
            ("a", "u1", " null ", "hospital", None, "Ga East", None, "2.0", None, '["y","x"]', '["p"]', "[]", None, "e"),
            ("b", "u3", "Beta", None, "Ho", "Ho", None, None, None, None, None, None, None, None)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    given = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["pk_unique_id", "source_url", *columns]))
    registry = Registry(spark, "nowhere")
    registry.mentions = given.mapInArrow(counted, given.schema)
    registry.log = spark.createDataFrame(
        [(1, "Which hospital is in Ga East?"), (2, "Anything in Ho"), (3, "none")], "event_id long, question string")
    found = {r["event_id"]: r for r in catalogue.question_reasoning(registry).collect()}
    assert reads.value == len(rows)
    assert (found[1]["region"], found[1]["type"], found[1]["facilities"]) == ("Ga East", "hospital", 1)
    assert found[1]["context"] == ("- Alpha [hospital] in Accra, Ga East | Doctors: 3 | Beds: 2 | "
                                   'Specialties: ["x","y"] | Procedures: 1 | Equipment: 0')
    assert found[2]["facilities"] == 1 and found[3]["facilities"] == 2
    drop_work(spark)
