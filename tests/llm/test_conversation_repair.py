import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from wardmap.llm.conversation_repair import damage_report, repair_report, repaired
from wardmap.llm.repair_costs import END, Steps, exits, tail, traced

SCHEMA = "conv_id long, turn long, role string, text string, chunk int, actions string, pos long"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SIGN = re.compile("[^\x20\x09-\x0d]")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if lot == 3 else 1)


def best(rows):
    """(cost, audit, lines) by plain recursion over rows, states and inserts."""
    seen, kinds, faults = set(), [], Counter()
    for role, text in rows:
        signs = SIGN.findall(text)
        kind = "blank" if not signs else "duplicate" if (role, text) in seen else \
            "truncated" if signs[-1] not in ".!?" else "fine"
        seen.add((role, text))
        faults[kind] += 1
        kinds.append(kind)
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def go(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 4:
            role = {"u": "assistant"}.get(last, "user")
            cost, audit, lines = go(i, role[0], inserts + 1)
            options.append((cost + 2, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, lines = go(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, lines))
            if kinds[i] in ("truncated", "fine"):
                for edit, name in (("K", role), ("R", "user"), ("R", "assistant")):
                    if name[:1] and name[0] in allowed[last]:
                        cost, audit, lines = go(i + 1, name[0], 0)
                        cost += 2 * (edit == "R") + (kinds[i] == "truncated")
                        options.append((cost, edit + audit, (f"{name}:{text}", *lines)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return go(0, "", 0), faults


def expected(original, rows):
    groups = {conv: [] for conv, *_ in original}
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, text[:64], hashlib.md5(text.encode()).hexdigest(), text))
    out = []
    for conv, members in groups.items():
        members.sort()
        lines = [(m[2], m[5]) for m in members]
        (cost, audit, left), faults = best(tuple(lines))
        turns = {m[1] for m in members if m[0]}
        pairs = zip(lines, lines[1:], strict=False)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
                    faults["truncated"], sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                    hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def messages(seed, conversations=30, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            role = role if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No!", "Why?  ", "and then", " \t", "", None, "ü.", f"line {turn}\nwith more."])
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn // 1 + 3 * (rng.random() < 0.05), role, text))
    return rows


def test_damage_and_repair_against_brute_force(spark):
    rows = messages(1) + [(99, 1, "user", "Hi.")] * 3 + [(4, 2, "assistant", "x" * 300_000 + ".")]
    assert found(damage_report(table(spark, rows))) == expected(rows, list(damage(rows)))


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_small_chunks_give_the_same(spark, bits):
    rows = messages(bits + 5, 8, 40)
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(repair_report(table(spark, rows), chunk_bits=bits)) == expected(rows, whole)


def test_one_long_conversation_spreads(spark):
    rows = [(7, t, ["user", "assistant"][t % 2] if t % 11 else "system", f"text {t % 900}.") for t in range(6000)]
    one, many = (found(repair_report(table(spark, rows), chunk_bits=b)) for b in (20, 6))
    assert one == many and len(one) == 1 and one[0][3] > 4000


def test_repaired_rows(spark):
    rows = [(1, 2, "assistant", "B."), (1, 1, "system", "A."), (2, 1, "user", "only"), (3, 1, "user", " ")]
    out = repaired(table(spark, rows)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.turn, r.role, r.text, r.edit) for r in out if r.conv_id == 1] == [
        (1, 1, "system", "A.", "K"), (1, None, "user", "", "I"), (1, 2, "assistant", "B.", "K")]
    # Deleting costs as much as keeping a truncated row and answering it; D comes first.
    assert [r.conv_id for r in out if r.conv_id > 1] == []


def test_ids_of_any_type_and_empty_tables(spark):
    named = spark.createDataFrame([("c-1", 1, "user", "Hi."), (None, None, None, None)],
                                  "conv_id string, turn int, role string, text string")
    assert {r.conv_id: r.audit for r in repair_report(named).collect()} == {"c-1": "KI", None: "D"}
    empty = table(spark, [])
    assert damage_report(empty).collect() == [] and repaired(empty).collect() == []


def test_steps_stop_where_vectors_differ_by_a_constant():
    rng, steps = random.Random(3), Steps()
    for _ in range(200):
        codes = [rng.randrange(12) for _ in range(rng.randrange(1, 60))]
        other = (1, 0, 3, 2)
        old = steps.start(codes, END)
        assert steps.mended(codes, END, old, other) == steps.start(codes, other)
        decisions = steps.decisions(codes, other)
        assert [traced(decisions, s)[1] for s in range(4)] == exits(decisions)
    assert [tail(s) for s in range(4)] == ["", "UA", "A", ""]


def test_every_conversation_of_the_given_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert found(damage_report(given)) == expected(rows, list(damage(rows)))
    assert given.select(F.count_distinct("conv_id")).first()[0] == damage_report(given).count()
