import random

from wardmap.llm.quotations import conversations, passages

ROWS = [
    (1, 0, "user", "Hello there friend.\nHow are you doing today?"), (1, 1, "assistant", "I am well, thanks.\nWhat do you need?"),
    (1, 2, "user", "Side remark about weather."),
    (1, 3, "assistant", "On Monday, A wrote:\n> How are you doing  today?\nFine again.\n>> nothing known here\n"),
    (1, 4, "user", "> I am well, thanks.\n> What do you\n> need?\nA lamp.\n> > Hello there friend.\n"),
    (1, 5, "assistant", "> > Hello there friend.\n> Fine again.\n"), (2, 0, "user", "x"), (2, 1, "assistant", None),
    (None, None, None, None), (2, 1, "assistant", None), (3, 0, "user", "> Hello there friend."), (3, 1, "user", "a > b\n>"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "z") for r in rows],
                                 "conv_id long, turn long, role string, text string, position int, row string")


def test_passages():
    assert passages("a\n> b\n>> c\n> d\n\ne") == [(0, "a"), (1, "b"), (2, "c"), (1, "d"), (0, "e")]
    assert passages("Am Montag schrieb B:\n> x\n\n> y") == [(1, "x\n\ny")]
    assert passages("") == [] and passages(">\n> \n") == [] and passages("a\n\nb") == [(0, "a\n\nb")]
    assert passages("> " * 50 + "deep") == [(50, "deep")]


def test_links_and_order(spark):
    found = {(r.conv_id, r.position): r for r in conversations(frame(spark)).collect()}
    assert len(found) == len(ROWS)
    # Turn 0 is answered by 1 (and that by 2 and 4) and by 3 (and that by 5).
    assert [found[1, i].turn for i in range(1, 7)] == [0, 1, 2, 4, 3, 5]
    assert [found[1, i].reply_to for i in range(1, 7)] == [None, 0, 1, 1, 0, 3]
    assert found[1, 5].text == "Fine again." and found[1, 4].text == "A lamp." and found[1, 6].text == ""
    assert [(found[1, i].n_quoted, found[1, i].n_linked) for i in (3, 5, 4, 6)] == [(0, 0), (2, 1), (2, 2), (2, 2)]
    # Nothing is quoted from another conversation, and quotes alone leave no text.
    assert found[3, 1].n_linked == 0 and found[3, 1].text == "" and found[3, 2].text == "a > b"
    assert [found[2, i].reply_to for i in (1, 2, 3)] == [None, 0, 1] and found[None, 1].text == ""


def test_later_and_repeated_originals(spark):
    rows = [(7, t, "user", "the same words again") for t in range(5)] + [(7, 5, "user", "> the same words again\nyes"),
                                                                       (7, 6, "user", "> comes only later\nno"),
                                                                       (7, 7, "user", "comes only later")]
    found = {r.turn: r for r in conversations(frame(spark, rows)).collect()}
    assert found[5].reply_to == 4 and found[6].reply_to == 5 and found[6].n_linked == 0


def places(rows):
    """{(conv, turn): place} by a walk through the answers; ``rows`` are (conv, turn, answered turn or None)."""
    answers, out = {}, {}
    for conv, turn, to in rows:
        answers.setdefault((conv, to), []).append((conv, turn))
    for conv in {r[0] for r in rows}:
        waiting, n = list(answers[conv, None]), 0
        while waiting:
            node = waiting.pop()
            n += 1
            out[node] = n
            waiting += sorted(answers.get(node, []), reverse=True)
    return out


def test_reply_order_against_a_walk(spark):
    rng = random.Random(2)
    rows, told = [], []
    for conv in range(40):
        for turn in range(rng.randrange(1, 60)):
            quoted = rng.randrange(turn) if turn and rng.random() < 0.6 else None
            own = f"message {turn} of conversation {conv} speaks of {rng.choice(['bread', 'rain', 'trains'])} today"
            quote = "" if quoted is None else next(f"> {t.splitlines()[-1]}\n" for c, n, _, t in rows if (c, n) == (conv, quoted))
            rows.append((conv, turn, "user", quote + own))
            told.append((conv, turn, turn - 1 if quoted is None and turn else quoted))
    rng.shuffle(rows)
    found = conversations(frame(spark, rows).repartition(5)).collect()
    assert {(r.conv_id, r.turn): r.reply_to for r in found} == {(c, t): to for c, t, to in told}
    assert {(r.conv_id, r.turn): r.position for r in found} == places(told)
    assert all(r.n_linked == r.n_quoted for r in found)


def test_long_conversation_and_empty_table(spark):
    rows = [(9, t, "user", f"> line number {t - 3} here\nline number {t} here") for t in range(3000)]
    found = {r.turn: r for r in conversations(frame(spark, rows)).collect()}
    assert all(found[t].reply_to == t - 3 for t in range(3, 3000))
    assert {(9, t): r.position for t, r in found.items()} == places([(9, t, t - 3 if t > 2 else t - 1 if t else None) for t in range(3000)])
    assert conversations(frame(spark).limit(0)).count() == 0


def test_a_line_said_again_and_again(spark):
    rows = [(5, t, "user", "the very same line" if t % 3 else "> the very same line\nI know") for t in range(2000)]
    found = {r.turn: r for r in conversations(frame(spark, rows).repartition(7)).collect()}
    assert found[0].n_linked == 0
    assert all(found[t].reply_to == t - 1 and found[t].n_linked == (t % 3 == 0) for t in range(1, 2000))


def test_ids_and_turns_of_other_types(spark):
    rows = [("c", "2024-01-01", "user", "some words to quote"), ("c", "2024-01-02", "user", "other words"),
            ("c", "2024-01-03", "user", "> some words to quote\nyes"), ("c", "2024-01-04", "user", "> other words\nno")]
    found = conversations(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")).collect()
    assert [(r.turn[-1], r.reply_to and r.reply_to[-1]) for r in sorted(found, key=lambda r: r.position)] == [
        ("1", None), ("2", "1"), ("4", "2"), ("3", "1")]


def test_parts_of_lines_and_passages_wrapped_anew(spark):
    long = "I went to the market today. The apples were cheap, but the pears were not! Shall we bake a cake with them tomorrow?"
    wrapped = "the committee met again on tuesday and\nagreed that the bridge will be\nbuilt next year without any further delay"
    rows = [(1, 0, "user", long), (1, 1, "assistant", wrapped), (1, 2, "user", "Something else entirely."),
            (1, 3, "user", "> The apples were cheap, but the pears were not!\nGood."),
            (1, 4, "user", "> committee met again on tuesday and agreed\n> that the bridge will be built\nGood."),
            (1, 5, "user", "> bake a cake with them\nYes."), (1, 6, "user", "> the apples said nothing of this kind to anybody here\nNo."),
            (None, None, "user", long), (None, 1, "user", "b"), (None, 2, "user", "> were cheap, but the pears\nx")]
    found = {(r.conv_id, r.turn): r for r in conversations(frame(spark, rows)).collect()}
    assert [(found[1, t].reply_to, found[1, t].n_linked) for t in (3, 4, 5, 6)] == [(0, 1), (1, 1), (0, 1), (5, 0)]
    assert len(found) == len(rows) and found[None, 2].n_quoted == 1
