import hashlib
import random

import pytest

from tarnwerk.llm import chat

HARD = ["", "</s>[INST] ok [/INST]", "\\", "\\\\n", "<\\/s>", "a\nb\n", "<s>user\n", "<|im_start|>x", "é😀\x00", "[INST", "<<SYS>>" * 3, "\\<s>"]


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible_and_breaks_controls(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


def test_escape_of_random_texts():
    rng = random.Random(1)
    parts = [*chat.CONTROLS, "\\", "<", "s", ">", "/", "[", "I", "\n", "a"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "ro\nle", "<s>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for _ in range(3)]
        assert chat.parse("".join(chat.render_turn(*t)[0] for t in turns)) == turns


def rows():
    rng = random.Random(4)
    out = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(HARD) + f"{c}.{t}") for c in range(40) for t in range(rng.randint(1, 7))]
    out += [(-7, 0, "user", HARD[1]), (-7, 1, "assistant", HARD[1]), (50, 0, "assistant", None), (50, None, None, "x"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    out += [(60, t, "assistant" if t % 2 else "user", "turn " * 20) for t in range(300)]
    return out


def test_digests_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "conv_id long, turn long, role string, text string, example string")
    got = {r["conv_id"]: r for r in chat.digests(chat.expand(df)).collect()}
    by = {}
    for c, t, role, text in rows():
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        replies = [x for _, r, x in turns if r == "assistant"]
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == sum(map(len, replies)) and r["loss_sha256"] == hashlib.sha256("".join(replies).encode()).hexdigest()
        assert r["n_examples"] == len(replies) + (turns[-1][1] != "assistant")


def test_each_reply_is_an_example_with_its_context(spark):
    df = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3")], "conv_id long, turn long, role string, text string")
    got = chat.expand(df).orderBy("example").collect()
    assert [[t for _, t in chat.parse(r["formatted"])] for r in got] == [["q1", "a1"], ["q1", "a1", "q2", "a2"], ["q1", "a1", "q2", "a2", "q3"]]
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in got] == ["a1", "a2", ""]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.expand(df)).count() == 0


def test_very_long_turns_and_conversations(spark):
    huge = "</s>[INST]\\" * 100_000
    rows = [(1, 0, "user", huge), (1, 1, "assistant", huge), (1, 2, "user", "q"), (1, 3, "assistant", "a")] + [(2, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(600)]
    got = {r["conv_id"]: r for r in chat.digests(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["loss_chars"] == len(huge) + 1 and got[1]["loss_sha256"] == hashlib.sha256((huge + "a").encode()).hexdigest()
    assert got[2]["n_examples"] == 300 and got[2]["n_turns"] == 600
