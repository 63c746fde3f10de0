from sweetframe.llm import chat


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def plain(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1
    out = [k, render(chosen[:k])]
    for side in (chosen[k:], rejected[k:]):
        out.append(render(side))
    for side in (chosen[k:], rejected[k:]):
        at, spans = 0, []
        for r, t in side:
            one = render([(r, t)])
            if r == "assistant":
                spans.append(f"{at + len('<|im_start|>' + r) + 1}:{at + len(one)}")
            at += len(one)
        out.append(",".join(spans))
    return out


PAIRS = {
    1: ([("user", "hi"), ("assistant", "yes"), ("user", "and?"), ("assistant", "é" * 30_000)], [("user", "hi"), ("assistant", "yes"), ("user", "or?"), ("assistant", "no")]),
    2: ([("user", "same"), ("assistant", "same")], [("user", "same"), ("assistant", "same")]),
    3: ([("system", ""), ("user", "a")], []),
    4: ([], [("assistant", "only")]),
    5: ([("user", "x")], [("user", "x"), ("assistant", "longer")]),
    6: ([("user", "x"), ("user", "x")], [("user", "x"), ("assistant", "x")]),
}


def test_pairs_equal_the_plain_ones(spark):
    rows = [(p, side, i, r or None, t or None, "extra") for p, sides in PAIRS.items() for side, turns in zip(("chosen", "rejected"), sides) for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt string").repartition(4)
    got = {r[0]: list(r)[1:] for r in chat.preference_pairs(turns).collect()}
    assert got == {p: plain(*sides) for p, sides in PAIRS.items()}
    assert chat.preference_pairs(turns.limit(0)).count() == 0


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "bye"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (2, 0, "user", "alone"), (3, 0, "assistant", "c"), (None, 0, "assistant", "d")]
    got = chat.preference_pairs(chat.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r[0]: list(r)[1:] for r in got.collect()} == {
        0: plain([("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]),
        1: plain([("user", "r"), ("assistant", "b")], [("user", "r"), ("assistant", "a")]),
    }


def test_turns_without_a_number_stand_first(spark):
    rows = [(2, None, "system", "s"), (2, 0, "user", "q"), (2, 1, "assistant", "x"), (2, 2, "user", "late"), (3, None, "assistant", "only")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(chat.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert got[2]["prompt"].startswith("<|im_start|>system\ns<|im_end|>") and got[2]["n_prompt_turns"] == 2 and "late" not in got[2]["chosen"]
    assert "only" in got[2]["rejected"] and "only" in got[3]["chosen"] and "x" in got[3]["rejected"]


def test_completions_of_several_turns(spark):
    turns = [("user", "q"), ("assistant", "a"), ("user", "more"), ("assistant", "b"), ("user", "why"), ("assistant", "c")]
    other = [("user", "q"), ("assistant", "no"), ("user", "more"), ("assistant", "b")]
    rows = [(1, side, i, *t) for side, ts in (("chosen", turns), ("rejected", other)) for i, t in enumerate(ts)]
    (r,) = chat.preference_pairs(spark.createDataFrame(rows, "pair_id int, side string, turn int, role string, text string")).collect()
    assert r["n_prompt_turns"] == 1
    for side, ts in (("chosen", turns), ("rejected", other)):
        spans = [tuple(map(int, x.split(":"))) for x in r[f"{side}_mask"].split(",")]
        assert [r[side][a:b] for a, b in spans] == [t + "<|im_end|>\n" for role, t in ts[1:] if role == "assistant"]
