from itertools import takewhile

from corpusflow.llm import preferences as P

SCHEMA = "conv_id long, turn long, role string, text string, part string, segment int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_prefix_is_rendered_once(spark):
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "good")]
    rejected = chosen[:3] + [(1, 3, "assistant", "bad"), (1, 4, "assistant", "good")]
    segments = P.preference_segments(frame(spark, chosen), frame(spark, rejected))
    rows = sorted((r.part, r.turn, r.role, r.segment, r.loss_start, r.loss_end) for r in segments.collect())
    assert [r[:2] for r in rows] == [("chosen", 3), ("chosen", 4), ("prompt", 0), ("prompt", 1), ("prompt", 2), ("rejected", 3), ("rejected", 4)]
    for part, _, role, segment, start, end in rows:
        assert segment.startswith(f"<|{role}|>\n") and segment.endswith("<|end|>\n")
        assert (start, end) == ((len(role) + 5, len(segment)) if part != "prompt" and role == "assistant" else (0, 0))
    (pair,) = P.assembled(segments).collect()
    assert pair.prompt == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    assert pair.chosen == "<|user|>\nv<|end|>\n<|assistant|>\ngood<|end|>\n" and [pair.rejected[s.start : s.end] for s in pair.rejected_loss] == ["bad<|end|>\n", "good<|end|>\n"]
    assert [pair.chosen[s.start : s.end] for s in pair.chosen_loss] == ["good<|end|>\n"]


def test_odd_rows(spark):
    chosen = [(1, 0, "user", "u"), (2, 0, "user", "u"), (2, 0, "user", "u"), (2, None, None, None), (None, 0, "user", "u"), (4, 0, "user", "b"), (4, 0, "user", "a")]
    rejected = [(2, 0, "user", "u"), (2, None, None, None), (3, 0, "assistant", "a" * 100_000), (4, 0, "user", "a"), (4, 0, "user", "c")]
    got = {(r.pair_id, r.part, r.turn, r.nth, r.role) for r in P.preference_segments(frame(spark, chosen), frame(spark, rejected)).collect()}
    assert got == {
        (1, "chosen", 0, 1, "user"), (2, "prompt", None, 1, ""), (2, "prompt", 0, 1, "user"), (3, "rejected", 0, 1, "assistant"),
        (4, "prompt", 0, 1, "user"), (4, "chosen", 0, 2, "user"), (4, "rejected", 0, 2, "user"),
    }
    empty = frame(spark, [])
    assert P.preference_segments(empty, empty).collect() == [] and P.assembled(P.preference_segments(empty, empty)).collect() == []


def test_long_conversations_against_a_loop(spark):
    import random

    rng = random.Random(3)
    chosen = [(c, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(9)}") for c in range(30) for t in range(rng.randrange(1, 9))]
    chosen += [(99, t, "user", str(t)) for t in range(5000)]  # one conversation with most of the turns
    rejected = [(c, t, r, x if rng.random() < 0.8 and c != 99 or t < 4000 and c == 99 else "other") for c, t, r, x in chosen if rng.random() < 0.97 or c == 99]
    got = P.preference_segments(frame(spark, chosen), frame(spark, rejected)).groupBy("pair_id", "part").count().collect()
    sides = [{}, {}]
    for side, rows in zip(sides, (chosen, rejected)):
        for c, *turn in rows:
            side.setdefault(c, []).append(tuple(turn))
    want = {}
    for c in set(sides[0]) | set(sides[1]):
        a, b = sides[0].get(c, []), sides[1].get(c, [])
        n = len(list(takewhile(lambda p: p[0] == p[1], zip(a, b))))
        want |= {(c, p): k for p, k in (("prompt", n), ("chosen", len(a) - n), ("rejected", len(b) - n)) if k}
    assert {(r.pair_id, r.part): r["count"] for r in got} == want


def test_no_python_in_the_plan(spark):
    plan = P.op7_preferences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
