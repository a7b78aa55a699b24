from basketry.llm import chat_format as cf


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, n string")


def render(turns):
    return "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns)


def mask(turns):
    out = []
    for r, t in turns:
        head, body = len("<|im_start|>\n") + len(r or "unknown"), len(t or "") + len("<|im_end|>\n")
        out.append(f"0:{head},1:{body}" if r == "assistant" else f"0:{head + body}")
    return ",".join(out)


def plain(c, r):
    c, r = c or [], r or []
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    return (n, render(c[:n]), render(c[n:]), mask(c[n:]), render(r[n:]), mask(r[n:]))


PAIRS = [
    (1, [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]), (2, [("user", "a")], [("user", "a")]), (3, [("user", "a")], [("system", "a"), ("user", "b")]),
    (4, None, [("assistant", "x")]), (5, [], []), (6, [("user", None), ("assistant", "é日🙂")], [("user", ""), ("assistant", "é")]), (7, [(None, "q")], [(None, "q"), ("assistant", None)]),
    (None, [("user", "a")], None), (1, [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]), (8, [("user", "x" * 200_000)] * 2, [("user", "x" * 200_000)]),
    (9, [("user", f"t{i}") for i in range(500)], [("user", f"t{i}") for i in range(499)] + [("assistant", "end")]),
]
TYPE = "pair_id long, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>, c string, n string"


def test_against_plain(spark):
    df = spark.createDataFrame([(*p, "c", "n") for p in PAIRS], TYPE)
    got = cf.format_preferences(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain(c, r)) for i, c, r in PAIRS), key=repr)
    assert cf.format_preferences(df.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    rows = turns_of(spark, [(0, 0, "user", "a")])
    execution = cf.format_preferences(cf.with_other_ending(cf.conversations(rows)))._jdf.queryExecution()
    plan, steps = execution.toString(), execution.executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD ["))
    assert steps.count("Exchange hashpartitioning") == 2 and "Join" not in steps


def test_conversations_and_swap(spark):
    rows = [(0, 1, "assistant", "A0"), (0, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "A1"), (4, 0, "user", "alone"), (None, 0, "user", "lost"), (6, 2, "user", "b"), (6, 2, "user", "a"), (6, None, None, None)]
    chats = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in cf.conversations(turns_of(spark, rows)).collect()}
    assert chats == {0: [("user", "q"), ("assistant", "A0")], 1: [("user", "q"), ("assistant", "A1")], 4: [("user", "alone")], 6: [(None, None), ("user", "a"), ("user", "b")]}
    pairs = {r["pair_id"]: r for r in cf.with_other_ending(cf.conversations(turns_of(spark, rows))).collect()}
    ending = lambda i: [tuple(t) for t in pairs[i]["rejected"]]
    assert ending(0) == chats[1] and ending(1) == [("user", "q"), ("assistant", "A0")] and ending(4) == ending(6) == []
    lengths = {r["pair_id"]: r["n_prefix"] for r in cf.format_preferences(cf.with_other_ending(cf.conversations(turns_of(spark, rows)))).collect()}
    assert lengths == {0: 1, 1: 1, 4: 0, 6: 0}


def test_endings_of_many_lengths(spark):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"t{c}-{i}") for c in range(-8, 12) if c != 5 for i in range(1 + c % 5)]
    chats = {c: [("user" if i % 2 == 0 else "assistant", f"t{c}-{i}") for i in range(1 + c % 5)] for c in range(-8, 12) if c != 5}
    got = {r["pair_id"]: [tuple(t) for t in r["rejected"]] for r in cf.with_other_ending(cf.conversations(turns_of(spark, rows))).collect()}
    assert got == {c: t[: c % len(t)] + chats.get(c ^ 1, [])[c % len(t) :] for c, t in chats.items()}
