import random
import re

from pagewright.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def test_by_hand(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are  you?"), (1, 1, "a", "On Monday, Bob wrote:\n> Hello there.\n> How are you?\n\nFine, thanks!"), (1, 2, "u", "> > Hello there.\n> Fine, thanks!\nGood."),
        (1, 3, "b", "> how are YOU?\nI am too."), (1, 4, "c", None), (None, 1, "c", "> x"), (2, 0, "u", "> Fine, thanks!\nwhat?"), (1, 5, "z", "> Good.\nyes"), (1, 5, "z", "> Good.\nyes"), (3, 0, "u", ""), (3, None, "u", "> a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as root")
    got = quotations.link(df).collect()
    assert len(got) == len(rows)
    told = {(r["conv_id"], r["turn"]): (r["body"], r["parent"], r["depth"], r["root"]) for r in got}
    assert told[1, 1] == ("Fine, thanks!", 0, 1, 0)
    assert told[1, 2] == ("Good.", 1, 2, 0)
    assert told[1, 3] == ("I am too.", 0, 1, 0)
    assert told[1, 4] == ("", None, 0, 4)
    assert told[1, 5] == ("yes", 2, 3, 0)
    assert told[2, 0] == ("what?", None, 0, 0) and told[None, 1][1] is None
    assert quotations.link(df.limit(0)).count() == 0


def brute(rows):
    """Whole bodies are quoted at most one message deep, by other means: parents by comparing texts one by one."""
    plain = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    out = {}
    for c, t, _, text in rows:
        lines = text.split("\n")
        quoted = [x[2:] for x in lines if x.startswith("> ")]
        score = {}
        for c2, t2, _, other in rows:
            if c2 == c and t2 < t:
                body = [plain(x) for x in other.split("\n") if not x.startswith(">")]
                score[t2] = sum(len(plain(q)) for q in set(quoted) if plain(q) in body)
        best = max(score.values(), default=0)
        out[c, t] = max(x for x, v in score.items() if v == best) if best else None
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in range(6):
        said = []
        for t in range(12):
            own = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4)) for _ in range(rng.randint(1, 3))]
            of = rng.choice(said) if said and rng.random() < 0.7 else None
            lines = ["> " + x for x in rng.sample(of, rng.randint(1, len(of)))] if of else []
            rows.append((c, t, "u", "\n".join(lines + own)))
            said.append(own)
    got = {(r["conv_id"], r["turn"]): r["parent"] for r in quotations.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_deep_chains_keep_their_order(spark):
    rows = [(1, i, "u", (f"> message {i - 1} says this\n" if i else "") + f"message {i} says this") for i in range(40)]
    got = quotations.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["depth"] == r["turn"] and r["root"] == 0 for r in got)


def test_nested_levels_by_brute_force(spark):
    """Every answer quotes its whole line of ancestors, each a level deeper; parents are the ones that were drawn."""
    rng, rows, parent, lines = random.Random(8), [], {}, {}
    for t in range(60):
        parent[t] = rng.choice([None, *range(t)]) if t else None
        own = [f"saying {t} " + "".join(rng.choices("abcdef", k=12)) for _ in range(rng.randint(1, 2))]
        quoted = ["> " + x if not x.startswith(">") else ">" + x for x in lines[parent[t]]] if parent[t] is not None else []
        lines[t] = own + quoted
        rows.append((4, t, "u", "\n".join(quoted + own)))
    got = {r["turn"]: r for r in quotations.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    for t, p in parent.items():
        depth, root = 0, t
        while parent[root] is not None:
            depth, root = depth + 1, parent[root]
        assert (got[t]["parent"], got[t]["depth"], got[t]["root"]) == (p, depth, root)
        assert got[t]["body"] == "\n".join(x for x in lines[t] if not x.startswith(">"))


def test_part_of_a_line_and_long_texts(spark):
    long = "word " * 60_000
    rows = [(1, 0, "u", "Short one. The second sentence is what matters here. The end."), (1, 1, "u", "> The second sentence is\n> what matters here.\nyes"), (1, 2, "u", long), (1, 3, "u", "> " + long.strip() + "\nok")]
    got = {r["turn"]: r for r in quotations.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["parent"], got[3]["parent"], got[3]["body"]) == (0, 2, "ok")


def test_conversations(spark):
    rows = [(1, 0, "u", "Hello there, all."), (1, 1, "a", "> Hello there, all.\nHi!"), (1, 2, "b", "Something else."), (1, 3, "u", "> Hi!\nBye."), (1, 3, "u", "> Hi!\nBye."), (1, 4, "u", "> Bye."), (None, 1, "u", "x")]
    got = {(r["thread"], r["root"]): [(m["turn"], m["role"], m["depth"], m["text"]) for m in r["messages"]] for r in quotations.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0): [(0, "u", 0, "Hello there, all."), (1, "a", 1, "Hi!"), (3, "u", 2, "Bye.")], (1, 2): [(2, "b", 0, "Something else.")]}
    assert quotations.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
