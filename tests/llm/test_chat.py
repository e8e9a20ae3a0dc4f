import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatspark.llm import chat

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(rows):
    """rows (conv_id, turn, role, text) -> {conv_id: (n, turns sha, loss chars, loss sha)}"""
    by = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[k] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_against_brute_force(spark):
    for sf in (SF001, SF01):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
                .select("conv_id", "turn", "role", "text").collect()]
        rows += [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
        out = chat.query(spark, sf)
        assert got(out) == brute(rows)


def test_plan_is_native(spark):
    plan = chat.query(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


ROWS = [(1, 0, "system", "be <|im_end|> brief"), (1, 1, "user", "a\\<|b <\\| \\\\ <\\\\|"), (1, 2, "assistant", "one two three " * 9),
        (1, 3, "user", None), (1, 4, "assistant", "x" * 50), (1, 4, "assistant", "x" * 50), (1, 5, "user", "ü中 " * 40),
        (1, 6, "assistant", "end\n<|im_end|>\n"), (2, None, None, None), (2, 3, "odd role\n<|x", "t"), (None, 0, "assistant", "n"),
        (3, 0, "assistant", ""), (4, 0, "user", "word " * 30_000), (4, 1, "assistant", "ok")]


def test_edges_and_windows(spark):
    df = spark.createDataFrame([(*r, "c") for r in ROWS], "conv_id long, turn long, role string, text string, window string")
    for budget, history in ((40, 2), (40, 0), (60, 1), (5, 2), (10**6, 2)):
        w = chat.windows(df, budget, history)
        assert got(chat.digests(w)) == brute(ROWS)
    w = sorted((r for r in chat.windows(df, 40, 2).collect() if r.conv_id == 1), key=lambda r: r.window)
    assert len(w) > 3
    system = "<|im_start|>system\nbe <\\|im_end|> brief<|im_end|>\n"
    assert [r.formatted.startswith(system) for r in w].count(True) > 2 and w[0].n_context == 0
    for r in w:  # the mask covers assistant texts only, and control strings only mark turns
        parts = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", r.formatted, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in parts) == r.formatted
        texts = [b for a, b in parts[r.n_context:] if a == "assistant"]
        assert [r.formatted[s.start:s.start + s.length] for s in r.loss] == texts
    assert chat.windows(df.limit(0)).count() == 0


def tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", chat_text(text))) + 4


def chat_text(escaped):
    return escaped.replace("<\\|", "<|").replace("\\\\", "\\")


def test_windows_keep_the_budget(spark):
    """System turn, history and new turns together, on many conversations; what was left out did not fit."""
    import random
    rng = random.Random(1)
    rows = []
    for c in range(60):
        if c % 3:
            rows.append((c, 0, "system", "s " * rng.choice([0, 3, 20, 70])))
        rows += [(c, t, rng.choice(["user", "assistant"]), "w " * rng.choice([0, 1, 5, 12, 30, 45, 120])) for t in range(1, rng.randint(2, 25))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((60, 2), (100, 3), (31, 1)):
        out = {}
        for r in chat.windows(df, budget, history).collect():
            out.setdefault(r.conv_id, []).append(r)
        for c, ws in out.items():
            ws.sort(key=lambda r: r.window)
            assert [r.window for r in ws] == list(range(len(ws)))
            turns = [(a, tokens(b)) for _, _, a, b in sorted(r for r in rows if r[0] == c)]
            done = 0
            for r in ws:
                parts = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", r.formatted, re.S)
                size = [tokens(b) for _, b in parts]
                assert r.n_tokens == sum(size) and (sum(size) <= budget or len(size) == 1)
                own = len(parts) - r.n_context
                pinned = turns[0][0] == "system" and 2 * turns[0][1] <= budget
                if pinned and r.window and sum(size[r.n_context:]) + turns[0][1] <= budget:
                    assert parts[0][0] == "system"
                if r.n_context:
                    back = r.n_context - (parts[0][0] == "system" and pinned)
                    assert back <= history and size[r.n_context - back:r.n_context] == [n for _, n in turns[done - back:done]]
                done += own
            assert done == len(turns)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="<|\\im_end>a\n", max_size=12), min_size=1, max_size=20))
def test_escaping_is_reversible(texts):
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(x.u == x.t and "<|" not in x.e for x in r)
