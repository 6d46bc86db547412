import hashlib
import random

from pyspark.sql import functions as F

from noticeflow.llm import chat, queries

NODE = "conv string, node long, parent long, role string, text string, score double"


def read(df):
    rows = df.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    return {(r.conv, r["rank"]): ([(t.role, t.text) for t in r.back], r.loss, r.leaf) for r in rows}


def test_every_branch_in_order_of_mean_score(spark):
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "one", 1.0), ("a", 3, 1, "assistant", "two", 3.0),
            ("a", 4, 2, "user", "again", 9.0), ("b", 1, None, "user", "alone", None)]
    found = read(chat.format_branches(spark.createDataFrame(rows, NODE), best=None))
    assert found == {
        ("a", 1): ([("user", "q"), ("assistant", "one"), ("user", "again")], "one", 4),
        ("a", 2): ([("user", "q"), ("assistant", "two")], "two", 3),
        ("b", 1): ([("user", "alone")], "", 1)}
    best = read(chat.format_branches(spark.createDataFrame(rows, NODE), best=1))
    assert set(best) == {("a", 1), ("b", 1)}


def test_random_trees_against_a_walk(spark):
    rng = random.Random(6)
    rows = []
    for c in "xyz":
        for k in range(1, 40):
            rows.append((c, k, rng.randint(max(1, k - 4), k - 1) if k > 1 else None, rng.choice(("user", "assistant")),
                         rng.choice(("<", "&lt;", "</turn>\n", '"', "\\", "é😀", "")) + str(k), rng.random()))
    parent = {r[:2]: r[2] for r in rows}
    said = {r[:2]: (r[3], r[4]) for r in rows}
    want = {}
    for c, k, *_ in rows:
        if not any(p == k and key[0] == c for key, p in parent.items()):
            path, n = [], k
            while n is not None:
                path.append(said[c, n])
                n = parent[c, n]
            want[c, k] = (path[::-1], "".join(t for role, t in path[::-1] if role == "assistant"))
    found = read(chat.format_branches(spark.createDataFrame(rows, NODE), best=None))
    assert {(c, leaf): (turns, loss) for (c, _), (turns, loss, leaf) in found.items()} == want


def test_chains_cycles_orphans_and_repeats(spark):
    deep = [("d", k, k - 1 if k else None, "user", str(k), 1.0) for k in range(300)]
    odd = [("o", 1, 99, "user", "orphan", 0.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0),
           ("r", 1, None, "user", "b", 0.0), ("r", 1, None, "user", "a", 0.0), ("n", 1, None, None, None, None)]
    found = read(chat.format_branches(spark.createDataFrame(deep + odd, NODE), best=None))
    assert [t for _, t in found["d", 1][0]] == [str(k) for k in range(300)]
    assert found["o", 1][0] == [("user", "orphan")] and found["r", 1][0] == [("user", "a")]
    assert found["n", 1][0] == [("", "")] and not any(c == "c" for c, _ in found)
    assert chat.format_branches(spark.createDataFrame([], NODE)).collect() == []


def test_query_on_nulls_ties_and_its_own_conversation(spark, tmp_dir):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a<b"), (1, 1, "assistant", "a&amp;b"), (None, 5, "system", "s"),
            (2, None, 'us"er', "<turn role="), (2, 3, None, "x\ny")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_dir}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op7_chat(spark, tmp_dir).collect()}
    turns = {1: [("user", ""), ("assistant", "a&amp;b"), ("assistant", "a<b")], None: [("system", "s")],
             2: [('us"er', "<turn role="), ("", "x\ny")], -7: [("user", said), ("assistant", said)]}
    assert set(got) == set(turns)
    for c, want in turns.items():
        loss = "".join(t for r, t in want if r == "assistant")
        assert got[c].n_turns == len(want)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
