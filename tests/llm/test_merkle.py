import hashlib
import random

from pyspark.sql import functions as F

from noticeflow.llm import merkle

SCHEMA = "doc_id long, text string"


def prints(spark, rows):
    return {r.doc_id: r for r in merkle.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_edited_text_follows_the_next_document(spark):
    rng = random.Random(4)
    rows = [(k * k - 30, "".join(rng.choice("ab é😀\n.") for _ in range(rng.randint(0, 300)))) for k in range(60)]
    text = dict(rows)
    order = sorted(text)
    rng.shuffle(rows)
    got = prints(spark, rows)
    for k, i in enumerate(order):
        t, nxt = text[i], text[order[(k + 1) % len(order)]]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_likeness_tells_edits_from_other_texts(spark):
    rng = random.Random(9)
    rows = [(k, "\n".join(" ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(12)) for _ in range(20)))
            for k in range(10)]
    for r in prints(spark, rows).values():
        assert 0.6 < r.near_edited < 0.9 and r.near_next < 0.1


def test_equal_texts_differing_branches_and_roundtrip(spark):
    a = "\n".join(f"line {k} of the text" for k in range(100))
    b = a.replace("line 40 ", "LINE 40 ")
    df = spark.createDataFrame([(a, a, b)], "a string, b string, c string").select(
        *[merkle.fingerprint(F.col(c)).alias(c) for c in "abc"], F.concat_ws("", merkle.paragraphs(F.col("a"))).alias("j"))
    r = df.select("*", merkle.edits(F.col("a"), F.col("c")).alias("e"), merkle.edits(F.col("a"), F.col("b")).alias("n"),
                  merkle.likeness(F.col("a"), F.col("b")).alias("same")).first()
    assert r.a == r.b != r.c and r.e == [40] and r.n == [] and r.same == 1.0 and r.j == a


def test_edges(spark):
    assert prints(spark, []) == {}
    one = prints(spark, [(5, "alone here")])[5]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alone heal").hexdigest()
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (3, "x" * 50_000), (None, "tail")]
    out = merkle.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert by[None].edited_sha256 == hashlib.sha256(b"tai").hexdigest()        # the first text is empty


def test_many_ranges(spark):
    rows = [(3 * k - 400, f"text {k} " * 5) for k in range(500)] + [(None, "a"), (None, "b")]
    want = {(r.doc_id, r.fingerprint): r for r in merkle.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        got = merkle.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.doc_id, r.fingerprint): r for r in got} == want and len(got) == len(rows)
