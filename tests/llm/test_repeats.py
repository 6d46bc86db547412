import hashlib
import random

import pyarrow as pa
import pytest

from noticeflow.llm import repeats

SCHEMA = "doc_id long, text string"


def plain(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256), window by window."""
    first = {}
    data = [(i if i is not None else repeats.LAST, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for (doc, _), (i, b) in zip(rows, data):
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = [tuple(r) for r in repeats.digests(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == plain(rows)


def words(rng, n):
    return " ".join(rng.choice(("alpha", "be", "gamma", "delta", "é", "zeta", "eta")) + str(rng.randint(0, 9))
                    for _ in range(n))


def test_against_every_window(spark):
    rng = random.Random(5)
    shared = [words(rng, n) for n in (9, 12, 40)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 30))]
        for s in shared:
            if rng.random() < 0.5:
                a, b = rng.randint(0, 10), rng.randint(0, 10)
                parts.append(s[a:len(s) - b])
                parts.append(words(rng, rng.randint(0, 8)))
        rows.append((i, " ".join(parts)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]                       # exact copies
    rows += [(200 + k, rows[k][1].replace("gamma1", "gamma2")) for k in range(10)]
    rng.shuffle(rows)
    check(spark, rows)


def test_periodic_texts(spark):
    check(spark, [(1, "a" * 120), (2, "a" * 49), (3, "a" * 50), (4, "ab" * 70), (5, "b" + "ab" * 60), (6, "abc" * 99)])


def test_edges(spark):
    long = "x".join(str(k) for k in range(3000))
    check(spark, [(None, long), (1, None), (2, ""), (3, "short"), (4, long), (4, long), (5, "é" * 60), (6, "aé" + "é" * 58),
                  (None, "é" * 60), (7, long[:49]), (8, long[:50])])
    check(spark, [])


def test_equal_ids_do_not_repeat_each_other(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    got = repeats.digests(spark.createDataFrame([(1, text), (1, text), (1, text + " more")], SCHEMA)).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def test_other_columns_pass(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert rows[2]._kept == "" and rows[2].lang == "b" and rows[1]._kept == text


@pytest.mark.parametrize("run", [1, 8, 31])
def test_run_length_does_not_matter(monkeypatch, run):
    rng = random.Random(run)
    base = words(rng, 60).encode()
    rows, want = [], {}
    for i in range(30):
        cut = base[rng.randint(0, 20):rng.randint(80, 300)] + words(rng, 3).encode()
        for p, off in ((40, 20),):
            if len(cut) >= p + 50:
                rows.append((11, off, cut[p - off:p + 60], i, i, p - off))
    rows = [r for r in rows if r[2][r[1]:r[1] + 20] == rows[0][2][rows[0][1]:rows[0][1] + 20]]
    monkeypatch.setattr(repeats, "RUN", run)
    found = repeats._settle(rows)
    for _, off, text, i, _, at in rows:
        for w in range(len(text) - 49):
            first = min(r[3] for r in rows for k in [w - off + r[1]]
                        if 0 <= k <= len(r[2]) - 50 and r[2][k:k + 50] == text[w:w + 50])
            want[i, at + w] = first < i
    got = {(i, p) for i, spans in found.items() for a, b in spans for p in range(a, b)}
    assert got == {k for k, v in want.items() if v}


def shard_rows(rng, anchors, documents):
    """Stretch rows, sorted by anchor: some anchors with equal stretches only, some with different ones."""
    rows = []
    for anchor in range(anchors):
        core = words(rng, 60).encode()
        for i in range(rng.randint(1, documents)):
            tail = b"" if anchor % 2 else words(rng, 1).encode()
            rows.append((anchor, 20, core[20:100] + tail, rng.randint(0, 50), 1000 * anchor + i, 20))
    return rows


def removed_windows(batches):
    got = set()
    for batch in repeats._shard(3, 2000)(iter(batches)):
        for blob in batch.column("blob").to_pylist():
            keys, counts, flat = repeats._unpacked(blob, "int64", "uint32", "int32")
            spans = iter(flat.reshape(-1, 2).tolist())
            got |= {(k, w) for k, n in zip(keys.tolist(), counts.tolist()) for _ in range(n) for w in range(*next(spans))}
    return got


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_a_shard_settles_equal_stretches_as_columns(monkeypatch, cut):
    rows = shard_rows(random.Random(cut), 30, 9)
    want = set()
    for anchor, off, text, i, key, at in rows:
        for w in range(len(text) - 49):
            if any(r[0] == anchor and r[3] < i and r[2][w:w + 50] == text[w:w + 50] for r in rows):
                want.add((key, at + w))
    rows.insert(0, (-9, -1, repeats._spans([(4, 6), (9, 10)]), 0, 77, 0))               # settled by a task before
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                     ["anchor", "off", "text", "id", "key", "at"])
    one_by_one, settle = [], repeats._settle
    monkeypatch.setattr(repeats, "_settle", lambda part: one_by_one.extend(part) or settle(part))
    assert removed_windows(table.to_batches(max_chunksize=cut)) == want | {(77, 4), (77, 5), (77, 9)}
    assert len({r[0] for r in one_by_one}) > 5 and all(r[0] % 2 == 0 for r in one_by_one)


def test_equal_pieces_are_sorted_once(monkeypatch):
    rng = random.Random(3)
    core = words(rng, 60).encode()
    rows = [(5, 30, core[:90] + bytes([97 + i % 5]) * 10, i, i, 0) for i in range(40)]
    rows += [(5, 30, bytes([97 + i % 3]) + core[1:90], i, i, 0) for i in range(40, 60)]
    sorted_, holders = [], repeats.first_holders
    monkeypatch.setattr(repeats, "first_holders", lambda s: sorted_.extend(d for d, _ in s) or holders(s))
    repeats._settle(rows)
    assert sorted_ and len(sorted_) == len(set(sorted_))
