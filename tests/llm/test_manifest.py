import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from noticeflow.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, hash string, id string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(leaves, fan):
    """The root, and for each leaf its siblings as (left, right) per level."""
    paths, level, groups = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        ups, merged = [], []
        for at in range(0, len(level), fan):
            run = level[at:at + fan]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            ups.append(H(*run))
            merged.append([i for g in groups[at:at + fan] for i in g])
        level, groups = ups, merged
    return level[0], paths


def plain(rows, fan=8):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars) rows."""
    langs, trees, out = {}, [], []
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        mine = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r[0], r[3], r[2], r[4], r[1])), r) for r in langs[lang])
        trees.append((mine, *plain_tree([k[2] for k, _ in mine], fan)))
    root, tops = plain_tree([sub for _, sub, _ in trees], fan) if trees else (None, [])
    for (mine, sub, paths), top in zip(trees, tops):
        for ((_, _, leaf), (doc_id, text, lang, source, n)), path in zip(mine, paths):
            path = path + top
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            shown = text if text is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = plain_leaf(doc_id, source, lang, n, shown)
            for left, right in path:
                h = H(left, h, right)
            out.append((doc_id, leaf, sub, root, H(*[a + b for a, b in path]), h, h == root))
    return out


def made(seed, n, langs=("en", "de", "é", "", None)):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)                                               # noqa: E731
    return [(pick(None, rng.randint(-50, 400), i), pick(None, "", "Ab c", "É日 X", "lower"), rng.choice(langs),
             pick(None, "s", "-"), pick(None, 0, 7)) for i in range(n)]


def frame(spark, rows):
    # columns named like the operator's own must not clash
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)


def answers(df):
    return sorted(map(tuple, manifest.audited(df).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65, 200])
def test_equals_the_plain_tree(spark, n):
    rows = made(n, n)
    assert answers(frame(spark, rows)) == sorted(plain(rows), key=repr)


def test_repeated_rows_one_lang_and_many_langs(spark):
    same = [(1, "A" * 20_000, "en", "s", 3)] * 10 + [(2, "b", "en", "s", 3)]
    assert answers(frame(spark, same)) == sorted(plain(same), key=repr)
    many = [(i, "T", f"l{i % 70}", None, None) for i in range(150)]
    assert answers(frame(spark, many)) == sorted(plain(many), key=repr)


def test_binary_tree_by_xor(spark):
    hashes = [H(str(i)) for i in range(11)]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "id long, hash string")
    root, paths = plain_tree(hashes, 2)
    got = sorted(manifest.manifest(rows, F.lit("t"), fan=2).collect())
    assert [[tuple(s) for s in r.path] for r in got] == paths
    assert {(r.subroot, r.root) for r in got} == {(root, root)}          # a lone tree's root is the root


def test_untouched_rows_verify_and_tampered_ones_do_not(spark):
    rows = [(i, "Capital", "en", "s", 1) for i in range(30)]
    for r in manifest.audited(frame(spark, rows)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0)
