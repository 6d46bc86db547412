"""The stored search index against plain counting."""

import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from noticeflow.functions import text
from noticeflow.functions import unicode_maps as um
from noticeflow.operators import search_index as sx

TEXTS = ["Aviso de ÑANDÚ", "a😀bc😀bc 𝒜b", "", None, "ab", "abc", "abcabcabc", "straße GRÜSSE", "каша の が 한국어", "x" * 400]


def listings(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "id long, titulo string").repartition(3).select(
        "id", "titulo", F.lit("").alias("entidad"), F.lit("z").alias("distrito"))


def test_postings_hold_every_trigram_of_every_text_once(spark, tmp_dir, monkeypatch):
    for chunk in (sx.CHUNK_CHARS, 20):
        monkeypatch.setattr(sx, "CHUNK_CHARS", chunk)
        root = sx.build(listings(spark), os.path.join(tmp_dir, f"index-{chunk}"))
        stored = sx.texts(spark, root).select("id", "block", "row", "hay").collect()
        assert sorted(r.id for r in stored) == list(range(len(TEXTS) * 3))
        want = sorted((g, r.block, r.row) for r in stored for g in {r.hay[i:i + 3] for i in range(len(r.hay) - 2)})
        lists = sx.postings(spark, root).collect()
        assert sorted((p.gram, p.block, n) for p in lists for n in p.rows) == want
        assert len({(p.gram, p.block) for p in lists}) == len(lists)
        assert all(p.rows == sorted(p.rows) for p in lists)
        for needle in ("ABC", "😀b", "ñandu", "s", "nothing like it", "がx"):
            key = spark.range(1).select(text.search_key(F.lit(needle))).first()[0]
            assert sorted(r.id for r in sx.search(spark, root, needle).collect()) == sorted(
                r.id for r in stored if key in r.hay)


def test_lists_are_gathered_before_the_shuffle(spark, tmp_dir):
    """A task sends a trigram's list once a chunk, not a row per text (40 equal texts)."""
    rows = spark.createDataFrame([(k, 0, "abcabd") for k in range(40)], "row long, block long, hay string")
    parts = rows.coalesce(1).select("block", "row", "hay").mapInArrow(sx._postings, sx.LISTS).collect()
    assert {p.gram: p.rows for p in parts} == {g: list(range(40)) for g in ("abc", "bca", "cab", "abd")}
    assert len(parts) == 4


def test_lists_with_more_letters_than_a_code_holds():
    size = 60_000
    points = np.concatenate([np.arange(32, 32 + size, dtype=np.uint32)] * 2)
    many = [points] * 30                                        # 60,000 ** 3 * 60 does not fit 63 bits
    flat, sizes = np.concatenate(many), np.full(60, size)
    count = Counter()
    for grams, ends, rows in sx._lists(flat, sizes, np.arange(60)):
        for gram, a, b in zip(grams[:5].tolist(), [0, *ends[:4].tolist()], ends[:5].tolist()):
            assert gram == [gram[0], gram[0] + 1, gram[0] + 2]
            count[gram[0]] += len(rows[a:b])
    assert count == {k: 60 for k in range(32, 37)}


def test_search_key_trims_the_ends_only(spark):
    rows = ["　Ñ \u0085", "﻿ é ", "が \x85", "ö"]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    assert [r[0] for r in df.select(text.search_key("s")).collect()] == ["n \u0085", "e", "が \x85", "o"]


def test_the_ranges_that_pick_long_keys_are_few():
    for _, _, multi in (um.key_maps(), um.search_maps()):
        wide = um.java_class([a for a, _ in multi], um.HULL_GAP)
        assert wide.count("-") <= 20 < um.java_class([a for a, _ in multi]).count("\\x")
