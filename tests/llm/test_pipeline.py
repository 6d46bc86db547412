import random


import __spark_entry__ as entry
import corpus_pipeline
from noticeflow.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, score int, block int"


def folder(spark, tmp_dir):
    """A small set of tables with every planted case."""
    rng = random.Random(12)
    words = ["".join(rng.choice(("ka", "lo", "min", "ter", "sa", "vo")) for _ in range(rng.randint(1, 4))) for _ in range(500)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    item = text(30)
    passage = text(20)
    rows, labels = [], []
    for i in range(150):
        t = text(rng.randint(40, 90))
        if i % 5 == 0:
            t += " nitwit blockhead " + text(5)
        labels.append((i, int(i % 5 == 0)))
        rows.append([i, t])
    rows[31][1] = rows[30 + 2][1]                                  # exact copy
    rows[33][1] = rows[34][1] + " tail"                            # near copy
    rows[36][1] += " " + item
    rows[41][1] += " " + passage
    rows[42][1] += " " + passage
    rows += [[200, None], [201, ""], [202, "short"], [None, text(10)]]
    full = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "k", k, k) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, DOCS).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    return rows, passage


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_dir):
    rows, passage = folder(spark, tmp_dir)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    kept = {}
    for n, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, tmp_dir)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_dir}/out{n}")
        docs = spark.read.parquet(f"{tmp_dir}/out{n}")
        kept[name] = {r.doc_id for r in docs.collect()}
    toxic = {i for i in range(0, 150, 5)}
    clean = {i for i, _ in rows} - toxic
    assert kept["toxicity"] == clean
    assert kept["near_duplicates"] == clean - {32, 34}
    assert kept["suffix_dedup"] == kept["near_duplicates"]
    assert kept["decontamination"] == kept["suffix_dedup"] - {36} == kept["mixing"]
    cut = spark.read.parquet(f"{tmp_dir}/out2")
    by = {r.doc_id: r for r in cut.collect()}
    assert passage in by[41].text and passage not in by[42].text
    assert by[200].text is None and by[42].n_chars == len(by[42].text) and by[41]._key == "k"


def test_run_applies_every_stage_and_is_registered(spark, tmp_dir):
    folder(spark, tmp_dir)
    out = corpus_pipeline.run(spark, tmp_dir)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() == 121
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_dir):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, toxic int"),
                         ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_dir}/{name}.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0


def test_every_number_has_one_query():
    numbers = [int(q[2:].split("_")[0]) for q in queries.QUERIES]
    assert numbers == list(range(1, 14))
    assert all(name in entry.queries() for name in queries.QUERIES)


def test_last_stage_gives_the_mixed_texts(spark, tmp_dir):
    rows, _ = folder(spark, tmp_dir)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    out = corpus_pipeline.mix_sources(spark, docs, tmp_dir)
    assert set(docs.columns) < set(out.columns)
    texts = dict(rows)
    for r in out.collect():
        assert len((r.text or "").split()) == r.taken and r._key == "k"
        assert all(line in texts[r.doc_id] for line in (r.text or "").splitlines())
        assert r.n_chars == (None if r.text is None else len(r.text))
