import corpus_pipeline
from cuelake.llm.common import staged

COLS = "doc_id long, text string, lang string, source string, n_chars long, row string, hits string"


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ne", "ru", "so"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_stages(spark, tmp_path):
    base, leak = words(1, 80), words(2, 40)
    near = base.replace(base.split()[40], "zzz", 1)
    line = "this passage of words comes again in several documents of the set"
    rows = [(1, base), (2, base), (3, near), (4, words(3, 30) + "\n" + line), (5, words(4, 30) + "\n" + line), (6, words(5, 20) + " " + leak), (7, None), (8, "12 34"), (None, words(6, 50)), (9, words(7, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "h") for i, t in rows], COLS)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert set(kept["language_id"]) == {1, 2, 3, 4, 5, 6, 9, None}
    assert set(kept["line_dedup"]) == {1, 3, 4, 5, 6, 9, None}  # 2 repeats 1
    assert line in kept["line_dedup"][4].text and line not in kept["line_dedup"][5].text
    assert kept["line_dedup"][5].n_chars == len(kept["line_dedup"][5].text)
    assert set(kept["near_dedup"]) == {1, 4, 5, 6, 9, None}
    assert set(kept["decontaminate"]) == {1, 4, 5, 9, None}
    assert set(kept["sentencepiece"]) == {1, 4, 5, 9, None}
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in kept["sentencepiece"].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["sentencepiece"])


def test_mixture_of_languages_stays(spark):
    parts = {"en": "the cat and the dog of this house with that other one ", "de": "der hund und die katze aus diesem haus mit einem anderen ", "ru": "кошка и собака из этого дома с другой старой деревни и поля "}
    rows = [(i, t * 8, lang) for i, (lang, t) in enumerate(parts.items())] + [(9, "".join(t * 3 for t in parts.values()), None), (10, "12 !", None)]
    given = spark.createDataFrame([(i, t, lang, "s", len(t), "r", "h") for i, t, lang in rows], COLS)
    found = corpus_pipeline.language_id(spark, given, "").collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 9}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], COLS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0
