"""The corpus pipeline on a small corpus whose outcome is known."""

import random

from pyspark.sql import functions as F

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_stages_keep_clean_documents_and_catch_the_rest(spark, tmp_path):
    import corpus_pipeline

    clean = {i: prose(120) for i in range(1, 41)}
    texts = dict(clean)
    base = prose(200)
    words = base.split()
    words[20] = "changed"
    texts |= {50: base, 51: base, 52: " ".join(words)}
    passage = prose(60)
    texts |= {60: f"{prose(80)} {passage} {prose(80)}", 61: f"{prose(90)} {passage} {prose(70)}"}
    texts |= {70: prose(60) + " password = hunter2secret and " + "0123456789abcdef" * 2}
    for i in range(100, 160):
        own = prose(40).split()
        for _ in range(4):
            own.insert(rng.randrange(len(own)), rng.choice(["blockhead", "nitwit", "scoundrel"]))
        texts[i] = " ".join(own)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(80, None, "en", "s", 0), (81, "", None, None, 0), (None, prose(50), "en", "s", 1), (1, clean[1], "en", "s", 1), (2, "zzz " + clean[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, int(i >= 100)) for i in texts if i < 41 or i >= 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    seen = spark.read.parquet(f"{tmp_path}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    after = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen = stage(spark, seen, str(tmp_path))
        seen.write.parquet(f"{tmp_path}/{n}")
        seen = spark.read.parquet(f"{tmp_path}/{n}")
        after[name] = seen.collect()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert seen.columns == list(corpus_pipeline.COLUMNS)
    ids = {name: {r.doc_id for r in found} for name, found in after.items()}
    assert ids["toxicity"] == (set(texts) | {80, 81, None}) - set(range(100, 160))
    assert ids["jaccard_join"] == ids["toxicity"] - {51, 52}
    one = {r.doc_id: r.text for r in after["jaccard_join"]}
    assert len(one) == len(after["jaccard_join"]) and one[2] == min(clean[2], "zzz " + clean[2])  # of two texts of an id the first
    cut = {r.doc_id: r for r in after["substring_dedup"]}
    assert all(cut[i].text == one[i] for i in one if i != 61)
    assert len(cut[61].text.split()) <= len(texts[61].split()) - 38 and cut[61].n_chars == len(cut[61].text)
    masked = {r.doc_id: r.text for r in after["secret_scan"]}
    assert "hunter2" not in masked[70] and "0123456789abcdef" not in masked[70] and masked[80] == ""
    assert all(masked[i] == (cut[i].text or "") for i in masked if i != 70)
    assert ids["packing"] == ids["jaccard_join"] and {r.doc_tokens for r in after["packing"] if r.doc_id in (80, 81)} == {1}
    for r in spark.createDataFrame(after["packing"]).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect():
        assert r.n <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after["packing"])


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).count() == 0
