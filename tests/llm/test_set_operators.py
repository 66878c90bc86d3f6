"""Brute-force tests of the joins, searches and the classifier."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.llm import jaccard, neighbours, setlinks, substrings, toxicity

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = rng.choice(WORDS)
    return " ".join(words)


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def closure(ids, links):
    least = {i: i for i in ids}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.id: r.component for r in setlinks.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == want
    assert setlinks.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_groups(spark, k, percent):
    base = [prose(n) for n in (3, 4, 5, 20, 60, 200, 200)]
    shared = prose(40)
    texts = [None, "", "  \n", "One two", "one TWO", *base, *base[:4]]
    texts += [changed(base[5], n) for n in (1, 2, 2, 3, 4, 5, 6, 8, 8, 10, 12)]
    chain = base[6]
    for _ in range(8):
        chain = changed(chain, 3)
        texts.append(chain)
    texts += [f"{shared} {prose(30)}" for _ in range(25)] + [f"{shared} {prose(3)}" for _ in range(10)]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, component_id string, n int")
    got = jaccard.jaccard_groups(docs, k=k, percent=percent).collect()
    assert len(got) == len(texts) + 1
    sets = [shingle_set(t, k) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = closure(range(len(texts)), links)
    assert len(set(want.values())) < len(texts) - 15
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0


def test_substring_dedup(spark):
    sentence = lambda n: prose(n).capitalize() + "."
    passages = [" ".join(sentence(rng.randint(5, 12)) for _ in range(7)) for _ in range(4)]
    rows, want = [], {}
    for i in range(40):
        text = [sentence(rng.randint(4, 14)) for _ in range(rng.randint(5, 30))]
        if i % 4 == 1:
            text.insert(rng.randrange(len(text)), passages[i // 4 % 4])
            want[i] = i // 4 % 4
        rows.append((i, ("\n" if i % 3 else " ").join(text), "same"))
    rows += [(100, None, ""), (101, "", ""), (102, "Too short.", ""), (103, "Too short.", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    found = substrings.repeated_paragraphs(docs)
    got = found.collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        text = rows[r.doc_id][1]
        first = min(i for i, p in want.items() if p == want[r.doc_id])
        assert r.keeper_doc_id == first and r.removed == (r.doc_id != first)
        assert text[r.start : r.stop] in passages[want[r.doc_id]] or not r.removed or len(text[r.start : r.stop].split()) >= 25
    cut = {r.doc_id: r for r in substrings.without_repeats(docs, found).collect()}
    assert len(cut) == len(rows) and all(r.start == rows[k][2] if k < 40 else True for k, r in cut.items())
    for i, text, _ in rows[:40]:
        if i not in want or i == min(j for j, p in want.items() if p == want[i]):
            assert cut[i].text == text
        else:
            assert len(cut[i].text.split()) <= len(text.split()) - 30
    assert substrings.repeated_paragraphs(docs.limit(0)).count() == 0


def test_substring_dedup_finds_repeats_wherever_sentences_end(spark):
    passages = [prose(50) for _ in range(30)]
    texts = [[prose(rng.randint(60, 150)), p, prose(rng.randint(60, 150))] for p in passages * 2]
    texts[7][0], texts[8][2] = "", ""  # at a text's start and end
    texts += [["word " * 500], ["word " * 300], [prose(300)], [prose(24)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = substrings.repeated_paragraphs(docs)
    for r in found.collect():
        assert r.doc_id < 62
        own = " ".join(texts[r.doc_id])[r.start : r.stop]
        assert r.n_words == len(own.split()) and (r.doc_id >= 60 or own in passages[r.doc_id % 30])
        assert r.keeper_doc_id == (60 if r.doc_id >= 60 else r.doc_id % 30) and r.removed == (r.doc_id != r.keeper_doc_id)
    cut = {r.doc_id: r.text for r in substrings.without_repeats(docs, found).collect()}
    for i, t in enumerate(texts):
        words, left = " ".join(t).split(), cut[i].split()
        if 30 <= i < 60:
            assert len(words) - 50 <= len(left) <= len(words) - 25
            assert " ".join(left).startswith(" ".join(t[0].split())) and " ".join(left).endswith(" ".join(t[2].split()))
        elif i != 61:
            assert cut[i] == " ".join(t)
    assert len(cut[61].split()) < 50


def test_nearest_neighbours(spark):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(1500, 24)).astype("<f4")
    x[200:700] = x[200]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    rows += [(5000, None, 0), (5050, [0.0] * 24, 0), (5100, [float("nan")] * 24, 0), (5150, [None] * 24, 0), (5200, [1.0], 0), (5250, [float("inf")] * 24, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    got = neighbours.nearest_neighbours(table, table.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 50))
    y = x.astype(float)
    norms = np.linalg.norm(y, axis=1)
    hits = 0
    for q, found in by.items():
        scores = y @ y[q] / norms / norms[q]
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in found)
        scores[q] = -2
        want = np.lexsort((np.arange(len(scores)), -np.round(scores, 12)))[:5].tolist()
        hits += len(set(want) & {r.vec_id for r in found})
        if 200 <= q < 700:
            assert [r.vec_id for r in found] == want
    assert hits >= 0.9 * 5 * len(by)
    few = neighbours.nearest_neighbours(table.where("vec_id < 3"), table.where("vec_id = 0")).collect()
    assert {r.vec_id for r in few} == {1, 2}
    assert neighbours.nearest_neighbours(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["groups", "cone", "outliers"])
def test_nearest_neighbours_of_rows_that_codes_tell_badly_apart(spark, kind):
    gen = np.random.default_rng(4)
    x = gen.normal(size=(3000, 24))
    if kind == "groups":  # hundreds of rows that nearly agree
        x = x[gen.integers(0, 6, 3000)] + 1e-3 * gen.normal(size=(3000, 24))
    elif kind == "cone":
        x = 0.01 * x + 5.0
    else:  # a few rows decide what codes are fitted to
        x[::7, 0] *= 1e6
    x = x.astype("<f4")
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest_neighbours(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(set(np.argsort(-scores)[:5].tolist()) & got[q])
    assert hits >= 0.99 * 5 * 60


def test_subsequence_kernel():
    def slow(s, t):
        total = 0.0
        for a in itertools.combinations(range(len(s)), 3):
            for b in itertools.combinations(range(len(t)), 3):
                if [s[i] for i in a] == [t[j] for j in b]:
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    for s, t in [("idiot", "idxiot"), ("abcab", "bacab"), ("ab", "abc"), ("", "abc"), ("stupid", "stupid")]:
        assert toxicity.subsequence_kernel(s, t) == pytest.approx(slow(s, t))


def value(marks, word, j):
    """The kernel value of a word with a landmark: the root of its power, which is kept."""
    return float(marks.values[marks.known[word], j]) ** (1 / toxicity.POWERS[0])


def test_weak_kernel_values_reach_the_features():
    insults = ["trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"]
    marks = toxicity.Landmarks(insults)
    for j, word in enumerate(insults):
        for gaps in (1, 2, len(word) - 1):
            text = "x".join(word[:gaps]) + "x" + word[gaps:]
            marks.learn({text})
            want = toxicity.subsequence_kernel(text, word) / (marks.norms[j] * toxicity.subsequence_kernel(text, text) ** 0.5)
            assert want > 0 and value(marks, text, j) == pytest.approx(want, rel=1e-4)
            assert np.abs(marks.features([text]) - marks.features([""])).max() > 0.01
    # No kernel value is left out, whatever letters the word lacks.
    for text, word, least in (("stupid", "stupidly", 0.77), ("scoundr", "scoundrels", 0.75), ("moron", "moronic", 0.67), ("blockhd", "blockheads", 0.63)):
        marks = toxicity.Landmarks([word])
        marks.learn({text})
        assert value(marks, text, 0) > least
    for text in {prose(1) for _ in range(300)} | {"a", "ab", "aaa", "ababab", "été"}:
        marks = toxicity.Landmarks(["abcab", "hgfed"])
        marks.learn({text})
        own = toxicity.subsequence_kernel(text, text)
        for j, word in enumerate(marks.strings):
            assert value(marks, text, j) == pytest.approx(toxicity.subsequence_kernel(text, word) / (marks.norms[j] * own**0.5) if own else 0.0, rel=1e-4, abs=1e-6)


def test_pipeline_rejects_what_op8_predicts(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from stockweave.llm import queries

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(11)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = F.regexp_extract("text", "[0-9]+", 0).cast("double") / 10
    monkeypatch.setattr(toxicity, "fit", lambda rows: None)
    monkeypatch.setattr(toxicity, "score_documents", lambda docs, model, keep=False: docs.withColumn("toxicity" if keep else "score", score))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in queries.op8_toxicity(spark, str(tmp_path)).collect() if not r.predicted} == {0, 1, 2}


def test_long_words_and_runs_are_compared_in_pieces():
    marks = toxicity.Landmarks(["idiot", "stupid", "disgusting"])
    run = "everybodyknowsthatyouareanidiotandthatisallthereistosayhere"
    filler = "".join(chr(0x4E00 + i) for i in range(3000))
    for text in (run, " ".join(run), run[:26] + "idiot", "idiot" + run[31:], filler + "idiot" + filler):
        (word,) = [w for w in toxicity.words_of(text) if len(w) > 4]
        marks.learn({word})
        assert value(marks, word, 0) > 0.25
    marks.learn({"youarestupidandatrashmoron"})
    assert value(marks, "youarestupidandatrashmoron", 1) > 0.36  # the whole has 0.345
    assert marks._pieces("a" * 20) == ["a" * 20]
    for n in (21, 40, 41, 97):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        assert all(any(word[i : i + 10] in p for p in marks._pieces(word)) for i in range(n - 9))


def test_toxicity_on_held_out_texts(spark):
    insults = ["blockhead", "nitwit", "scoundrel"]
    rows = []
    for i in range(600):
        words = prose(40).split()
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.where("doc_id < 400"))
    scores = {r.doc_id: r.score for r in toxicity.score_documents(table.where("doc_id >= 400").select("doc_id", "text", F.lit("x").alias("score")), model).collect()}
    assert np.mean([(scores[i] >= 0.3) == (i % 3 == 0) for i in range(400, 600)]) > 0.97
    odd = [None, "", prose(30), prose(20) + " you nit.wit and block-head, scoxundrel", prose(20) + " n i t w i t n i t w i t nitxwit"]
    got = {r.doc_id: r.score for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    assert got[0] == got[1] < 0.3 and got[2] < 0.3 < min(got[3], got[4])
    alike = toxicity.fit(table.where("toxic = 0"))
    assert {r.score for r in toxicity.score_documents(table.limit(5), alike).collect()} == {alike.score("")}
    assert toxicity.score_documents(table.limit(0), model).count() == 0
