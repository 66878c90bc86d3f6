"""Merkle manifests, vector codes and language identification against brute force, with their edge cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockweave.llm import codes, languages, merkle, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, str(DATA))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


# --- Merkle manifests


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes):
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0]


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(5)
    sizes = ((None, 18), ("a", 1), ("b", 16), ("c", 17), ("d", 290), ("é", 3), ("Z", 257))
    rows = [(rng.randrange(n) if i % 7 else None, source, None if i % 11 == 0 else f"text {i % 5}", 0, "clash") for source, n in sizes for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("levels", "top_rows"), [(3, 4096), (2, 3), (1, 2)])
def test_every_proof_leads_to_the_root(spark, leaves, levels, top_rows):
    """With few rows for the driver, blocks are reduced again and again, and the sources' roots like leaves."""
    df = spark.createDataFrame(leaves, "doc_id long, source string, text string, pos int, root string").repartition(3)
    df = df.withColumn("leaf", merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text")))
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for doc_id, source, text, *_ in leaves:
        trees[source].append(((doc_id is not None, doc_id or 0), digest(part(doc_id) + part(source) + part(text))))
    roots = {s: reduced([d for _, d in sorted(v)]) for s, v in trees.items()}
    root = reduced([roots[s] for s in sorted(roots, key=lambda s: (s is not None, (s or "").encode()))])
    made = merkle.manifest(df, tree="source", order=["doc_id"], leaf="leaf", levels=levels, top_rows=top_rows)
    assert made.columns == ["doc_id", "source", "text", "pos", "leaf", "proof", "subroot", "root"]
    got = made.withColumns({"folded": merkle.folded(F.col("leaf"), F.col("proof")), "wrong": merkle.folded(F.sha2("leaf", 256), F.col("proof"))}).collect()
    assert Counter((r.doc_id, r.source, r.text, r.leaf) for r in got) == Counter((i, s, t, digest(part(i) + part(s) + part(t))) for i, s, t, *_ in leaves)
    assert {(r.source, r.subroot) for r in got} == set(roots.items())
    assert {r.root for r in got} == {r.folded for r in got} == {root}
    assert all(r.wrong != root for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    rows = spark.createDataFrame([(1, "s")], "doc_id long, source string").withColumn("leaf", merkle.leaf_digest(F.col("doc_id")))
    (one,) = merkle.manifest(rows, tree="source", order=["doc_id"], leaf="leaf").collect()
    assert one.proof == [] and one.leaf == one.subroot == one.root == digest("1:1")
    assert merkle.manifest(rows.limit(0), tree="source", order=["doc_id"], leaf="leaf").count() == 0


# --- vector codes


def lloyd(vectors, parts, entries, rounds, scale):
    """All distances in every round, in Python's whole numbers."""
    points = [[math.floor(x * scale) for x in v] for _, _, v in vectors]
    width = len(points[0]) // parts
    cut = lambda p, k: p[k * width : (k + 1) * width]
    firsts = {}
    for (i, _, v), p in zip(vectors, points, strict=True):
        if i is not None and (i not in firsts or v < firsts[i][0]):
            firsts[i] = (v, p)
    seeds = [firsts[i][1] for i in sorted(firsts)[:entries]]
    books = [[cut(s, k) for s in seeds] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        codes_ = [[min(range(len(books[k])), key=lambda j: (far(cut(p, k), books[k][j]), j)) for k in range(parts)] for p in points]  # noqa: B023
        if r < rounds:
            for k in range(parts):
                for j in range(len(books[k])):
                    own = [cut(p, k) for p, c in zip(points, codes_, strict=True) if c[k] == j]
                    if own:
                        books[k][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return codes_, [sum(far(cut(p, k), books[k][c[k]]) for k in range(parts)) for p, c in zip(points, codes_, strict=True)], books


def test_codes_equal_brute_force(spark):
    """Ties, repeated rows and ids, vectors left out, a hot label and columns with other names."""
    rng = random.Random(3)
    vectors = [(rng.choice([i, i, 7, None]) if i % 9 == 0 else i, None if i % 3 else i % 5, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(260)]
    vectors += vectors[:30]
    left_out = [(-1, 1, None), (-2, 1, []), (-3, 1, [1.0] * 5 + [None]), (-4, 1, [1.0] * 5 + [math.nan]), (-5, 1, [1.0] * 5 + [-math.inf]), (900, 1, [1.0] * 4)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors + left_out], "vec_id long, label int, embedding array<float>, points int, ids string").repartition(4)
    made, books = codes.compress(df, parts=3, entries=5, rounds=4, scale=16)
    narrow = [(i, label, np.float32(v).astype(float).tolist()) for i, label, v in vectors]
    want_codes, want_error, want_books = lloyd(narrow, 3, 5, 4, 16)
    assert books.tolist() == want_books
    want = Counter((i, None if label is None else str(label), tuple(c), e) for (i, label, _), c, e in zip(narrow, want_codes, want_error, strict=True))
    assert Counter((r.id, r.label, tuple(r.codes), r.error) for r in made.collect()) == want
    sums = Counter()
    for (_, label, _, error), n in want.items():
        sums[label] += error * n
    for most in (100, 0):  # broadcast, and dealt out
        got = codes.with_group_sums(made, "label", "error", "total", most=most, salts=3).collect()
        assert len(got) == len(vectors) and {(r.label, r.total) for r in got} == set(sums.items())


def test_codes_of_few_or_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    made, books = codes.compress(spark.createDataFrame([(4, None, [0.5, 1.0]), (2, None, [0.0, 0.0])], schema), parts=2)
    assert books.tolist() == [[[0], [2048]], [[0], [4096]]]
    assert sorted(map(tuple, made.collect())) == [(2, None, [0, 0], 0), (4, None, [1, 1], 0)]
    for rows in ([], [(None, 1, [1.0, 2.0])], [(1, 1, [1.0, 2.0, 3.0])]):
        assert codes.compress(spark.createDataFrame(rows, schema), parts=2)[0].count() == 0


def test_only_what_drift_has_passed_is_popped():
    heaps = codes.Heaps.of(np.array([0, 1, 0, 1, 2]), np.arange(5), np.array([5.0, 1.0, 2.0, 4.0, 0.0]), 3)
    members, had = heaps.pop(np.array([2.0, 0.5, 1.0]))
    assert members.tolist() == [2, 4] and had.tolist() == [0, 2]
    heaps = heaps.push(np.array([1, 1]), members, np.array([2.5, 9.0]))
    assert heaps.order.tolist() == [0, 1, 2, 3, 4] and heaps.entries().tolist() == [0, 1, 1, 1, 1]


# --- language identification


def code_length(text, samples, order):
    """Bits of a text after prediction by partial matching on the samples, byte by byte."""
    after = defaultdict(Counter)
    for sample in samples:
        data = b" " * order + sample.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                after[data[i - k : i]][data[i]] += 1
    data, bits = b" " * order + text.encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = after.get(data[i - k : i])
            if not seen:
                continue
            every = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / every)
                break
            bits -= math.log2(len(seen) / every)
        else:
            bits += 8
    return bits


SAMPLES = {"aa": ["the cat sat on the mat", "a theatre that thaws"], "bb": ["der Hund und die Katze sind müde", "und dann der Mond"], "cc": ["zzz", "z"]}


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths_equal_brute_force(spark, order):
    rows = [(lang, t) for lang, texts in SAMPLES.items() for t in texts for _ in range(2)] + [(None, "no language"), ("dd", None), ("dd", "123 !")]
    model = languages.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3), order=order)
    assert model.languages == ["aa", "bb", "cc"]
    texts = ["the mad hatter", "der Käse", "", "quer durch ☃ and back", "z", "the " * 50_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in languages.predict(docs, model).collect():
        want = [code_length(texts[r.doc_id], SAMPLES[lang], order) for lang in model.languages]
        assert r.bits == pytest.approx(want, rel=1e-4, abs=1e-2)
        if texts[r.doc_id]:
            assert r.lang_pred == model.languages[int(np.argmin(want))]
            assert r.score == pytest.approx(1 / sum(2 ** max(min(want) - w, -1000) for w in want), abs=1e-2)


def test_texts_longer_than_a_step_add_up(monkeypatch):
    counts = {}
    for k in range(3):
        keys, n = np.unique(languages.grams(languages.padded(pa.array(["abracadabra" * 9]), 2)[0][2 - k :], k + 1), return_counts=True)
        counts["x", k] = keys, n
    model = languages.Model(["x"], 2, counts)
    texts = pa.array(["abra" * 40, None, "", "cadabra", "q" * 30])
    whole = model.totals(texts)
    for step in (1, 7, 33):
        monkeypatch.setattr(languages, "STEP", step)
        assert (model.totals(texts) == whole).all()


def test_undetermined_texts_and_an_empty_model(spark):
    model = languages.fit(spark.createDataFrame([("aa", "words"), ("bb", "other")], "lang string, text string"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 + 3"), (4, "é"), (None, "words"), (None, "words")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in languages.predict(docs, model).collect())
    assert [g[1] for g in got] == ["aa", "aa", "und", "und", "und", "aa"] and [g[2] for g in got[2:5]] == [0, 0, 0]
    assert all(0 < g[2] <= 1 for g in got if g[1] != "und")
    assert languages.predict(docs.limit(0), model).count() == 0
    none = languages.fit(spark.createDataFrame([(None, "words")], "lang string, text string"))
    assert {(r.lang_pred, r.score) for r in languages.predict(docs, none).collect()} == {("und", 0.0)}


def test_held_out_documents_are_told_apart(spark):
    made = queries.op13_language_id(spark, str(DATA.parent / "sf0.01"))
    truth = spark.read.parquet(str(DATA.parent / "sf0.01" / "documents.parquet")).select("doc_id", "lang")
    rows = made.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
