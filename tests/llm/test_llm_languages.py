"""Rank-order profiles against plain counting, and accuracy on rows that were held out."""

from collections import Counter

import pytest
from conftest import SF_DIR
from llm_support import documents
from pyspark.sql import functions as F

from turnscope.llm import language_profiles as L


def plain_counts(text):
    framed = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for word in framed:
        letters = [1, *map(ord, word), 1]
        for size in (1, 2, 3):
            for i in range(len(letters) - size + 1):
                if size > 1 or letters[i] != 1:
                    gram = tuple(letters[i:i + size])
                    if size < 3 or gram[1] != 1:
                        out[gram] += 1
    return out


def ranked(counts, grams):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:grams]


def plain_nearest(profiles, text, grams):
    top = ranked(plain_counts(text), grams)
    if not top or not profiles:
        return L.UNKNOWN, 0.0
    apart = {}
    for language, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        apart[language] = sum(abs(place[g] - i) if g in place else grams for i, g in enumerate(top))
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (len(top) * grams)


TEXTS = ["", "a", "Der Hund, der bellt!", "the cat sat on the mat", "él niño está", "123 ... 456", "x" * 500, "ǅ ß ſ 𝒳 日本語 日本",
         "one two three " * 50, "�\u0000 áb"]


def test_counts(monkeypatch):
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(L, "PIECE", piece)
        for text in TEXTS:
            kinds, counts = L.gram_counts(text.encode())
            expected = {sum(c << L.BITS * i for i, c in enumerate(reversed(g))): n for g, n in plain_counts(text).items()}
            assert dict(zip(kinds.tolist(), counts.tolist())) == expected


@pytest.mark.parametrize("grams", [5, 400])
def test_nearest_language(spark, grams):
    taught = [(i, t * 2, lang) for i, (t, lang) in enumerate(
        [(TEXTS[2], "de"), (TEXTS[3], "en"), (TEXTS[4], "es"), ("die Katze und das Haus", "de"), ("a dog and a house", "en")] * 5)]
    docs = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    options = L.FitOptions(texts=10 ** 9, grams=grams)
    held = {r.doc_id for r in docs.where(L.held_out()).collect()}
    counts = {}
    for i, text, lang in taught:
        if i not in held:
            counts.setdefault(lang, Counter()).update(plain_counts(text))
    profiles = {lang: ranked(c, grams) for lang, c in counts.items()}
    asked = documents(spark, [*TEXTS, None]).withColumns({"lang_pred": F.lit("x"), "score": F.lit(7), "held_out": F.lit("y")})
    got = {r.doc_id: r for r in L.identify(asked, L.fit(docs, options)).collect()}
    for i, text in enumerate([*TEXTS, None]):
        language, score = plain_nearest(profiles, text or "", grams)
        assert got[i].lang_pred == language and got[i].score == pytest.approx(score)


def test_nothing_learned_and_repeated_ids(spark):
    docs = documents(spark, [(1, "hello"), (1, None), (None, "x"), (2, "hello")])
    got = L.identify(docs, L.fit(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 4
    assert L.identify(documents(spark, []), L.fit(documents(spark, []))).count() == 0
    rows = [(1, "b", "de"), (1, "a", "de"), (1, "c", "en"), (None, "d", "en")]
    twice = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert not twice.where("doc_id = 1").where(L.held_out()).count()
    assert [tuple(r) for r in L.sample(twice, L.FitOptions()).collect()] == [("de", "a")]


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    held = L.op13_language(spark, SF_DIR).where("held_out").join(truth, "doc_id")
    right, rows = held.agg(F.sum((F.col("truth") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows and right / rows >= 0.97
