"""Spelling variants against all pairs, and SQL."""

import random
import re
import zlib
from collections import Counter

from compare import assert_same
from conftest import SF_DIR
from llm_support import documents
from pyspark.sql import functions as F

from turnscope.llm import spelling as S

RUNS = re.compile(S.RUN)
LOWERED = str.maketrans(S.UPPER, S.LOWER)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def plain(uses):
    near = {w: [x for x in uses if one_edit(w, x)] for w in uses}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-uses[x], x), default=None)
        form[w] = best if best is not None and uses[best] >= 2 * uses[w] else None

    def root(w):
        return root(form[w]) if form[w] is not None else w

    return {(w, form[w], root(w), uses[w], len(near[w]), uses.get(form[w])) for w in uses}


def vocabulary(spark, uses):
    rows = [(i, w, uses[w]) for i, w in enumerate(sorted(uses))]
    return spark.createDataFrame(rows, "no long, word string, n long")


def test_all_pairs(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(300)}
    for size in (62, 63, 64, 65, 66, 400):  # around the length from which stems are hashed
        long = "".join(rng.choice("abc") for _ in range(size))
        words |= {long, long[:9] + long[10:], long[:30] + "ÿ" + long[31:], long + "a", "b" + long, long[1:] + long[0]}
    uses = {w: rng.choice([3, 4, 6, 12, 30, 70]) for w in words}
    got = {tuple(r) for r in S.grouped(vocabulary(spark, uses)).collect()}
    assert got == plain(uses)


def test_chain_of_forms_and_runs_of_a_letter(spark):
    uses = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "baaaaaa": 24, "baaaaaaa": 48, "xxxxx": 5, "caaaaaaa": 48}
    got = {r.word: r for r in S.grouped(vocabulary(spark, uses)).collect()}
    assert {tuple(r) for r in got.values()} == plain(uses)
    assert got["aaaaa"].root == "baaaaaaa" and got["aaaaaa"].n_near == 3 and got["xxxxx"].n_near == 0


def test_words_counts_and_damage(spark):
    texts = [(1, "Étude Word wordy WORDY wordy× word1wordy"), (2, None), (3, ""), (None, "nullid nullid nullid"),
             (3, "wordz " * 400), (3, "wordz " * 400)]
    uses = Counter()
    for doc, text in texts:
        for run in RUNS.findall(text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            uses[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    docs = documents(spark, texts).withColumns({"word": F.lit("w"), "n": F.lit(1), "run": F.lit("r"), "id": F.lit("i")})
    got = {r.word: r.n for r in S.vocabulary(S.words_of(docs, typo_every=97)).collect()}
    assert got == {w: n for w, n in uses.items() if len(w) >= 5 and n >= 3}
    assert S.grouped(S.vocabulary(S.words_of(documents(spark, [])))).count() == 0


def test_very_long_word_costs_its_length(spark):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    other = word[:50_000] + "z" + word[50_001:]
    got = {r.word: r.n_near for r in S.grouped(vocabulary(spark, {word: 3, other: 9, word[1:]: 3})).collect()}
    assert got == {word: 2, other: 1, word[1:]: 1}


def test_query_matches_sql(spark, duck):
    assert_same(S.op12_spelling(spark, SF_DIR), duck, S.SQL)
