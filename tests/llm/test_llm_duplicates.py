"""Line dedup, sentence spans, the Jaccard join and decontamination against brute force."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from compare import assert_same
from conftest import SF_DIR
from llm_support import documents, jaccard, shingles

from turnscope.llm import decontaminate, hashing, jaccard_join, line_dedup, sentence_spans
from turnscope.llm.components import components
from turnscope.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert_same(queries()[name](spark, SF_DIR), duck, oracle_sql()[name])


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_line_dedup_cases(spark):
    rows = [(i, f"own {i}\n menu \n\nown line {i}", "a") for i in range(8)] + [(i, f"solo {i}\nmenu", None) for i in range(8, 14)]
    rows += [(20, None, "a"), (21, "", "a"), (22, "menu", "b"), (0, "own 0\n menu \n\nown line 0", "a"), (None, "menu\nmenu", "a")]
    docs = documents(spark, rows).selectExpr("*", "'h' as host", "1 as `row`", "2 as `keys`", "3 as kept")
    cut = line_dedup.dedup_lines(docs).select("row.doc_id", "row.source", "n_lines", "n_dropped", "text").collect()
    assert len(cut) == len(rows)
    got = {(r.doc_id, r.source): (r.n_lines, r.n_dropped, r.text) for r in cut}
    assert got[1, "a"] == (4, 1, "own 1\n\nown line 1")
    assert got[9, None] == (2, 1, "solo 9")
    assert got[20, "a"] == (0, 0, None) and got[21, "a"] == (1, 0, "") and got[22, "b"] == (1, 0, "menu")
    assert got[None, "a"] == (2, 2, "")
    back = line_dedup.without_boilerplate(docs)
    assert back.columns == docs.columns and {r.n_chars for r in back.where("doc_id = 9").collect()} == {6}
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def plain_sentences(text):
    out = []
    for line in re.findall(r"[^\n]+", text or ""):
        out += re.split(r"(?<=[.!?])[ \t\v\f\r]", line)
    return [s for s in (x.strip(" \t\v\f\r") for x in out) if s]


def plain_spans(rows):
    """Sentences removed from each (id, text) in the order of ids."""
    first, gone = {}, defaultdict(set)
    for i, text in rows:
        s = plain_sentences(text)
        n = [len(x.split()) for x in s]
        spans = set()
        for a in range(len(s)):
            spans |= {(a, b) for b in range(a + 2, len(s) + 1) if sum(n[a:b]) >= 20 and (b == a + 2 or sum(n[a : b - 1]) < 20)}
            spans |= {(b, a + 1) for b in range(a) if sum(n[b : a + 1]) >= 20 and (b == a - 1 or sum(n[b + 1 : a + 1]) < 20)}
        for a, b in sorted(spans):
            if first.setdefault(tuple(s[a:b]), (i, a)) != (i, a):
                gone[i] |= set(range(a, b))
    return gone


def test_sentence_spans(spark):
    rng = random.Random(3)
    passage = ". ".join(prose(rng, 11) for _ in range(5)) + "."
    texts = [f"{prose(rng, 30)}. {passage} {prose(rng, 9)}!\nÜber {prose(rng, 12)}?" for _ in range(6)]
    texts += [None, "", " \n ", "One. Two. Three.", f"{passage}\n{passage}", passage, prose(rng, 60_000), "a.b c! d? e.\n" * 30]
    rows = list(enumerate(texts))
    docs = documents(spark, [*rows, rows[2]]).selectExpr("*", "1 as gone", "2 as page", "3 as n_removed")
    got = sentence_spans.dedup_spans(docs).collect()
    assert len(got) == len(texts) + 1
    gone = plain_spans(rows)
    for r in got:
        before = plain_sentences(texts[r.doc_id])
        assert (r.n_sentences, r.n_removed) == (len(before), len(gone[r.doc_id]))
        assert plain_sentences(r.text) == [s for i, s in enumerate(before) if i not in gone[r.doc_id]]
    assert gone[1] and gone[11] and not gone[0] and not gone[9]
    assert next(r.text for r in got if r.doc_id == 6) is None
    assert sentence_spans.dedup_spans(documents(spark, [])).count() == 0


def test_sentence_spans_of_one_sentence(spark):
    rng = random.Random(8)
    long, bare, han = prose(rng, 60), prose(rng, 25), "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(60))
    hindi = [f"{prose(rng, 12)}।" for _ in range(3)]
    chinese = [f"{han[i : i + 15]}。" for i in range(0, 60, 15)]
    texts = [f"{prose(rng, 9)}. {long}. {prose(rng, 9)}." for _ in range(3)]  # between sentences of their own
    texts += [bare, bare, f"{prose(rng, 9)}. {bare}. {prose(rng, 9)}."]  # copies without stops; a short sentence
    texts += [prose(rng, 9) + "।" + "".join(hindi) + prose(rng, 9) for _ in range(2)]
    texts += [f"前{i}。" + "".join(chinese) + f"{i}後！！" for i in range(2)]
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentence_spans.dedup_spans(documents(spark, texts)).collect()}
    assert [got[i][:2] for i in range(len(texts))] == [(3, 0), (3, 1), (3, 1), (1, 0), (1, 1), (3, 0), (5, 0), (5, 3), (6, 0), (6, 4)]
    assert long not in got[1][2] and long not in got[2][2] and got[4][2] == "" and got[9][2] == "前1。1後！！"


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def near_texts():
    rng = random.Random(5)
    base = prose(rng, 160)
    texts = [edited(rng, base, rng.randrange(0, 5)) for _ in range(60)] + [base] * 4
    for n in (1, 3, 5, 40, 300, 3000):
        other = prose(rng, n)
        texts += [other, other + " ", edited(rng, other, max(1, n // 60)) if n > 5 else other + "x"]
    return [*texts, None, "", " ", None, *[prose(rng, 80) for _ in range(30)]]


def plain_classes(rows, threshold=0.8):
    """Class id, links to documents and to other texts of every row."""
    ids, sets = defaultdict(list), {}
    for i, text in rows:
        ids[text or ""].append(i)
        sets[text or ""] = shingles(text)
    texts = [t for t in ids if sets[t]]
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    links = defaultdict(list)
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(sets[texts[a]], sets[texts[b]]) >= threshold:
                links[texts[a]].append(texts[b])
                links[texts[b]].append(texts[a])
                root[top(texts[a])] = top(texts[b])
    least = defaultdict(lambda: 10**9)
    for t in texts:
        least[top(t)] = min(least[top(t)], *ids[t])
    out = {}
    for t, own in ids.items():
        for i in own:
            out[i] = (least[top(t)], len(own) - 1 + sum(len(ids[x]) for x in links[t]), len(links[t])) if sets[t] else (i, 0, 0)
    return out


@pytest.mark.parametrize("block", [128, 7])
def test_jaccard_join_equals_brute_force(spark, tmp_path, block):
    rows = list(enumerate(near_texts()))
    docs = documents(spark, rows).selectExpr("*", "1 as key", "2 as sig", "3 as root")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = jaccard_join.similar(docs, jaccard_join.JoinOptions(block=block, recall=0.99999)).collect()
    want = plain_classes(rows)
    by_id = {r.id: r for r in known}
    for i, (cls, links, texts) in want.items():
        if i in by_id:
            assert (by_id[i].copies - 1 + by_id[i].docs, by_id[i].texts) == (links, texts)
    query = {r.doc_id: tuple(r)[1:] for r in queries()["op1_jaccard_join"](spark, str(tmp_path)).collect()}
    assert sum(query[i] != want[i] for i in want) <= 2  # the target recall is below one
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[0] == i)


def test_one_of_each_with_odd_rows(spark):
    text = prose(random.Random(1), 50)
    rows = [(5, text), (5, text), (None, text), (5, "different words here"), (None, "alone in the world"), (None, None), (7, text + " tail")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([(5, text), (5, "different words here"), (None, "alone in the world"), (None, None)], key=str)
    assert jaccard_join.one_of_each(documents(spark, [])).count() == 0


def test_buckets_are_prefixes(spark):
    """A bucket is its tree and its prefix, not a hash of them: members differ in neither."""
    options = jaccard_join.JoinOptions()
    texts = [t for t in near_texts() if (t or "").strip()]
    signed = [(bytes([i]), s) for i, s in enumerate(jaccard_join.signatures([t.encode() for t in texts], options))]
    sigs = dict(signed)
    rows = jaccard_join.fresh_buckets(spark.createDataFrame(signed, "key binary, sig binary"), 3, None, options).collect()
    assert rows
    for r in rows:
        at = r.tree * 2 * options.depths[0]
        assert bytes(r.bucket) == bytes([r.tree]) + sigs[bytes(r.key)][at : at + 6]


def test_jaccard_join_looks_for_a_lone_pair_at_the_threshold(spark):
    """A pair of similarity 0.8 that shares no prefix of five values, in production options."""
    rng = random.Random(4)
    options = jaccard_join.JoinOptions()
    pairs = []
    for _ in range(3000):
        w = prose(rng, 49).split()
        pairs.append((" ".join(w), " ".join([*w[:24], "other", *w[25:]])))
    signed = jaccard_join.signatures([t.encode() for p in pairs for t in p], options)
    sigs = np.frombuffer(b"".join(signed), ">u2").reshape(len(pairs), 2, options.trees, -1)
    same = sigs[:, 0] == sigs[:, 1]
    deepest = next(d for d in options.depths if options.found(options.threshold, d) >= options.recall)
    met = same[:, :, :deepest].all(axis=2).any(axis=1)
    assert met.mean() >= 0.999  # measured at the threshold, where a link is hardest to find
    missed = ~same.all(axis=2).any(axis=1) & met
    pair = pairs[np.flatnonzero(missed)[0]]
    assert jaccard(shingles(pair[0]), shingles(pair[1])) == 0.8
    assert {r.texts for r in jaccard_join.similar(documents(spark, pair)).collect()} == {1}


def test_pipeline_keeps_one_of_exact_copies(spark):
    """Copies that are a large share of their host, and rows that come without words."""
    rng = random.Random(6)
    text = f"{prose(rng, 20)}\n{prose(rng, 20)}"
    rows = [(i, text) for i in range(8, 2, -1)] + [(20 + i, f"menu\n{prose(rng, 30)}") for i in range(6)]
    rows += [(50, None), (40, ""), (41, ""), (42, " "), (None, " "), (42, " ")]
    cut = corpus_pipeline.lines(spark, documents(spark, rows), SF_DIR)
    kept = corpus_pipeline.near_duplicates(spark, cut, SF_DIR)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, text), (40, ""), (42, " "), *[(i, t.split("\n")[1]) for i, t in rows[6:12]]], key=str)
    # of copies emptied as boilerplate of other pages one stays, too
    rows = [(i, f"menu\n{prose(rng, 30)}") for i in range(6)] + [(i, "menu") for i in range(10, 14)]
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, documents(spark, rows), SF_DIR), SF_DIR)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 10]


def test_components(spark):
    edges = [(b"b", b"a"), (b"c", b"b"), (b"d", b"c"), (b"x", b"y"), (b"e", b"d"), (b"b", b"a")] + [(f"s{i}".encode(), b"hub") for i in range(40)]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {got[x] for x in (b"a", b"b", b"c", b"d", b"e")} == {b"a"} and got[b"y"] == b"x"
    assert {got[f"s{i}".encode()] for i in range(40)} == {b"hub"}
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 9000))) for _ in range(9)]
    got = jaccard_join.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_range_hashes_depend_on_content_only():
    texts = [b"the cat sat on the mat", b"on the mat the cat sat on the mat", b"", b"a", b"\n \t"]
    hashed, begin = hashing.words_of(texts)
    plain = [w for t in texts for w in t.split()]
    assert list(np.diff(begin)) == [len(t.split()) for t in texts]
    assert len({(w, h) for w, h in zip(plain, hashed.tolist(), strict=True)}) == len(set(plain))
    alone = [hashing.words_of([w])[0][0] for w in plain]
    assert alone == hashed.tolist()


ITEMS = "item_id long, text string"


def items_and_texts():
    rng = random.Random(9)
    items = [prose(rng, n, 900) for n in (15, 18, 24, 30, 37, 45, 60, 12, 150)] + [None, "", "two words"]
    texts = [prose(rng, 200, 900) for _ in range(12)]
    for i, item in enumerate(items[:9]):
        at = texts[i].split()
        k = rng.randrange(len(at))
        told = item.upper() + "," if i % 2 else item
        texts[i] = " ".join([*at[:k], told, *at[k:]])
    texts[9] += " " + edited(rng, items[6], 1)[: -len(items[6]) // 2]
    return items, [*texts, items[3], None, "", prose(rng, 30_000, 900) + " " + items[5]]


def plain_leaks(items, texts, threshold=0.8):
    """Best Jaccard of five-word shingles over all windows of the item's size, all shingles of equal weight."""
    strip = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    norm = lambda t: (t or "").lower().translate(strip).split()
    found = {}
    for i, item in enumerate(items):
        w = norm(item)
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for j, text in enumerate(texts):
            t = norm(text)
            for k in range(max(1, len(t) - len(w) + 1)) if w and len(t) >= 0.5 * len(w) else ():
                part = t[k : k + len(w)]
                value = jaccard(s, {tuple(part[x : x + 5]) for x in range(max(1, len(part) - 4))})
                if value >= threshold:
                    found[j, i] = max(value, found.get((j, i), 0))
    return found


def test_decontamination_equals_brute_force(spark):
    items, texts = items_and_texts()
    table = spark.createDataFrame(list(enumerate(items)), ITEMS)
    docs = documents(spark, [*enumerate(texts), (0, texts[0])]).selectExpr("*", "1 as item_id", "2 as similarity")
    got = decontaminate.find_items(docs, table)
    want = plain_leaks(items, texts)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(want)
    assert all(abs(r.similarity - 1) < 1e-9 for r in got.collect() if want[r.doc_id, r.item_id] == 1)
    small = decontaminate.SearchOptions(items_at_once=3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, table, small).collect()} == set(want)
    clean = decontaminate.without_items(docs, table, small)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {j for j, _ in want})
    assert decontaminate.find_items(docs, table.where("false")).count() == 0
    assert decontaminate.find_items(documents(spark, []), table).count() == 0


def test_decontamination_weighs_shingles_over_the_whole_benchmark(spark):
    rng = random.Random(12)
    template = prose(rng, 25, 900)
    items = [f"{template} {prose(rng, 8 + i, 900)}" for i in range(9)] + [prose(rng, 30, 900)] * 2
    table = spark.createDataFrame(list(enumerate(items)), ITEMS)
    docs = documents(spark, [f"{prose(rng, 50, 900)} {edited(rng, item, i % 2)} {prose(rng, 50, 900)}" for i, item in enumerate(items)])
    found = [
        {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_items(docs, table, options).collect()}
        for options in (decontaminate.SearchOptions(items_at_once=n, threshold=0.3, radius=31) for n in (3, 4096))]
    assert found[0] == found[1] and min(found[1].values()) < 0.9 and len(found[1]) > len(items)


def test_hamming_tables_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, 20, dtype=np.uint64)
    windows = np.repeat(prints, 30)
    for i in range(len(windows)):
        for bit in rng.choice(64, rng.integers(0, 24), replace=False):
            windows[i] ^= np.uint64(1) << np.uint64(bit)
    rung = decontaminate.Rung(9, list(range(20)), prints, decontaminate.SearchOptions())
    got = set(zip(*(x.tolist() for x in rung.search(windows, 15)), strict=True))
    near = np.bitwise_count(windows[:, None] ^ prints[None, :]) <= 15
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
