"""Small tables for the operators, and plain versions of what they compute."""

import math
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark, texts, schema=SCHEMA, source="s"):
    """One row per text or tuple (id, text[, source]); lang and n_chars are null."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else source, None) for r in rows], schema)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def shingles(text, size=5):
    w = (text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value // 10 + value % 10
    return total % 10 == 0


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in (text.count(c) for c in set(text)))
