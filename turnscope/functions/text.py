"""Column expressions over message text, all JVM-side, and the similarity of two texts."""

from __future__ import annotations

import difflib

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscope.functions import vocab as V

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_array(values) -> str:
    """An array literal: one expression instead of a call per element."""
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def iso_sql(us: str) -> str:
    """SQL for ISO-8601 text of epoch microseconds, independent of the session time zone.

    Numbers are padded by cutting the leading 1 off a larger one: a format string is parsed anew for every row.
    """
    day, rest = f"CAST(({us} - pmod({us}, 86400000000)) div 86400000000 AS INT)", f"pmod({us}, 86400000000)"

    def padded(value: str, width: int) -> str:
        return f"substring(CAST({10 ** width} + {value} AS STRING), 2)"

    return (
        f"concat(CAST(date_add(DATE'1970-01-01', {day}) AS STRING), 'T', {padded(f'{rest} div 3600000000', 2)}, ':', "
        f"{padded(f'{rest} div 60000000 % 60', 2)}, ':', {padded(f'{rest} div 1000000 % 60', 2)}, '.', "
        f"{padded(f'{rest} % 1000000', 6)}, 'Z')"
    )


def iso(us: str) -> Column:
    return F.expr(iso_sql(us))


def find_all(c: ColumnOrName, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def count_matches(c: ColumnOrName, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def tokens(c: ColumnOrName) -> Column:
    """Sorted distinct vocabulary items of four or more characters."""
    words = find_all(F.lower(F.coalesce(col(c), F.lit(""))), V.TOKEN)
    stop = F.expr(sql_array(V.STOP_WORDS))
    return F.array_sort(F.array_except(F.array_distinct(words), stop))


def references(c: ColumnOrName, *patterns: str) -> Column:
    """Sorted distinct matches of the given reference patterns."""
    found = F.concat(*[find_all(c, p) for p in patterns]) if len(patterns) > 1 else find_all(c, patterns[0])
    return F.array_sort(F.array_distinct(found))


def sha12(c: ColumnOrName) -> Column:
    return F.substring(F.sha1(F.coalesce(col(c), F.lit(""))), 1, 12)


def message_key(sid: ColumnOrName, text: ColumnOrName) -> Column:
    return F.substring(F.sha1(F.concat(col(sid), F.lit("|"), col(text))), 1, 16)


def message_id(sid: ColumnOrName, idx: ColumnOrName) -> Column:
    return F.format_string("%s#%04d", F.substring(col(sid), 1, 8), col(idx))


def squash(c: ColumnOrName) -> Column:
    """Runs of white space become one blank (ends are kept)."""
    return F.regexp_replace(col(c), r"\s+", " ")


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def is_system_text(c: ColumnOrName) -> Column:
    return col(c).rlike(V.SYSTEM_PREFIX)


def is_human_text(c: ColumnOrName) -> Column:
    """Non-empty, not machine-written, not an interrupt notice."""
    c = col(c)
    return (
        (F.length(c) > 0)
        & ~c.rlike(V.SYSTEM_PREFIX)
        & ~c.rlike(V.INTERRUPT)
        & ~F.startswith(c, F.lit(V.NOTIFICATION_TAG))
    )


def group1(c: ColumnOrName, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))


# what a reply that begins with a phrase says
PHRASES = dict.fromkeys(V.AFFIRM, "applies") | dict.fromkeys(V.NEGATE, "does-not-apply")
# the longest phrase that fits decides
PHRASE_PATTERN = "|".join(sorted(PHRASES, key=len, reverse=True))


def reply_verdict(c: ColumnOrName) -> Column:
    """applies / does-not-apply / unlabelled, from the leading phrase of a short reply."""
    text = strip(F.coalesce(col(c), F.lit("")))
    lead = F.regexp_extract(F.regexp_replace(F.lower(text), V.VERDICT_LEAD, ""), rf"^({PHRASE_PATTERN})\b", 1)
    verdicts = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    short = F.length(text) <= V.VERDICT_MAX_CHARS
    return F.coalesce(F.when(short, F.try_element_at(verdicts, lead)), F.lit("unlabelled"))


def cut(c: ColumnOrName, limit: int | None) -> Column:
    """The first ``limit`` characters; the whole text without a limit."""
    return F.substring(col(c), 1, int(limit)) if limit else col(c)


def length_bound(la: Column, lb: Column) -> Column:
    """An upper bound on similarity from lengths alone: 2*min/(la+lb)."""
    return 2.0 * F.least(la, lb) / F.greatest(la + lb, F.lit(1))


def two_decimals(share: str) -> Column:
    """A share in [0, 1] with two decimals, rounded from the exact value of the double, ties to even.

    ``format_string`` rounds the shortest decimal form half up instead: 0.945 gives 0.95 there, though the double lies
    below the tie. A share times 2**60 is a whole number, so nothing is rounded before the end.
    """
    one = 1 << 60
    scaled = f"CAST(CAST({share} * {one}D AS BIGINT) AS DECIMAL(20, 0)) * 100"
    low, rest = F.expr(f"CAST({scaled} div {one} AS BIGINT)"), F.expr(f"({scaled}) % {one}")
    up = (rest > one // 2) | ((rest == one // 2) & (low % 2 == 1))
    hundredths = low + up.cast("bigint")
    return F.format_string("%d.%02d", F.floor(hundredths / 100), hundredths % 100)


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio of two short texts; argument order matters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def reaches(m: difflib.SequenceMatcher, threshold: float) -> bool:
    """Whether the ratio is at least the threshold, trying two cheap upper bounds first."""
    return (
        m.real_quick_ratio() >= threshold
        and m.quick_ratio() >= threshold
        and m.ratio() >= threshold
    )
