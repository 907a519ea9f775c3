"""Quality rules, line by line first: lines that fail a rule are removed, then documents that lose too much text are rejected.

The rules on whole documents that come before (word counts, repeated windows of words) are returned as figures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Whole documents: fewest words; words of a window; most repeated words, in per cent.
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
#: Lines: most symbols and other marks, in per cent of a line's characters in words; navigation lines and notices have at most so many words.
MAX_MARKS, NAV_WORDS, NOTICE_WORDS = 15, 12, 16
#: Also a navigation line: NAV_BARS bars or more, and at least one for BAR_WORDS words.
NAV_BARS, BAR_WORDS = 2, 4
#: A line of fewer words than this must end as a sentence does.
END_WORDS = 4
#: A document must keep this share of its characters in words, in per cent.
MIN_KEPT = 50

# White space between words, symbols, what a sentence may end with, and whole lines of page furniture (A-Z lower-cased). A notice has a notice's form:
# a sign or year after "copyright", links and nothing else, a name after "powered by"; a sentence that only begins like one is prose.
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
ENDS = "[.!?\"')\\]…»”’。！？:;]"
NAVIGATION = "(home|menu|search|login|log in|sign in|sign up|register|next|previous|back to top|skip to content|read more|share this|subscribe|site map|contact us|about us)([ |>/,.:-]+(home|menu|search|login|log in|sign in|sign up|register|next|previous|about|about us|contact|contact us|help|faq|blog|news))*[ .>]*"
LINK = "(all rights reserved|terms of use|terms of service|terms and conditions|privacy policy|cookie policy|cookie settings|legal notice|imprint|accessibility|disclaimer)"
BOILERPLATE = f"({LINK}([ |/,.&·-]+(and )?{LINK})*[ .]*|(copyright )?(©|\\(c\\)).*|copyright [12][0-9][0-9][0-9]([ ,.-].*)?|(we|this site|this website) uses? cookies([.]| (to|for|on|and) .*|)|click here([.!]*| (to|for) .*)|powered by [^ ]+( [^ ]+)?( [^ ]+)?|lorem ipsum( .*)?)"

_WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
_SYMBOL, _NAV, _BOILER = re.compile(SYMBOLS), re.compile(NAVIGATION), re.compile(BOILERPLATE)
_END = re.compile(ENDS)
_SPACES = "\t\n\x0b\x0c\r "
_MARKS = re.compile("[#*$%&|<>!?]")


def repeated_words(words: list[str]) -> int:
    """How many words stand in a window of WINDOW words that the text has twice or more, first ones included.

    Windows are compared exactly: words, then pairs, fours and eights get equal numbers where they are equal.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    step = 1
    while step < WINDOW:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        step *= 2
        if step < WINDOW and ids.max() + 1 == len(ids):
            return 0
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_fails(line: str) -> bool:
    """Whether a line with a word breaks a rule: marks beyond MAX_MARKS per cent or a few words without an end (punctuation), a line of links
    (navigation), or a notice (boilerplate)."""
    size = len(line) - sum(map(line.count, _SPACES))
    if 100 * len(_MARKS.findall(line)) > MAX_MARKS * size:
        return True
    if (bars := line.count("|")) >= NAV_BARS and BAR_WORDS * bars >= len(_WORDS.findall(line)):
        return True
    low = line.strip(_SPACES).translate(_LOWER)
    ended = bool(_END.match(low[-1:]))
    if ended and low[:1] not in _STARTS:
        return False
    n = len(_WORDS.findall(low))
    if n < END_WORDS and not ended:
        return True
    return (n <= NOTICE_WORDS and bool(_BOILER.fullmatch(low))) or (n <= NAV_WORDS and bool(_NAV.fullmatch(low)))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_STARTS = frozenset("abcdhilmnprstw©(")


def measure(text: str | None) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of one text; null is empty."""
    text = text or ""
    words = _WORDS.findall(text)
    chars = sum(map(len, words))
    lines, seen, dup, lost = text.split("\n"), set(), 0, 0
    for line in lines:
        if not line.strip(_SPACES):
            continue
        dup += line in seen
        seen.add(line)
    verdict = {line: line_fails(line) for line in seen}
    if any(verdict.values()):
        lost = sum(sum(map(len, _WORDS.findall(line))) for line in lines if verdict.get(line))
    again = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * again > MAX_REPEATED * len(words)
    return len(words), chars, len(_SYMBOL.findall(text)), dup, again, failed, not failed and 100 * (chars - lost) >= MIN_KEPT * chars


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what measure() tells: one row for each row of docs. A null text has no words, and fails. Repeated rows are
    repeated; a text is worked on as a whole, one at a time; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64()] * 5 + [pa.bool_()] * 2
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column(1)]
            cols = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that measure() keeps."""

    @F.pandas_udf("boolean")
    def keeps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([measure(t)[-1] for t in b], dtype=bool)

    return docs.where(keeps(F.col(text_col)))


def figures_sql(table: str = "documents") -> str:
    """DuckDB SQL for figures(): the same rules, over lists."""
    word = "[^\\x20\\x09-\\x0D]+"
    fails = (
        f"(100 * len(regexp_extract_all(l, '[#*$%&|<>!?]')) > {MAX_MARKS} * length(regexp_replace(l, '{SPACE}', '', 'g')) "
        f"OR (len(regexp_extract_all(l, '{word}')) <= {NOTICE_WORDS} AND regexp_full_match(trimmed(l), '{BOILERPLATE}')) "
        f"OR (len(regexp_extract_all(l, '{word}')) < {END_WORDS} AND NOT regexp_matches(trimmed(l), '{ENDS.replace(chr(39), chr(39) * 2)}$')) "
        f"OR (length(l) - length(replace(l, '|', '')) >= {NAV_BARS} AND {BAR_WORDS} * (length(l) - length(replace(l, '|', ''))) >= len(regexp_extract_all(l, '{word}'))) "
        f"OR (len(regexp_extract_all(l, '{word}')) <= {NAV_WORDS} AND regexp_full_match(trimmed(l), '{NAVIGATION}')))"
    )
    low = "translate(regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fails = fails.replace("trimmed(l)", low)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM {table}),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS ls FROM d),
g AS (SELECT k, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' '))) AS s, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW}),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
n AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS p FROM r) GROUP BY k),
f AS (SELECT w.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS rest, length(t) AS len_t, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(list_sum(list_transform(list_filter(ls, lambda l: {fails}), lambda l: length(regexp_replace(l, '{SPACE}', '', 'g')))), 0) AS lost
  FROM w LEFT JOIN n USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, CAST(len_t - rest AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - lost) >= {MIN_KEPT} * word_chars AS kept FROM b"""
