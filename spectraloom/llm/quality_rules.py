"""Quality rules as a short-circuit cascade.

Each rule is a test on one text. The order is found on a sample of the documents, one place after the other: every rule
left is run and timed on the texts that the rules before it let through, with what those rules have already worked out at
hand, and the one with the most rejections per second comes next. Over the whole corpus a text is handed from rule to rule
in that order until one rejects it. What several rules need (words, lines, counts) is worked out once a text, when first
asked for, so a text that an early cheap rule rejects never pays for the dear ones. The order changes only the time: a
text is kept when no rule rejects it.

``quality_report`` has to give the counts of the two base rules for every text, so there the cascade orders the other rules
alone and is entered by texts that pass the base; ``keep_good`` stops at any rule.

The sample is only used for the order: the ``SAMPLE_ROWS`` rows with the least hashes of doc_id over the whole table, of those with
texts of at most ``SAMPLE_BYTES`` bytes, as they come to the driver. Rules are timed on what they meet: in ``quality_report`` on
texts that pass the base, with the counts at hand.

Defined results: a null or empty text has no words and is rejected by the word-count rule; equal rows get equal results; a
null doc_id stays; extra columns stay where a filter returns documents; an empty table gives an empty result, in the
order in which the rules are listed.
"""

from __future__ import annotations

import time
from collections import Counter
from copy import copy
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from string import ascii_letters, ascii_uppercase
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import pieces, table

ASCII = bytes(range(128))
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SAMPLE_ROWS = 400
SAMPLE_BYTES = 50_000


class Text:
    """One text and what rules ask about it, each worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes are cut at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text has twice or more."""
        w = self.words
        at = list(zip(w, w[1:], w[2:]))
        if len(set(at)) == len(at):
            return 0
        often = {x for x, n in Counter(at).items() if n > 1}
        total, end = 0, 0
        for i, x in enumerate(at):
            if x in often:
                total += i + 3 - max(i, end)
                end = i + 3
        return total

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def wide(self) -> str:
        """The characters beyond ASCII, in order."""
        return "" if self.text.isascii() else self.raw.translate(None, ASCII).decode()

    def _ascii_among(self, marks: str) -> int:
        return len(self.raw) - len(self.raw.translate(None, marks.encode()))

    @cached_property
    def n_upper(self) -> int:
        """Letters of the category Lu; Roman numerals and letters in circles aren't."""
        return self._ascii_among(ascii_uppercase) + sum(category(c) == "Lu" for c in self.wide)

    @cached_property
    def n_letters(self) -> int:
        return self._ascii_among(ascii_letters) + sum(map(str.isalpha, self.wide))


Rule = tuple[str, Callable[[Text], bool]]
#: name, and whether it rejects the text. The first two are the base rules.
RULES: list[Rule] = [
    ("few_words", lambda t: t.n_words < MIN_WORDS),
    ("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    ("symbols", lambda t: 10 * t.n_symbols > 2 * t.n_words),
    ("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    ("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    ("shouting", lambda t: 2 * t.n_upper > t.n_letters),
    ("few_letters", lambda t: 10 * t.n_letters < 6 * t.word_chars),
]
BASE = ("few_words", "repeated_windows")


def greedy_order(texts: list[Text], rules: list[Rule]) -> list[str]:
    """Rule names by rejections per second among the texts that the rules before let through.

    A rule is timed on copies of those texts, which hold what has been worked out so far, so it pays only for what no
    earlier rule needed. Where no rule rejects anything any more, the rest follow as listed.
    """
    left, out = list(rules), []
    while left:
        best = None
        for at, (_, rule) in enumerate(left):
            copies = [copy(t) for t in texts]
            began = time.perf_counter()
            verdicts = [bool(rule(t)) for t in copies]
            rate = sum(verdicts) / max(time.perf_counter() - began, 1e-9)
            if best is None or rate > best[0]:
                best = (rate, at, copies, verdicts)
        rate, at, copies, verdicts = best
        if not rate:
            return out + [name for name, _ in left]
        out.append(left.pop(at)[0])
        texts = [t for t, rejected in zip(copies, verdicts) if not rejected]
    return out


def _sampled(docs: DataFrame, rows: int) -> list[str | None]:
    """Texts of ``rows`` documents with the least hashes of their ids, over the whole table; long texts are left out."""
    least = F.xxhash64(F.lit("cascade"), F.col("doc_id").cast("string"))
    share = min(1.0, 2 * rows / max(1, docs.count()))  # of the hashes' range: twice what is wanted, as some texts are long
    few = docs.select("text", least.alias("least")).where(F.col("least") < int((share - 0.5) * 2**64 - 1) if share < 1 else F.lit(True))
    short = few.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    return [r["text"] for r in short.orderBy("least").limit(rows).select("text").collect()]


def cascade_order(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, after: list[Rule] | None = None, counts: Iterable[str] = ()) -> list[str]:
    """The rules' order as found on the sample: on the texts that no rule of ``after`` rejects, with ``counts`` at hand."""
    texts = [Text(t) for t in _sampled(docs, sample_rows)]
    texts = [t for t in texts if passes(t, after or [])]
    for t in texts:
        for name in counts:
            getattr(t, name)
    return greedy_order(texts, RULES if rules is None else rules)


def passes(text: Text, rules: list[Rule]) -> bool:
    return not any(rule(text) for _, rule in rules)


def _ordered(order: list[str], rules: list[Rule]) -> list[Rule]:
    by = dict(rules)
    return [(n, by[n]) for n in order]


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with all their columns: the cascade itself, stopping at the first rejection."""
    rules = RULES if rules is None else rules
    cascade = _ordered(cascade_order(docs, rules), rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array([passes(Text(t.as_py()), cascade) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Each document's counts with the cascade's verdict."""
    others = [r for r in (RULES if rules is None else rules) if r[0] not in BASE]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = [r for r in RULES if r[0] in BASE]
    cascade = _ordered(cascade_order(docs, others, after=base, counts=names), others)  # as they meet texts below

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for t in batch.column("text"):
                text = Text(t.as_py())
                failed = not passes(text, base)
                rows.append((*(getattr(text, n) for n in names), failed, not failed and passes(text, cascade)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, [pa.int64()] * 5 + [pa.bool_()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(x, '[^\p{L}]+', '', 'g')) AS n_letters
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * n_upper > n_letters OR 10 * n_letters < 6 * word_chars) AS kept
FROM b"""
