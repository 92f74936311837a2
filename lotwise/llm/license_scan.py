"""License scan: ordered signature rules behind a keyword prefilter.

A text is normalised to its lower-case words joined by one space.  One pass of an
Aho-Corasick automaton finds the rules' keywords; only rules whose keyword occurs
are matched (``license_rules``: hundreds of patterns, each with a label, a
priority and a confidence).  A match covers an interval of words.  Overlaps are
resolved by priority and containment: a match inside the interval of a better one
(by priority, then length, then place, then rule order) is suppressed; what is
left are the detections.  Independently, ``phrases`` are looked up word by word
and always kept.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z, so letters
outside ASCII belong to words.  Documents are scanned whole and one by one in map
tasks; nothing is shuffled or capped.

Defined results: a null or empty text has no words, no detections and score 0;
equal matches of two rules keep the better rule's label; repeated rows and ids are
treated row by row; a null id stays null; an empty table gives no rows; columns
are taken by name, so others play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import license_rules as R
from lotwise.llm import text as T
from lotwise.llm.tables import table

# ---- fixed values: the phrases that every scan looks up, with their labels ----
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
PHRASE_CONFIDENCE = 0.5
# -------------------------------------------------------------------------------

# Every byte that is no word's becomes a space, A-Z become a-z.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
               for b in range(256))

PLACE = "struct<label:string,first:long,last:long,confidence:double>"
FOUND = f"id long, n_words long, phrases array<{PLACE}>, detections array<{PLACE}>, score double"


def normalise(text: bytes) -> str:
    """The words with a space before and after each, one character per byte."""
    words = text.translate(_TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else " "


class Rules:
    """Compiled rules with their keyword automaton."""

    def __init__(self, rows, phrases=PHRASES):
        import ahocorasick
        kinds = list(R.KINDS)
        self.rules = [(label, kinds.index(kind), R.KINDS[kind], re.compile(f"(?<= )(?:{pattern})(?= )"))
                      for label, kind, _, pattern in rows]
        self.phrases = [(label, len(phrase.split()), re.compile(f"(?= {re.escape(phrase)} )"), f" {phrase} ")
                        for phrase, label in phrases]
        by_keyword: dict[str, list[int]] = {}
        for number, (_, _, keyword, _) in enumerate(rows):
            by_keyword.setdefault(keyword, []).append(number)
        self._automaton = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self._automaton.add_word(keyword, tuple(numbers))
        self._automaton.make_automaton()

    def candidates(self, norm: str) -> list[int]:
        """Rules whose keyword occurs, in rule order."""
        found = {numbers for _, numbers in self._automaton.iter(norm)}
        return sorted(n for numbers in found for n in numbers)

    def scan(self, norm: str):
        """Phrase places and resolved detections: (label, first word, last word, confidence)."""
        matches = []
        for number in self.candidates(norm):
            label, priority, confidence, pattern = self.rules[number]
            matches += [(priority, m.start() - m.end(), m.start(), number, m.end(), label, confidence)
                        for m in pattern.finditer(norm)]
        places = [(m.start() + 1, size, label) for label, size, pattern, plain in self.phrases if plain in norm
                  for m in pattern.finditer(norm)]
        if not matches and not places:
            return [], []
        spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 0x20)
        word = lambda at: int(np.searchsorted(spaces, at))
        kept = [(label, word(begin) - 1, word(end) - 1, confidence)
                for _, _, begin, _, end, label, confidence in outermost(sorted(matches))]
        found = [(label, word(at) - 1, word(at) + size - 2, PHRASE_CONFIDENCE) for at, size, label in places]
        key = lambda d: (d[1], d[2], d[0])
        return sorted(found, key=key), sorted(kept, key=key)


def outermost(matches: list[tuple]) -> list[tuple]:
    """Matches, best first, without those inside the interval of a better one.

    A match is (priority, -length, begin, rule, end, ...).  The kept intervals that
    no other kept one contains form a staircase with rising begins and ends, so one
    binary search decides: of those that begin no later, the last ends last.
    """
    begins: list[int] = []
    ends: list[int] = []
    kept = []
    for match in matches:
        begin, end = match[2], match[4]
        at = bisect_right(begins, begin)
        if at and ends[at - 1] >= end:
            continue
        kept.append(match)
        # intervals inside the new one leave the staircase
        low = at - 1 if at and begins[at - 1] == begin else at
        high = low
        while high < len(ends) and ends[high] <= end:
            high += 1
        begins[low:high], ends[low:high] = [begin], [end]
    return kept


_compiled: dict[tuple, Rules] = {}


def _rules(rows, phrases) -> Rules:
    key = (rows, phrases)
    if key not in _compiled:
        _compiled[key] = Rules(rows, phrases)
    return _compiled[key]


def _column(scans: list[list[tuple]]) -> pa.Array:
    """An array of places per document."""
    flat = [place for places in scans for place in places]
    parts = list(zip(*flat)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
    values = pa.StructArray.from_arrays([pa.array(list(c), kind) for c, kind in zip(parts, kinds)],
                                        ["label", "first", "last", "confidence"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in scans]), pa.int32()), values)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None,
                 phrases=PHRASES) -> DataFrame:
    """(id, n_words, phrases, detections, score) of every row of ``docs``.

    ``rules`` are (label, kind, keyword, pattern) rows in order of priority, by
    default all of ``license_rules``.  Places give a label and its first and last
    word, from 0; ``score`` is the confidence of the best place, 0 without one.
    """
    rows = tuple(map(tuple, rules if rules is not None else R.parse(R.RULES)))
    phrases = tuple(map(tuple, phrases))

    def run(batches):
        scanner = _rules(rows, phrases)
        for batch in batches:
            counts, found, kept = [], [], []
            for text in batch.column(1):
                norm = normalise(text.as_py())
                counts.append(norm.count(" ") - 1)
                places, detections = scanner.scan(norm)
                found.append(places)
                kept.append(detections)
            score = [max((p[3] for p in a + b), default=0.0) for a, b in zip(found, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), _column(found), _column(kept),
                 pa.array(score, pa.float64())], ["id", "n_words", "phrases", "detections", "score"])
        T.release()

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(run, FOUND)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every whole text of ``documents``."""
    found = license_scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first").alias("first_word"), F.array_max("phrases.first").alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"),
        joined(F.concat("phrases.label", "detections.label")).alias("labels"), "score")
