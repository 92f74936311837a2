"""Periodic runs of words: descending-LCP Kruskal over ordered position sets.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) that neither neighbour extends, of at least ``min_length``
words and ``min_exponent`` periods.  Per document:

1. The suffixes are ordered by doubling word ranks; only suffixes that still tie
   are looked at again.  The longest common extensions of neighbours (LCPs)
   come from the ranks of all doublings, largest first.
2. The neighbouring pairs are the edges of a chain.  By decreasing LCP, Kruskal
   unites the classes of their ends; a class is a union-find root with its
   positions in order.  Positions ``a < b`` that become neighbours in a class at
   level ``l`` agree on exactly ``l`` words, so ``[a, b + l)`` has period ``b - a``
   if that is at most ``l``; no position between them means no smaller period.
   Such a pair whose preceding words differ is the seed of a run.

Two bounds skip work, never a run.  Since ``l >= (min_exponent - 1) * q`` and
``l >= min_length - q`` for every seed, edges under the least such ``l`` are not
joined, and a chain of joined edges is left out if its smallest gap between
positions, times ``min_exponent - 1``, exceeds its largest LCP.  Documents are
independent, so nothing is shuffled; a task holds a batch of texts.

Words are the maximal strings without white space (0x20, 0x09-0x0D) and are
compared by 64-bit hashes.  Defined results: a null or empty text has no words
and no runs; repeated rows and ids are treated row by row; a null id stays null;
an empty table gives no rows; columns are taken by name, so others play no part.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import text as T
from lotwise.llm.tables import table

MIN_LENGTH = 6
MIN_EXPONENT = 4
BLOCK = 512                     # positions in a block of an ordered set
SEGMENT_BYTES = 1 << 20         # bytes of text whose suffixes are ordered at once

RUN = "struct<start:long,length:long,period:long>"
FOUND = f"id long, n_words long, runs array<{RUN}>, collapsed string"


class Ordered:
    """A set of integers in order, in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Add ``x`` and return its neighbours."""
        blocks = self.blocks
        at = max(0, bisect_left(blocks, x, key=lambda b: b[0]) - 1) if len(blocks) > 1 else 0
        block = blocks[at]
        i = bisect_left(block, x)
        before = block[i - 1] if i else (blocks[at - 1][-1] if at else None)
        after = block[i] if i < len(block) else (blocks[at + 1][0] if at + 1 < len(blocks) else None)
        block.insert(i, x)
        self.size += 1
        if len(block) > BLOCK:
            blocks[at:at + 1] = [block[:BLOCK // 2], block[BLOCK // 2:]]
        return before, after


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the keys, and for every key the first place of its equals."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return order, rank


def suffix_chain(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int):
    """Neighbouring suffixes of each document with a common extension of ``least`` words or more.

    ``ids`` are the words of all documents in turn, ``doc`` the document of each
    word and ``end`` where that document ends.  Returns the ends of the edges and
    their LCPs, in suffix order.
    """
    n = len(ids)
    empty = np.zeros(0, np.int64)
    if n < 2:
        return empty, empty, empty
    # suffixes of different documents differ in their first word
    order, rank = _ranks(_ranks(ids)[1] + doc * n)
    levels, h = [], 1               # (h, tied positions, their ranks at h words)
    tied = np.arange(n)
    while True:
        # positions whose rank another position shares
        same = np.zeros(n + 1, bool)
        same[1:n] = rank[order[1:]] == rank[order[:-1]]
        shared = order[same[:-1] | same[1:]]
        tied = np.sort(shared)
        if len(tied) == 0:
            break
        levels.append((h, tied, rank[tied]))
        # sort the tied by the rank of what follows, inside their rank
        ahead = shared + h
        following = np.where(ahead < end[shared], rank[np.minimum(ahead, n - 1)] + 1, 0)
        place = rank[shared]
        by = np.lexsort((following, place))
        shared, place, following = shared[by], place[by], following[by]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (following[1:] != following[:-1])))
        group = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        inside = np.arange(len(shared)) - np.repeat(group, np.diff(np.append(group, len(shared))))
        slot = place + inside       # where each tied suffix now stands
        order[slot] = shared
        rank[shared] = np.maximum.accumulate(np.where(new, slot, 0))
        h *= 2
    if not levels:
        return empty, empty, empty
    # candidates tie at the largest doubling that is not above the bound
    keep = [level for level in levels if level[0] <= least][-1]
    if 2 * keep[0] <= least:        # no suffixes tie that long
        return empty, empty, empty
    mark = np.full(n, -1, np.int64)
    mark[keep[1]] = keep[2]
    left, right = order[:-1], order[1:]
    near = (mark[left] >= 0) & (mark[left] == mark[right])
    left, right = left[near], right[near]
    lcp = np.zeros(len(left), np.int64)
    for size, at, ranks in reversed(levels):
        mark[:] = -1
        mark[at] = ranks
        a, b = left + lcp, right + lcp
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        lcp += np.where(inside & (mark[a] >= 0) & (mark[a] == mark[b]), size, 0)
    far = lcp >= least
    return left[far], right[far], lcp[far]


def least_extension(min_length: int, min_exponent: int) -> int:
    """The least LCP of a seed, over all periods."""
    return min(max((min_exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))


def _open_chains(left: np.ndarray, right: np.ndarray, lcp: np.ndarray, min_exponent: int) -> np.ndarray:
    """Edges of chains that can seed a run (module doc)."""
    chain = np.cumsum(np.concatenate(([0], left[1:] != right[:-1])))
    member = np.concatenate((left, right))
    of = np.concatenate((chain, chain))
    by = np.lexsort((member, of))
    member, of = member[by], of[by]
    gap = np.diff(member)
    gap[(np.diff(of) != 0) | (gap == 0)] = np.iinfo(np.int64).max // min_exponent
    count = int(chain[-1]) + 1
    closest = np.full(count, np.iinfo(np.int64).max // min_exponent)
    np.minimum.at(closest, of[:-1], gap)
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, chain, lcp)
    return (closest * (min_exponent - 1) <= longest)[chain]


def kruskal_runs(left, right, lcp, ids, begin, min_length: int, min_exponent: int):
    """Runs (start, length, period) from edges; ``begin`` is where each word's document begins."""
    root: dict[int, int] = {}
    sets: dict[int, Ordered] = {}

    def find(x: int) -> int:
        if root.setdefault(x, x) == x:
            if x not in sets:
                sets[x] = Ordered(x)
            return x
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    runs = []

    def seed(a: int | None, b: int | None, level: int) -> None:
        if a is None or b is None:
            return
        q = b - a
        if level < (min_exponent - 1) * q or level + q < min_length:
            return
        if a == begin[a] or ids[a - 1] != ids[b - 1]:
            runs.append((a, q + level, q))

    by = np.argsort(-lcp, kind="stable")
    for a, b, level in zip(left[by].tolist(), right[by].tolist(), lcp[by].tolist()):
        big, small = find(a), find(b)
        if sets[big].size < sets[small].size:
            big, small = small, big
        root[small] = big
        into, latest, open_ = sets[big], None, None
        for x in sets.pop(small):
            # a pair is new only if its ends come from both classes
            before, after = into.insert(x)
            if before != latest:
                seed(latest, open_, level)
                seed(before, x, level)
            latest, open_ = x, after
        seed(latest, open_, level)
    return runs


def find_runs(ids: np.ndarray, off: np.ndarray, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``ids`` are the words of the documents in turn, ``off`` the documents' offsets.
    """
    counts = np.diff(off)
    doc = np.repeat(np.arange(len(counts)), counts)
    least = least_extension(min_length, min_exponent)
    left, right, lcp = suffix_chain(ids, doc, np.repeat(off[1:], counts), least)
    if len(left) == 0:
        return np.zeros((0, 4), np.int64)
    open_ = _open_chains(left, right, lcp, min_exponent)
    begin = np.repeat(off[:-1], counts)
    found = kruskal_runs(left[open_], right[open_], lcp[open_], ids, begin, min_length, min_exponent)
    if not found:
        return np.zeros((0, 4), np.int64)
    at, length, period = np.array(found, np.int64).T
    rows = np.stack((doc[at], at - begin[at], length, period), axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(buf: np.ndarray, off: np.ndarray, starts, ends, first, keep) -> pa.Array:
    """The kept words of each document, joined by one space."""
    kept = np.flatnonzero(keep)
    change = np.zeros(len(buf) + 1, np.int8)
    change[starts[kept]] += 1
    change[ends[kept]] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    # a space after every kept word but a document's last
    doc = np.searchsorted(first, kept, side="right") - 1
    inner = kept[:-1][doc[1:] == doc[:-1]]
    out = buf.copy()
    out[ends[inner]] = 0x20
    mask[ends[inner]] = True
    total = np.concatenate(([0], np.cumsum(mask)))[off].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [
        None, pa.py_buffer(total.tobytes()), pa.py_buffer(out[mask].tobytes())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, n_words, runs, collapsed) per row; ``collapsed`` keeps one period of each run.

    ``collapsed`` drops a word if any run contains it after the run's first period.
    """

    def solve(ids: pa.Array, buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        starts, ends, first = T.words(buf, off)
        rows = find_runs(T.word_hashes(buf, starts, ends), first, min_length, min_exponent)
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
        np.add.at(change, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
        keep = np.cumsum(change[:-1]) == 0
        runs = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(rows[:, 0], np.arange(len(off))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)],
                                       ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(first)), runs, _collapsed(buf, off, starts, ends, first, keep)],
            ["id", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            data, offsets = T.binary(batch.column(1))
            for lo, hi in T.slices(offsets, SEGMENT_BYTES):
                begin, end = offsets[lo], offsets[hi]
                yield solve(batch.column(0).slice(lo, hi - lo), data[begin:end], offsets[lo:hi + 1] - begin)
        T.release()

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(run, FOUND)


def _periodic_text(doc_id: Column, text: Column) -> Column:
    """The contract's input: every tenth document by hash repeats a stretch of its words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(
            F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    # one lambda binds the words once
    rewritten = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise("")), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, rewritten).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, every tenth of which is made periodic by the contract's rule."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", _periodic_text(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # longest first; ties by smallest start, then period
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"),
        r["length"].alias("length")))), F.lit(0))
    rows = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
