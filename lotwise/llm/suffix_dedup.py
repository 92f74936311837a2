"""Removal of repeated byte passages by a hash-compared suffix sort.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else in the corpus.  The suffixes that can share such a string are brought
together and sorted:

1. Each window of ``length`` bytes has an anchor, its ``seed``-byte string of
   smallest hash.  Equal windows have equal anchors at equal offsets, so only
   windows of one anchor can match.  Consecutive windows with one anchor form a
   chunk; about one row per 150 bytes is shuffled, without text.
2. Anchors that occur once drop out.  Chunks that occur twice or more are
   repeated as a whole; one representative of each stays in the search, so
   copies are never compared with one another.
3. The suffixes of the remaining chunks of an anchor are merge-sorted.  Two
   suffixes are compared by their common extension, found by binary search over
   prefix polynomial hashes; neighbours that share ``length`` bytes are repeated.
   The bytes of every such match are compared, and a group where a hash lied is
   redone on the bytes.
4. An anchor with more than ``group_limit`` different chunks is split: its
   windows are counted by a 128-bit digest of their bytes, map-side first.  That
   is exact in the same sense and bounds every group.

The text is shuffled once; the search and the removal reuse that exchange.

Defined results: a null text is empty; texts under ``length`` bytes lose
nothing; repeated rows are occurrences of one another, so both lose what they
share; a null id stays null; an empty table gives no rows.  Ids and texts are
selected by name, so extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import text as T
from lotwise.llm.tables import cut, table

LENGTH = 400
SEED = 100
GROUP_LIMIT = 2048
#: Bytes of text that a task hashes or sorts at once.
SEGMENT_BYTES = 1 << 20
SORT_BYTES = 2 << 20

CHUNKS = "id string, h long, p0 long, nw long, at long, anchor long, content long"
SPANS = "id string, h long, begin long, end long"


def anchored_chunks(buf: np.ndarray, off: np.ndarray, length: int, seed: int):
    """Document, first start, number of starts, anchor position and anchor hash of each chunk."""
    empty = np.zeros(0, np.int64)
    counts = np.maximum(0, np.diff(off) - length + 1)
    total = int(counts.sum())
    if total == 0:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    n, width = len(buf), length - seed + 1
    s = T.prefix(buf)
    grams = T.mix((s[seed:] - s[:-seed]) * T.powers(T.BASE, n)[:n - seed + 1])
    low = np.uint64(0xFFFFFFFF)
    keys = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    docs = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    starts = np.arange(total) + (off[:-1] - begin[:-1])[docs]
    least = np.minimum(back[starts], ahead[starts + width - 1])
    at = (low - (least & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return (docs[first], starts[first], np.diff(np.append(first, total)), at[first], grams[at[first]])


def segments(offsets: np.ndarray, length: int, limit: int = SEGMENT_BYTES):
    """(first document, last + 1, first byte, last + 1) of each segment of a batch."""
    for lo, hi in T.slices(offsets, limit):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if end - begin <= limit:
            yield lo, hi, begin, end
        else:  # one long text
            for part in range(begin, max(begin + 1, end - length + 1), limit):
                yield lo, hi, part, min(end, part + limit + length - 1)


def chunk_rows(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """The chunks of every document, without their text."""

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = T.binary(batch.column(2))
            for lo, hi, begin, end in segments(offsets, length):
                # a text longer than a segment comes in parts that overlap, so
                # that each window lies in one of them
                buf = data[begin:end]
                off = np.clip(offsets[lo:hi + 1], begin, end) - begin
                doc, start, windows, at, anchor = anchored_chunks(buf, off, length, seed)
                view = memoryview(buf)
                content = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in
                     zip(start.tolist(), (start + windows - 1 + length).tolist())), np.uint64, len(start))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc + lo)), pa.array(hashes[doc + lo]),
                     pa.array(start + begin - offsets[doc + lo]), pa.array(windows), pa.array(at - start),
                     pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["id", "h", "p0", "nw", "at", "anchor", "content"])

    return docs.mapInArrow(run, CHUNKS)


class Suffixes:
    """Suffixes of a byte buffer, compared by their first ``length`` bytes."""

    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length = buf, length
        self.sums, self.scale = T.prefix(buf), T.powers(T.BASE, len(buf))

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.scale[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        out = np.full(len(a), self.length)
        differ = np.flatnonzero(self.hashes(a, self.length) != self.hashes(b, self.length))
        a, b = a[differ], b[differ]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        for _ in range(int(self.length).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashes(a, mid) == self.hashes(b, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        out[differ] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts before suffix ``b``."""
        common = self.common(a, b)
        open_ = common < self.length
        step = np.where(open_, common, 0)
        return open_ & (self.buf[a + step] < self.buf[b + step])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Merge-sort the suffixes inside each group; ``group`` is ascending.

        All groups are merged in step: a suffix's place after a merge is its own
        rank plus the number of suffixes of the other run before it, which a
        binary search finds.
        """
        n = len(at)
        if n == 0:
            return at
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(begin, n))
        start, count = np.repeat(begin, size), np.repeat(size, size)
        rank = np.arange(n) - start
        run, widest = 1, int(size.max())
        while run < widest:
            pair = rank // (2 * run) * (2 * run)
            second = rank - pair >= run
            other = start + pair + np.where(second, 0, run)
            other_n = np.where(second, run, np.clip(count - pair - run, 0, run))
            low, high = np.zeros(n, np.int64), other_n.copy()
            for _ in range(int(run).bit_length()):
                active = np.flatnonzero(low < high)
                if len(active) == 0:
                    break
                mid = (low[active] + high[active]) >> 1
                mine, theirs = at[active], at[other[active] + mid]
                # equal suffixes of the first run stay ahead of the second's
                before = np.where(second[active], ~self.less(mine, theirs), self.less(theirs, mine))
                low[active] = np.where(before, mid + 1, low[active])
                high[active] = np.where(before, high[active], mid)
            place = start + pair + (rank - pair - np.where(second, run, 0)) + low
            merged = np.empty_like(at)
            merged[place] = at
            at, run = merged, run * 2
        return at


def repeated_starts(buf: np.ndarray, off: np.ndarray, group: np.ndarray, at: np.ndarray,
                    windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk and window number of every window that another chunk of its group has.

    ``group`` numbers the anchors in ascending order; ``at`` is the anchor's
    place in each chunk.
    """
    chunk = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(len(chunk)) - np.repeat(np.cumsum(windows) - windows, windows)
    key = group[chunk] * (length + 1) + (at[chunk] - number)
    order = np.argsort(key, kind="stable")
    key, start = key[order], (off[:-1][chunk] + number)[order]
    alone = np.ones(len(key), bool)
    same = key[1:] == key[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    key, start = key[~alone], start[~alone]
    suffixes = Suffixes(buf, length)
    start = suffixes.sort(start, key)
    match = (key[1:] == key[:-1]) & (suffixes.hashes(start[1:], length) == suffixes.hashes(start[:-1], length))
    left, right = start[:-1][match], start[1:][match]
    wrong = _unequal(buf, left, right, length)
    hit = np.zeros(len(buf) + 1, bool)
    hit[left] = True
    hit[right] = True
    for value in np.unique(key[:-1][match][wrong]):  # a hash lied: this group by its bytes
        members = start[key == value]
        seen: dict[bytes, list[int]] = {}
        for p in members.tolist():
            seen.setdefault(buf[p:p + length].tobytes(), []).append(p)
        hit[members] = False
        hit[[p for same_ in seen.values() if len(same_) > 1 for p in same_]] = True
    where = np.flatnonzero(hit)
    owner = np.searchsorted(off, where, side="right") - 1
    return owner, where - off[owner]


def _unequal(buf: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Pairs of starts whose bytes differ; neighbouring pairs are compared as one stretch."""
    order = np.lexsort((left, right - left))
    a, b = left[order], right[order]
    wrong = np.zeros(len(a), bool)
    if len(a) == 0:
        return wrong
    new = np.concatenate(([True], (np.diff(a) > length) | (np.diff(b - a) != 0)))
    first = np.flatnonzero(new)
    view = memoryview(buf)
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(a)).tolist()):
        size = int(a[hi - 1] - a[lo]) + length
        p, q = int(a[lo]), int(b[lo])
        if view[p:p + size] != view[q:q + size]:
            for k in range(lo, hi):
                p, q = int(a[k]), int(b[k])
                wrong[order[k]] = view[p:p + length] != view[q:q + length]
    return wrong


def _spans(owner: np.ndarray, number: np.ndarray):
    """First and last window of each stretch of consecutive windows in a chunk."""
    if len(owner) == 0:
        return owner, number, number
    new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(number) != 1)))
    first = np.flatnonzero(new)
    return owner[first], number[first], number[np.append(first[1:], len(owner)) - 1]


def anchor_ends(rows: pa.Table) -> list[int]:
    """Where to cut rows sorted by anchor: between anchors, about every ``SORT_BYTES``."""
    anchor = rows.column("anchor").to_numpy()
    size = np.cumsum(pc.binary_length(rows.column("bytes")).to_numpy())
    ends, done = [], 0
    for change in (np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist():
        if size[change - 1] - done >= SORT_BYTES:
            ends.append(change)
            done = int(size[change - 1])
    return ends


def sorted_spans(chunks: DataFrame, length: int) -> DataFrame:
    """Repeated stretches among chunks that hold their bytes, anchor by anchor."""

    def solve(rows: pa.Table):
        buf, off = T.binary(rows.column("bytes"))
        anchor = rows.column("anchor").to_numpy()
        group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        owner, number = repeated_starts(buf, off, group, rows.column("at").to_numpy(),
                                        rows.column("nw").to_numpy(), length)
        owner, first, last = _spans(owner, number)
        took = rows.take(pa.array(owner))
        p0 = took.column("p0").to_numpy()
        return pa.RecordBatch.from_arrays(
            [took.column("id").combine_chunks(), took.column("h").combine_chunks(),
             pa.array(p0 + first), pa.array(p0 + last + length)], ["id", "h", "begin", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < SORT_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            ends = anchor_ends(rows)
            for lo, hi in zip([0, *ends], ends):
                yield solve(rows.slice(lo, hi - lo))
            if ends:  # the last anchor may go on in the next batch
                held = rows.slice(ends[-1]).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            ends = [*anchor_ends(rows), len(rows)]
            for lo, hi in zip([0, *ends], ends):
                yield solve(rows.slice(lo, hi - lo))

    return (chunks.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPANS))


def counted_spans(chunks: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many chunks: windows counted by digest."""

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("id"), batch.column("h").to_numpy(zero_copy_only=False)
            for i, (data, p0, windows) in enumerate(zip(
                    batch.column("bytes"), batch.column("p0").to_pylist(), batch.column("nw").to_pylist())):
                view = memoryview(data.as_py())
                digests = b"".join(xxhash.xxh3_128_digest(view[k:k + length]) for k in range(windows))
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i].as_py()] * windows, pa.string()), pa.array(np.full(windows, hashes[i])),
                     pa.array(np.arange(p0, p0 + windows)), pa.array(halves[:, 0].copy()),
                     pa.array(halves[:, 1].copy())], ["id", "h", "begin", "w1", "w2"])

    windows = chunks.mapInArrow(run, "id string, h long, begin long, w1 long, w2 long")
    often = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    return (windows.join(often, ["w1", "w2"])
            .select("id", "h", "begin", (F.col("begin") + length).alias("end")))


def remove_spans(data: bytes, spans) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    removed = runs = 0
    left, done = [], 0
    for begin, end in sorted(spans):
        if begin > done or runs == 0:
            left.append(data[done:begin])
            runs += 1
            removed += end - begin
            done = end
        elif end > done:
            removed += end - done
            done = end
    left.append(data[done:])
    return removed, runs, b"".join(left)


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED,
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Stretches (id, h, begin, end) of repeated bytes; ``docs`` is ``keyed``."""
    rows = cut(chunk_rows(docs, length, seed), "chunks")
    kinds = rows.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "p0", "nw", "at")).alias("rep"))
    anchors = (kinds.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("variants"))
               .where("total >= 2"))
    kinds = cut(kinds.join(anchors, "anchor"), "kinds")
    whole = (rows.join(kinds.where("n >= 2").select("anchor", "content"), ["anchor", "content"])
             .select("id", "h", F.col("p0").alias("begin"), (F.col("p0") + F.col("nw") + (length - 1)).alias("end")))
    search = kinds.where("variants >= 2").select("anchor", "variants", "rep.*")
    bytes_ = F.substring("text", F.col("p0") + 1, F.col("nw") + (length - 1))
    search = search.join(docs, ["id", "h"]).select(
        "anchor", "variants", "id", "h", "p0", "nw", "at", bytes_.alias("bytes"))
    small = search.where(F.col("variants") <= group_limit)
    large = search.where(F.col("variants") > group_limit)
    return whole.unionByName(sorted_spans(small, length)).unionByName(counted_spans(large, length))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id as text ('' for null), a hash of the text, and its bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED,
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Every document without its repeated bytes: (id, n_bytes, n_removed, n_spans, kept)."""
    rows = keyed(docs)
    spans = (repeated_spans(rows, length, seed, group_limit).groupBy("id", "h")
             .agg(F.collect_list(F.struct("begin", "end")).alias("spans")))

    def run(batches):
        for batch in batches:
            out = [(len(data), *remove_spans(data, [(x["begin"], x["end"]) for x in spans_ or ()]))
                   for data, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(list(c), pa.int64()) for c in columns[:3]],
                 pa.array(list(columns[3]), pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (rows.join(spans, ["id", "h"], "left").select("id", "text", "spans")
            .mapInArrow(run, "id string, n_bytes long, n_removed long, n_spans long, kept binary"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without bytes of repeated 400-byte strings."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.nullif(F.col("id"), F.lit("")).cast("long").alias("doc_id"),
                      "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
