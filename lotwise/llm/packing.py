"""Packing token sequences: best-fit decreasing over a segment tree.

Each document is tokenised once.  Documents longer than a window are first cut
into full windows; their rest and the shorter documents are packed by
best-fit decreasing.  A segment tree over the remaining capacities 0..window
finds the tightest open window that holds a piece.

Only piece descriptors (ids, lengths, checksums) are shuffled, never texts or
tokens.  Blocks of about ``block_pieces`` pieces, dealt by a hash, are packed
independently, so a task's memory does not grow with the corpus; a block loses
at most its last open windows.

Defined results: a null or empty text is the end id alone; repeated rows and
null ids are packed like any other row; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import text as T
from lotwise.llm.tables import cut, table

WINDOW = 4096
END_ID = 2
BLOCK_PIECES = 32768
CACHED_WORDS = 1 << 18
#: Bytes of text whose new words are encoded at once.
CODED_BYTES = 1 << 18
#: Words of one call, so that a letter to be taken apart sends few words the long way.
CODED_WORDS = 256

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
PACKED = PIECES + ", sequence_id long, offset long"


# Punctuation that the pre-tokeniser parts from a letter or digit
# before it; no apostrophes, since contractions are words of their own.
# The set of marks stands first, so that the search skips to the next mark.
_MARKS = rb"[.,;:!?*#%&$|]"
TAIL = re.compile(rb"(" + _MARKS + rb"(?<=[a-z0-9]" + _MARKS + rb")" + _MARKS + rb"*)(?=[ \t\n\r\x0b\x0c]|\Z)")
# Fixed value: the mark of a vocabulary entry that ends a run of letters or marks.
WORD_END = "</w>"


class WordTokenizer:
    """Token ids of a text, word by word, with a bounded cache of words in two generations.

    A new word enters the young generation; when that holds half of
    ``cached_words`` it becomes the old one, and what was old and not used since
    is forgotten.  The cache outlives a task, since the next task of a worker
    meets mostly the same words.

    The vocabulary lower-cases texts, and its pre-tokeniser never joins
    characters across ASCII white space, nor letters or digits with a run of
    punctuation; white space is dropped.  So the ids of a text are those of its
    lower-cased words and of the punctuation after them, in turn.  Texts with
    the opening of a special token are encoded whole.  Ids are little-endian
    unsigned 32-bit bytes.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._limit = max(1, cached_words // 2)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        ids = self._tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Cache the words' ids: one encoding of all of them, cut at their places."""
        coded = self._tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        at = np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded.ids))
        self._keep(words, np.asarray(coded.ids, "<u4"), np.searchsorted(at, starts))

    def _learn_letters(self, words: list[str]) -> None:
        """Likewise for words of letters alone, without the places: each ends at the next end of a run."""
        ids = self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        coded = np.asarray(ids, "<u4")
        ends = np.flatnonzero(self._ends[coded]) + 1
        if len(ends) == len(words):
            self._keep(words, coded, np.concatenate(([0], ends)))
        else:  # a letter that lower case or the vocabulary's own tables take apart
            self._learn(words)

    def _keep(self, words: list[str], coded: np.ndarray, cuts: np.ndarray) -> None:
        ids, cuts = coded.tobytes(), (4 * cuts).tolist()
        self._young.update((w.encode(), ids[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))

    def _know(self, words: dict[bytes, None]) -> None:
        """Bring all the words into the young generation."""
        young, old = self._young, self._old
        missing = [w for w in words if w not in young]
        if missing:
            young.update((w, old[w]) for w in missing if w in old)
            new = [w for w in missing if w not in old]
            new = [w.decode("utf-8") for w in new]
            letters = [w for w in new if w.isalpha()]
            for at in range(0, len(letters), CODED_WORDS):
                self._learn_letters(letters[at:at + CODED_WORDS])
            others = [w for w in new if not w.isalpha()]
            for at in range(0, len(others), CODED_WORDS):
                self._learn(others[at:at + CODED_WORDS])

    def ids(self, text: bytes) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; the words that are new in all of them are encoded at once."""
        split = [None if b"<|" in t else TAIL.sub(rb" \1", t.lower()).split() for t in texts]
        self._know(dict.fromkeys(chain.from_iterable(words for words in split if words)))
        known = self._young.__getitem__
        out = [self.whole(t) if words is None else b"".join(map(known, words)) for t, words in zip(texts, split)]
        if len(self._young) > self._limit:
            self._old, self._young = self._young, {}
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows of each document, then its rest, with checksums of their ids."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        coder = _tokenizer(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            _, offsets = T.binary(texts)
            for lo, hi in T.slices(offsets, CODED_BYTES):
                for doc_id, ids in zip(doc_ids[lo:hi], coder.many(texts.slice(lo, hi - lo).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        part = ids[4 * start:4 * (start + window)]
                        out.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        T.release()

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long"), text.alias("text")).mapInArrow(run, PIECES)


class CapacityTree:
    """Counts of open windows by remaining capacity, as a segment tree.

    ``tightest(size)`` gives the smallest capacity >= size that has a window.
    """

    def __init__(self, window: int):
        self.leaves = 1 << int(window).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int = 1) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, size: int) -> int | None:
        count, node = self.count, size + self.leaves
        if count[node]:
            return size
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.leaves


def best_fit_decreasing(lengths, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset for each length, given in decreasing order."""
    tree = CapacityTree(window)
    open_by_capacity: dict[int, list[int]] = {}
    number, offset, opened = [], [], 0
    for size in lengths:
        capacity = tree.tightest(size)
        if capacity is None:
            at, capacity, opened = opened, window, opened + 1
        else:
            at = open_by_capacity[capacity].pop()
            tree.add(capacity, -1)
        number.append(at)
        offset.append(window - capacity)
        if capacity > size:
            open_by_capacity.setdefault(capacity - size, []).append(at)
            tree.add(capacity - size)
    return number, offset


def pack(piece_rows: DataFrame, window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Assign each piece a sequence and an offset; ``piece_rows`` must be stored."""
    blocks = max(1, -(-piece_rows.count() // block_pieces))
    keyed = piece_rows.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))

    def run(key, table_):
        table_ = table_.sort_by([("length", "descending"), ("doc_id", "ascending"),
                                 ("start", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_fit_decreasing(table_.column("length").to_pylist(), window)
        base = key[0].as_py() << 32
        return (table_.drop_columns(["block"])
                .append_column("sequence_id", pa.array([base + n for n in number], pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    return keyed.groupBy("block").applyInArrow(run, PACKED)


def tokenizer_path() -> str:
    """The lower-case word vocabulary that the installed package provides."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path()), "pieces"))
