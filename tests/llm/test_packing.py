import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lotwise.llm.packing import (CapacityTree, WordTokenizer, best_fit_decreasing, op10_packing, pack_documents,
                                 tokenizer_path)
from lotwise.llm.tables import table

SMALL = "/root/testdata/sf0.001"
ODD = ["", "  \n", "it's I'VE don't, x.' \"quoted.\" a.\"b\" é, É. x 1,234.5% ½. <|endoftext|> a", "<|ENDOFTEXT|> A",
       "ΑΣ. ΟΔΟΣ, xΣ; Á. é, İstanbul! ﬁ. 中文。abc. \U0001f600!", "a\u0085b a\x1cb -- ... ??! #tag &amp; a|b| |",
       "\u0301abc. a.\u0301 b", "don'T. they'RE, we'll! 'S's. x's.", "x" * 9000, "a," * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_words_give_the_ids_of_the_whole_text(tokenizer):
    coder, rng = WordTokenizer(tokenizer_path(), cached_words=500), random.Random(2)
    letters = "abcXYZ019'’.,;:!?*#%&$|\"-<>_éßÉİΣ中½\u0301\u00a0 \t\n"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    for text in texts:
        assert coder.ids(text.encode()) == ids(tokenizer, text)[:-1].tobytes(), text
    assert len(coder._young) + len(coder._old) <= 1200


def test_tree_finds_the_tightest_capacity():
    rng, tree, held = random.Random(1), CapacityTree(64), []
    for _ in range(2000):
        if held and rng.random() < 0.5:
            size = rng.randint(0, 64)
            want = min((c for c in held if c >= size), default=None)
            assert tree.tightest(size) == want
        if held and rng.random() < 0.4:
            gone = held.pop(rng.randrange(len(held)))
            tree.add(gone, -1)
        else:
            held.append(rng.randint(0, 64))
            tree.add(held[-1])


def test_best_fit_matches_a_plain_search():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    number, offset = best_fit_decreasing(lengths, 100)
    left = []
    for size, at, begin in zip(lengths, number, offset):
        fits = [c for c in left if c >= size]
        if fits:
            assert left[at] == min(fits)
        else:
            assert at == len(left)
            left.append(100)
        assert begin == 100 - left[at]
        left[at] -= size


def check(tokenizer, docs, got):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        own = ids(tokenizer, text)
        parts = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        assert sum(r.length for r in parts) == len(own) == parts[0].doc_tokens
        for r in parts:
            assert zlib.crc32(own[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for parts in sequences.values():
        end = 0
        for begin, length in sorted(parts):
            assert begin == end
            end += length
        assert end <= 4096
        total += 0 if end & (end - 1) == 0 else 4096 - end
    return total / sum(r.length for r in got)


def test_round_trip_of_odd_documents(spark, tokenizer):
    docs = [(i, t) for i, t in enumerate(ODD + [None])]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, length int")
    check(tokenizer, docs, pack_documents(frame).collect())


def test_whole_table_has_little_padding(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert check(tokenizer, docs, op10_packing(spark, SMALL).collect()) < 0.02


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = pack_documents(docs).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert pack_documents(docs.where("false")).collect() == []


def test_words_of_several_texts_are_coded_at_once():
    """New letter words need no offsets; those that the vocabulary takes apart go the long way."""
    coder, calls = WordTokenizer(tokenizer_path()), []

    class Counted:
        def __getattr__(self, name, inner=coder._tokenizer):
            calls.append(name)
            return getattr(inner, name)

    texts = [t.encode() for t in ("thwhthre reanatoron, queraasrrñue laéeuxmentoi", "", "eawhan THWHTHRE. ofereresin",
                                  "世界 пример ﬁn ª ǅ")]
    whole = [coder.whole(t) for t in texts]
    coder._tokenizer = Counted()
    assert coder.many(texts) == whole
    assert calls.count("encode_batch_fast") == 1 and calls.count("encode") == 1  # the comma and the full stop
    odd = ["İstanbul dİ ẞ ŉa ΑΣ ab", "x́y é é é é", "a1b2 don't 're ab#cd"]
    coder = WordTokenizer(tokenizer_path())
    assert coder.many([t.encode() for t in odd]) == [coder.whole(t.encode()) for t in odd]
