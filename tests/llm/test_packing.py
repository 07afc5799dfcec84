import zlib
from collections import defaultdict

import numpy as np
import pytest

from laurel.llm import packing


def check(rows, texts, window):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {d: np.array(full.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            assert r["ids_crc32"] == zlib.crc32(ids[doc][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_every_id_lies_in_one_piece(odd, odd_rows):
    unique = {r[0]: r[1] for r in odd_rows if r[0] is not None and r[0] != 1}
    df = odd.filter("doc_id is not null and doc_id != 1")
    check(packing.pack(df, window=256, wait=4).collect(), unique.items(), 256)


def test_registered_query(spark, small_rows):
    from laurel.llm.queries import op10_packing

    check(op10_packing(spark, "/root/testdata/sf0.001").collect(), [(r[0], r[1]) for r in small_rows], 2048)


def test_missing_ids_repeated_rows_and_empty_table(odd, odd_rows, empty):
    rows = packing.pack(odd).collect()
    assert sum(r["start"] == 0 for r in rows) == len(odd_rows)
    assert sum(r["start"] == 0 and r["doc_id"] is None for r in rows) == 3
    assert packing.pack(empty).collect() == []


@pytest.mark.parametrize("text", ["a  b", " a b", "a b ", "a\n b", "x<|endoftext|>y z", "é  ü", "", "a  b", "one two's 3 4,5!\n\nnext"])
def test_words_apart_give_the_ids_of_the_whole(text):
    words = packing.tokeniser(None, None, None)
    expected = words.full.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == expected


def test_least_squares_meets_a_histogram():
    histogram = np.zeros(33, int)
    histogram[[8, 16, 24]] = 100, 50, 100
    used = dict(packing.recipe(histogram, 2048, 32, 3))
    spent = np.zeros(33)
    for c, n in used.items():
        for k in c:
            spent[k] += n
    assert np.abs(spent - histogram).max() <= 4
