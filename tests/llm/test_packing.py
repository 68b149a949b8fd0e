import zlib

import numpy as np
import pytest

from halyard.llm import packing


def test_ids_equal_the_tokenizer_file():
    from tokenizers import Tokenizer

    slow, enc = Tokenizer.from_file(packing.vocabulary()), packing.encoder(packing.vocabulary())
    texts = ["", "Hello  world\n\n x", "é ß ñ 12 ’t don't", "<|endoftext|> a", "漢字 x", " " * 5000, "\x00\x1f\x7f\x85\xa0"]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 {chr(c)} .{chr(c)}' {chr(c)}\n{chr(c)}" for c in range(0, packing.SAME_BELOW, 7)]
    for t in texts:
        assert enc.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n,expected", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)])])
def test_cut(n, expected):
    assert packing.cut(n) == expected


def test_place_fills_bins_without_overlap():
    lengths = np.sort(np.random.default_rng(3).integers(1, 1025, 4000))[::-1]
    bins, offsets = packing.place(lengths)
    ends = np.zeros(bins.max() + 1, int)
    for b, o, n in zip(bins, offsets, lengths):
        assert o == ends[b]
        ends[b] += n
    assert ends.max() <= 1024
    assert bins.max() + 1 <= np.ceil(lengths.sum() / 1024) * 1.02


def test_place_equals_the_plain_rule():
    def plain(items, c):
        bins = []
        for s in items:
            def squares(k):
                gaps = [c - sum(b) - (s if i == k else 0) for i, b in enumerate(bins)]
                return sum(gaps.count(g) ** 2 for g in set(gaps) if g)
            fits = [k for k, b in enumerate(bins) if sum(b) + s <= c]
            if fits:
                bins[min(fits, key=lambda k: (squares(k), c - sum(bins[k])))].append(s)
            else:
                bins.append([s])
        return len(bins), sorted(map(sum, bins))

    pick = np.random.default_rng(4)
    for _ in range(30):
        items = sorted(pick.integers(1, 13, 20).tolist(), reverse=True)
        bins, _o = packing.place(items, 12)
        assert plain(items, 12) == (bins.max() + 1, sorted(np.bincount(bins, items).astype(int).tolist()))


def test_pack_rows(spark):
    rows = [(1, "a b", "z"), (1, "a b", "z"), (None, None, "z"), (2, "", "z"), (3, "word " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    found = packing.pieces(df)
    got = packing.pack(found, 2).collect()
    assert len(got) == found.count()
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    long = sorted((r.start, r.length) for r in got if r.doc_id == 3)
    assert all(n == 1024 for _, n in long[1:]) and long[0][0] == 0
    empty = [r for r in got if r.doc_id in (None, 2)]
    assert all(r.length == 1 and r.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) for r in empty)
    assert packing.pack(packing.pieces(df.limit(0)), 1).count() == 0
