import random

import numpy as np

from brute import blank_words, words
from packwright.llm.words import ALPHANUMERIC, BLANK_SEPARATED, fold_hash, phrase_hash, runs, slices, split_words

TEXTS = ["Hello  World", None, "Été ÉTÉ   x", "", "a\x0bb\x1cc\x85d e f", "x-y_z 9\x7f8", "\U0001f600 k"]


def test_words_are_those_of_the_patterns():
    raw = [None if t is None else t.encode() for t in TEXTS]
    for table, plain in ((ALPHANUMERIC, words), (BLANK_SEPARATED, blank_words)):
        found = split_words(raw, table)
        for i, text in enumerate(TEXTS):
            assert found.text(found.first[i], found.first[i + 1]) == plain(text)


def test_equal_words_have_equal_hashes_and_others_do_not():
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 9) for _ in range(50)) for _ in range(40)]
    found = split_words([t.encode() for t in texts], ALPHANUMERIC)
    spelled = found.text(0, len(found))
    assert len(set(zip(spelled, found.hash.tolist()))) == len(set(spelled)) == len(set(found.hash.tolist()))


def test_runs_stay_inside_texts():
    found = split_words([b"a b c", b"b c", b"", b"c"], ALPHANUMERIC)
    hashes, starts = runs(found, 2)
    assert starts.tolist() == [0, 1, 3] and hashes[1] == hashes[2] != hashes[0]
    assert fold_hash(phrase_hash("B C")[1], 0, 2) == int(hashes[1])
    assert len(runs(found, 4)[0]) == 0


def test_slices_cover_all_texts_once():
    texts = [b"x" * n for n in (5, 0, 30, 2, 2, 9)] + [None]
    ranges = list(slices(texts, 10))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(7))
    assert all(sum(len(t or b"") for t in texts[a:b]) <= 10 or b - a == 1 or sum(map(len, texts[a : b - 1])) == 0 for a, b in ranges)
    assert np.diff([a for a, _ in ranges]).min() > 0
