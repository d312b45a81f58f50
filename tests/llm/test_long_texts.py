"""Words of texts beyond one chunk are those of the same text in parts."""

import numpy as np
import pytest

from reviewlake.llm import decontaminate, hashing


@pytest.mark.parametrize("mark", ["-", ",", "+", "<i>", " "])
def test_words_of_a_long_text(mark):
    parts = [mark.join(f"w{i}" for i in range(lo, lo + 1000)) for lo in range(0, 300_000, 1000)]
    one = hashing.word_hashes([mark.join(parts).encode()], hashing.PUNCTUATION)[0]
    parts = np.concatenate(hashing.word_hashes([p.encode() for p in parts], hashing.PUNCTUATION))
    assert len(mark.join(str(i) for i in range(300_000))) > hashing.CHUNK
    if mark == "<i>":
        one, parts = one[one != hashing.word_hashes([b"i"])[0][0]], parts[parts != hashing.word_hashes([b"i"])[0][0]]
    assert one.tolist() == parts.tolist()


@pytest.mark.parametrize("n", [hashing.CHUNK - 2, hashing.CHUNK - 1, hashing.CHUNK, 3 * hashing.CHUNK + 5])
def test_long_words(n):
    word = b"x" * n
    alone = hashing.word_hashes([word], hashing.PUNCTUATION)[0].tolist()
    a, b = (hashing.word_hashes([x], hashing.PUNCTUATION)[0].tolist()[0] for x in (b"a", b"b"))
    assert len(alone) == 1
    for text in (b"a-" + word + b"+b", b"a--" + word + b"\nb"):
        assert hashing.word_hashes([text], hashing.PUNCTUATION)[0].tolist() == [a, *alone, b]


def test_leak_in_a_long_text_without_blanks():
    item = [f"q{i}" for i in range(30)]
    text = "-".join([*(f"w{i}" for i in range(200_000)), *item, "end"])
    index = decontaminate.Index([(1, " ".join(item))])
    assert len(text) > hashing.CHUNK
    assert [(i, item, edits) for i, item, edits, _ in index.matches(decontaminate.numbers([text]))] == [(0, 0, 0)]
