"""Hashes of words and windows over whole byte buffers, in numpy; the same text gives the same numbers everywhere."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that are hashed at once; longer texts are cut between words.
CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters, digits and the underscore; what lies beyond ASCII belongs to words.
PUNCTUATION = np.array([i < 128 and not (chr(i).isalnum() or i == 95) for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_tables: list[np.ndarray] = []


def _powers_and_inverses() -> list[np.ndarray]:
    if not _tables:
        _tables.extend([_powers(_BASE, CHUNK + 2), _powers(pow(_BASE, -1, 2**64), CHUNK + 2)])
    return _tables


def _hash_chunk(data: bytes, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other bytes than those ``between``) and where they start."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, np.int8)
    blank[1:-1] = between[raw]
    change = np.diff(blank)
    starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    power, inverse = _powers_and_inverses()
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U)), starts


def word_hashes(texts: list[bytes], between: np.ndarray = _BLANK) -> list[np.ndarray]:
    """For each text the hashes of its words, in order."""
    out: list[np.ndarray] = [np.empty(0, _U)] * len(texts)
    block: list[int] = []
    size = 0

    def flush():
        nonlocal size
        if block:
            hashes, starts = _hash_chunk(b"\n".join(texts[i] for i in block), between)
            ends = np.cumsum([len(texts[i]) + 1 for i in block])
            cut = np.searchsorted(starts, ends)
            for i, part in zip(block, np.split(hashes, cut[:-1])):
                out[i] = part
            block.clear()
            size = 0

    for i, text in enumerate(texts):
        if len(text) >= CHUNK:
            out[i] = np.concatenate(list(_long_text(text, between)))
            continue
        if size + len(text) + 1 > CHUNK:
            flush()
        block.append(i)
        size += len(text) + 1
    flush()
    return out


def _long_text(text: bytes, between: np.ndarray):
    raw = np.frombuffer(text, np.uint8)
    start = 0
    while start < len(text):
        end = min(start + CHUNK, len(text))
        if end < len(text):
            cuts = np.flatnonzero(between[raw[start + 1 : end]])
            if len(cuts):
                end = start + 1 + int(cuts[-1])
            else:  # a word longer than a chunk, up to its end
                while end < len(text) and not len(cuts := np.flatnonzero(between[raw[end : end + CHUNK]])):
                    end += CHUNK
                end = end + int(cuts[0]) if end < len(text) else len(text)
                word = text[start + int(between[raw[start]]) : end]
                if len(word) > CHUNK:
                    yield np.array([int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")], _U)
                else:
                    yield _hash_chunk(word, between)[0]
                start = end
                continue
        yield _hash_chunk(text[start:end], between)[0]
        start = end


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles of ``n`` words, sorted; fewer words make one shingle; none make none."""
    if not len(words):
        return words
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, _U)
    for k in range(width):
        h = mix(h * _U(_BASE) + words[k : len(words) - width + 1 + k])
    return np.unique(h)
