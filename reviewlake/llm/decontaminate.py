"""Benchmark decontamination: windows laid at shared runs of words, exact edit verification of each.

A document holds an item if some window of it is within ``floor(EDIT_SHARE * n)`` word edits of the item's n words.
Windows that can be so close share a run of unchanged words with the item (edits leave one of at least
ceil((n - k) / (k + 1)) words), so item-sized windows are laid where a run of that length matches. Word edit distance
decides on each of them, with k words more at both ends, so none is lost at any length. There is no filter in between: CGK
embeddings with bit-sampling LSH, which stood here before, lost leaks of longer items, as every edit parts the random walks for
longer, and their walks took more time than the distance in bits does.

Words are maximal runs of ASCII letters, digits and underscores and of characters beyond ASCII, with A-Z lower-cased. Benchmarks go through in blocks of ``BLOCK_BYTES``,
each broadcast, so a benchmark of any size works. Nulls: null texts and items, and those without words, match nothing; null
ids are kept as null. Items that repeat a text each match. Repeated documents are each matched; several windows of a
document and item give the nearest, then first. Empty tables give no rows. Other columns are neither read nor in the way.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.hashing import PUNCTUATION, mix, word_hashes

EDIT_SHARE, BLOCK_BYTES = 0.2, 4 << 20
_U = np.uint64


def edits_allowed(n: int) -> int:
    return n * 20 // 100


def sure_run(n: int) -> int:
    """Words in a row that any window within the allowed edits of an item of n words leaves unchanged."""
    k = edits_allowed(n)
    return max(1, math.ceil((n - k) / (k + 1)))


def places(item: list[int]) -> dict[int, int]:
    """The positions of each word of the item, as bits."""
    out: dict[int, int] = {}
    for i, word in enumerate(item):
        out[word] = out.get(word, 0) | 1 << i
    return out


def edit_distance(bits: dict[int, int], n: int, region: list[int], most: int) -> int:
    """Least word edits between an item of n words, given by its ``places``, and any part of the region; ``most + 1`` if
    more than ``most``.

    A column of the distance matrix is held as bits of where it rises and falls (Myers), so a word of the region takes a
    few operations on numbers of n bits.
    """
    if sum(map(bits.__contains__, region)) < n - most:  # words that stay are in both
        return most + 1
    every, last = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = every, 0, n
    least = n
    for word in region:
        same = bits.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(across | up)), up & across
        if rise & last:
            edits += 1
        elif fall & last:
            edits -= 1
            least = min(least, edits)
        rise, same = rise << 1 & every, same | down
        up, down = (fall << 1 & every) | (every & ~(same | rise)), rise & same
    return min(least, most + 1)


def numbers(texts: list[str | None]) -> list[np.ndarray]:
    """The words of each text as numbers (their hashes)."""
    return [w.view(np.int64) for w in word_hashes([(t or "").encode().lower() for t in texts], PUNCTUATION)]


class Index:
    """A block of items: their words as numbers, and where each sure run of an item begins."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.sizes, self.ids = [], [], []
        runs: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for (item_id, _), words in zip(items, numbers([text for _, text in items])):
            if len(words):
                g = sure_run(len(words))
                for at, h in enumerate(run_hashes(words, g).tolist()):
                    runs[g][h].append((len(self.items), at))
                self.items.append(places(words.tolist()))
                self.sizes.append(len(words))
                self.ids.append(item_id)
        self.runs = {}
        for g, found in runs.items():
            keys = np.array(sorted(found), _U)
            seen = np.zeros(1 << 20, bool)  # settles most runs of documents at once
            seen[(keys >> _U(44)).astype(np.int64)] = True
            self.runs[g] = keys, seen, dict(found)

    def starts(self, words: list[np.ndarray]):
        """(text number, item, where its window starts) for all matching runs."""
        found = set()
        together = np.concatenate([np.empty(0, np.int64), *words])
        ends = np.cumsum([len(w) for w in words])
        for g, (keys, seen, where) in self.runs.items():
            if len(together) < g:
                continue
            h = run_hashes(together, g)
            at = np.flatnonzero(seen[(h >> _U(44)).astype(np.int64)])
            h = h[at]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at, h = at[keys[place] == h], h[keys[place] == h]
            text = np.searchsorted(ends, at, side="right")
            inside = at + g <= ends[text]
            first = at - (ends - [len(w) for w in words])[text]
            for i, p, key in zip(text[inside].tolist(), first[inside].tolist(), h[inside].tolist()):
                found.update((i, item, p - q) for item, q in where[key])
        return sorted(found)

    def matches(self, words: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text number, item number, edits, first word of the window), nearest window of each text and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i, item, start in self.starts(words):
            n, k = self.sizes[item], edits_allowed(self.sizes[item])
            region = words[i][max(0, start - k) : max(0, start + n + k)].tolist()
            edits = edit_distance(self.items[item], n, region, k)
            if edits <= k:
                best[i, item] = min(best.get((i, item), (edits, start)), (edits, start))
        return [(i, item, edits, max(0, start)) for (i, item), (edits, start) in sorted(best.items())]


def run_hashes(words: np.ndarray, g: int) -> np.ndarray:
    """Hashes of the g words from each position on."""
    n = max(0, len(words) - g + 1)
    h = np.full(n, g, _U)
    for k in range(g):
        h = mix(h * _U(0x9E3779B97F4A7C15) + words[k : k + n].view(_U))
    return h


def _run(shared):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(texts), 256):
                found = index.matches(numbers(texts.slice(lo, 256).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([lo + i for i, *_ in found], pa.int64())),
                        pa.array([index.ids[item] for _, item, _, _ in found], pa.int64()),
                        pa.array([index.sizes[item] for _, item, _, _ in found], pa.int32()),
                        pa.array([edits for _, _, edits, _ in found], pa.int32()),
                        pa.array([start for *_, start in found], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "item_words", "edits", "first_word"],
                )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_words, edits, first_word: one row per document and item that it holds."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 + total // block_bytes
    texts = docs.where("text is not null").select("doc_id", "text")
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, item_words int, edits int, first_word long"
    out = None
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        block_items = spark.sparkContext.broadcast(sorted(((r[0], r[1]) for r in some.collect()), key=repr))
        found = texts.mapInArrow(_run(block_items), schema)
        out = found if out is None else out.unionByName(found)
    return out


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; rows with a null id go by their text."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = leaks(docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), "text"), benchmark)
    bad = found.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.key").alias("_key")).distinct()
    rows = docs.select("*", key.alias("_key_"))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_id"]) & (rows["_key_"] == bad["_key"]), "left_anti").drop("_key_")
