"""A short phrase that many documents hold with different neighbours."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from reviewlake.llm import suffix_dedup
from test_operators import _cut

PHRASE = "share this page with your best friends now"  # 42 bytes: the first rank of some windows is the same as well


def _text(i):
    own = lambda x: hashlib.md5(f"{x} {i}".encode()).hexdigest()
    return f"{own('a')}{PHRASE}{own('b')}"


def test_windows_spread():
    texts = [_text(i).encode() for i in range(400)]
    key, value, text, lo, width = suffix_dedup.runs(texts)
    _, several = suffix_dedup.settle(key, value, text, np.zeros(len(key), bool))
    assert several.sum() >= 400
    of = [np.flatnonzero(several & (text == i)) for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(400), pa.int64()), "tag": pa.array([0] * 400, suffix_dedup._SENT[2][1]),
        "text": pa.array([t.decode() for t in texts]),
        "lo": pa.array([lo[o].tolist() for o in of], pa.list_(pa.int32())),
        "width": pa.array([(width[o] + suffix_dedup._EXPAND).tolist() for o in of], pa.list_(pa.int8())),
    })
    sent = Counter()
    for out in suffix_dedup._round_two(16)([batch]):
        for bucket, keys in zip(out.column("bucket").to_pylist(), out.column("key").to_pylist()):
            sent[bucket] += len(keys or [])
    assert len(sent) == 16 and max(sent.values()) < 2 * sum(sent.values()) / 16


def test_hot_phrase_is_exact(spark):
    rows = [(i, _text(i)) for i in range(60)]
    rows += [(100 + i, _text(i)[20:90] + f" other end {i}") for i in range(0, 60, 3)] + [(None, _text(7)[10:])]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((repr(r.doc_id), r.n_removed, bytes(r.kept)) for r in found) == sorted((repr(i), n, k) for i, n, k in _cut(rows))
