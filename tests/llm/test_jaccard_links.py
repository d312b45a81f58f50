"""All links against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import jaccard_join
from reviewlake.llm.components import connected


@pytest.mark.parametrize("block", [8192, 3])
def test_links(spark, block):
    random = np.random.default_rng(1)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(60)]
        for copy in range(7):
            words = list(base)
            for k in range(copy):
                words[int(random.integers(60))] = f"c{copy}x{k}"
            rows.append((100 * family + copy, " ".join(words)))
    rows += [(50, rows[0][1]), (51, rows[3][1]), (52, ""), (53, None)]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} if t else set() for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = jaccard_join.links(table, 3, 80, block)
    of = {r.doc_id: r.class_id for r in members.collect()}
    found = {tuple(r) for r in pairs.collect()}
    assert found == {(min(of[a], of[b]), max(of[a], of[b])) for a, b in linked if of[a] != of[b]}
    assert {(a, b) for a, b in linked if of[a] == of[b]} == {(0, 50), (3, 51)}
    n = {r.doc_id: r.n_links for r in jaccard_join.links_per_document(table, 3, 80, block).collect()}
    assert n == {i: sum(i in pair for pair in linked) for i in sets}


def test_texts_without_an_id_make_linear_rows(spark):
    """Unlike texts under the null id meet the texts of their own groups only."""
    def rows_of(m):
        rows = [(None, f"{' '.join(f'w{i}x{k}' for k in range(30))} tail{c}") for i in range(m) for c in range(2)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        _, candidates = jaccard_join._candidates(docs, 3, 80, 8192)
        return candidates.count()

    few, many = rows_of(20), rows_of(80)
    assert 20 <= few <= 20 * 4 and many <= 5 * few


def test_parts_of_long_texts_are_bounded():
    """A task holds the sets of so many bytes of text at once, and of one text that is longer."""
    size = jaccard_join.PART_BYTES
    texts = ["a" * (size // 4)] * 9 + [None, "b" * (2 * size), "", "c"]
    parts = list(jaccard_join._parts_of([pa.RecordBatch.from_pydict({"text": texts})], 4096))
    assert [t for part in parts for t in part.column("text").to_pylist()] == texts
    assert [part.num_rows for part in parts] == [4, 4, 2, 1, 2]
    short = pa.RecordBatch.from_pydict({"text": ["d"] * 10})
    assert [part.num_rows for part in jaccard_join._parts_of([short, short], 4)] == [4, 4, 2] * 2
    assert list(jaccard_join._parts_of([short.slice(0, 0)])) == []


def test_keys_are_dealt_evenly(spark, monkeypatch):
    """Each task has its share of the buckets of keys."""
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(jaccard_join, "PARTITION_BYTES", 4000)
    seen = []

    def count(batches):
        import pyarrow

        n = sum(len(own.values) for batch in batches for own in batch.column("set") if own.is_valid)
        yield pyarrow.RecordBatch.from_arrays([pyarrow.array([n]), pyarrow.array([0])], names=["u", "v"])

    monkeypatch.setattr(jaccard_join, "_match", count)
    monkeypatch.setattr(jaccard_join, "connected", lambda pairs, name: seen.append(pairs) or connected(pairs, name))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(200)]
    jaccard_join._candidates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 8192)
    sizes = [r.u for r in seen[0].collect()]
    assert len(sizes) > 10 and max(sizes) < 2 * sum(sizes) / len(sizes)
