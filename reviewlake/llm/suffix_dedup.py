"""Exact substring dedup by winnowing and two rounds of hash matching, in place of prefix doubling over all suffixes.

A byte goes if a ``LENGTH``-byte string covers it that also starts in a document with a smaller doc_id.

Ranks are hashes of prefixes, computed to full length inside each text; they are equal for equal bytes (but for collisions) and say
nothing of order. Spark deals packed rows by bucket and sorts them by bucket number only; nothing is ranked anew across documents.
Each window of ``LENGTH`` bytes samples the position with the least rank of ``PREFIX`` bytes in it, which depends on the window's
bytes alone, so equal windows sample equal prefixes. Round one brings equal samples together; those that no other document has
are unique and drop out. Neighbouring windows with the same sample form a run; runs whose whole byte range is equal are
settled by the rank of that range. What is left, runs that agree on the prefix but not on the whole range, is cut into parts of up to
``PART`` windows by their distance from the sample; parts are compared in the same way, by the bytes that all windows at these distances
share and by their whole range. Round two takes what agrees on the first but not on the second, and
compares windows by pairs of ranks that cover all ``LENGTH`` bytes, so no more rounds are needed. Windows are dealt by that pair, so that only equal ones meet: a phrase that many documents
hold with different neighbours, of one sample, spreads over all tasks. Each round is written and its shuffles go before the next one.

Before each shuffle a task settles its own part and sends equal runs once, so a string that a third of all documents
hold takes a row per task, not per document. Matches never cross documents. Nulls: a null text is empty; a null doc_id is
smaller than all others. Rows that repeat an id don't remove each other's bytes. Long texts are whole. An empty table
gives no rows. Columns beyond doc_id and text are neither read nor in the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.llm.common import NULL_ID, may_be_in, real_id, repeated_keys, whole
from reviewlake.llm.hashing import _BASE, _BYTE, mix
from reviewlake.llm.packing import by_bucket, flat, from_low_high, groups, halves, joined, lists, low_high
from reviewlake.session import materialize

LENGTH, PREFIX = 50, 20
SAMPLES = LENGTH - PREFIX + 1
PART = 8  # distances from the sample that are one part of a run; LENGTH - PART + 1 bytes have to be covered by three prefixes
CHUNK, UNIT, BUCKET_BYTES, PARTITION_BYTES = 1 << 16, 4 << 20, 12 << 20, 24 << 20
BUCKET_WINDOWS, PARTITION_WINDOWS = 1 << 18, 1 << 19
_U = np.uint64
_EXPAND = 64  # added to the width of a run that round two is to look at
SPANS = "doc_id long, tag long, lo array<int>, width array<tinyint>"


def prefix_ranks(raw: np.ndarray, n: int) -> np.ndarray:
    """Rank of the n bytes from each position on: equal for equal bytes."""
    ranks, width = _BYTE[raw], 1
    for bit in bin(n)[3:]:  # the binary digits after the first: double, and add one where the digit says so
        size = max(0, len(raw) - 2 * width + 1)
        ranks = ranks[:size] * _U(pow(_BASE, width, 2**64)) + ranks[width : width + size]
        width *= 2
        if bit == "1":
            size = max(0, len(raw) - width)
            ranks = ranks[:size] * _U(_BASE) + _BYTE[raw[width : width + size]]
            width += 1
    return mix(ranks)


def sampled(ranks: np.ndarray) -> np.ndarray:
    """For each window the first position of the least rank among the ``SAMPLES`` that begin with its own."""
    at, width = np.arange(len(ranks), dtype=np.int32), 1
    while width < SAMPLES:
        step = min(width, SAMPLES - width)
        first = ranks[:-step] <= ranks[step:]
        ranks = np.where(first, ranks[:-step], ranks[step:])
        at = np.where(first, at[:-step], at[step:])
        width += step
    return at


def pair_ranks(ranks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank pair of the windows at the given positions: ranks doubled at offset ``PREFIX``, then paired at the offset
    that reaches ``LENGTH`` bytes."""
    double = lambda x: mix(ranks[x] * _U(5) + ranks[x + PREFIX])
    return double(at), double(at + LENGTH - 2 * PREFIX)


def range_ranks(ranks: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Ranks of all bytes of the windows from ``lo`` to ``hi``, and of where the sample is in them."""
    a, b = pair_ranks(ranks, lo)
    c, d = pair_ranks(ranks, hi)
    shape = ((at - lo).astype(_U) << _U(8)) + (hi - lo).astype(_U)
    return mix(mix(mix(a + shape) + b) + mix(c * _U(3) + d))


def _chunks(texts: list[bytes]):
    """(bytes, text number of each piece, its start in that text, its length), windows beginning in a piece being whole."""
    parts, of, start, size = [], [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            piece = text[lo : lo + CHUNK + LENGTH - 1]
            parts.append(piece)
            of.append(i)
            start.append(lo)
            size += len(piece)
            if size >= CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(of), np.array(start), np.array([*map(len, parts)])
                parts, of, start, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(of), np.array(start), np.array([*map(len, parts)])


def runs(texts: list[bytes]):
    """Of all texts: sample rank, rank of the whole range, text number, first window, windows less one."""
    out = []
    for raw, of, start, lengths in _chunks(texts):
        ranks = prefix_ranks(raw, PREFIX)
        sample = sampled(ranks)
        ends = np.cumsum(lengths)
        window = np.flatnonzero(np.repeat(ends, lengths)[: len(sample)] - np.arange(len(sample)) >= LENGTH)
        own = sample[window]
        cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(window) != 1))
        lo, hi = window[np.append(0, cut + 1)], window[np.append(cut, len(window) - 1)]
        at = sample[lo]
        whole_range = range_ranks(ranks, at, lo, hi)
        piece = np.searchsorted(ends, lo, side="right")
        first = lo - (ends - lengths)[piece] + start[piece]
        out.append((ranks[at], whole_range, of[piece], first, hi - lo))
    if not out:
        return tuple(np.empty(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def parts(context: list[bytes], width: np.ndarray):
    """Of runs given by their bytes, cut by distance from the sample: rank of the shared bytes, rank of the whole range, run, first
    window in it, windows less one."""
    size = np.array([*map(len, context)], np.int64)
    start = np.cumsum(size) - size
    ranks = prefix_ranks(np.frombuffer(b"".join(context), np.uint8), PREFIX)
    at = sampled(ranks)[start]
    # the nearest and the farthest part that a run has windows of, the farthest coming first in the text
    far, near = (at - start) // PART, (at - start - width) // PART
    n = far - near + 1
    run = np.repeat(np.arange(len(n)), n)
    part = far[run] - (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    at, start = at[run].astype(np.int64), start[run]
    lo = np.maximum(at - part * PART - (PART - 1), start)
    hi = np.minimum(at - part * PART, start + width[run])
    shared = at - part * PART
    key = mix(mix(ranks[shared] * _U(5) + ranks[shared + PREFIX]) + ranks[shared + LENGTH - PART + 1 - PREFIX] * _U(3) + part.astype(_U))
    return key, range_ranks(ranks, at, lo, hi), run, lo - start, hi - lo


def settle(key: np.ndarray, value: np.ndarray, doc: np.ndarray, marks: np.ndarray):
    """(later, several): whether a smaller document has the same key and value, and whether the key has more values.

    ``marks`` are rows that only say that another task saw several values of the key.
    """
    order = np.lexsort((doc, value, key))
    k, v, d, m = key[order], value[order], doc[order], marks[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, v[1:] != v[:-1]) | np.append(True, m[1:] != m[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    group = np.cumsum(new_key) - 1
    values = np.bincount(group[new & ~m], minlength=group[-1] + 1 if len(group) else 0)
    several = (values[group] > 1) | (np.bincount(group, weights=m)[group] > 0 if len(group) else m)
    later_, several_ = np.empty(len(key), bool), np.empty(len(key), bool)
    later_[order], several_[order] = d > least, several
    return later_, several_


def _spans(doc, tag, lo, width):
    """Columns doc_id, tag, lo, width of one row per document, from runs in any order."""
    order = np.lexsort((lo, tag, doc))
    d, t = doc[order], tag[order]
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))) if len(d) else np.empty(0, np.int64)
    return [pa.array(d[cut]), pa.array(t[cut]), *lists(order, cut, [lo.astype(np.int32), width.astype(np.int8)])]


_SENT = [
    ("bucket", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("lo", pa.list_(pa.int32())),
    ("width", pa.list_(pa.int8())), ("key", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())),
    ("low", pa.list_(pa.int16())), ("doc_low", pa.list_(pa.int32())), ("doc_high", pa.list_(pa.int32())),
    ("tag_low", pa.list_(pa.int32())), ("tag_high", pa.list_(pa.int32())), ("lo_low", pa.list_(pa.int16())), ("lo_high", pa.list_(pa.int16())),
]
_SENT_SQL = (
    "bucket int, doc_id long, tag long, lo array<int>, width array<tinyint>, key array<int>, high array<int>, "
    "low array<smallint>, doc_low array<int>, doc_high array<int>, tag_low array<int>, tag_high array<int>, "
    "lo_low array<smallint>, lo_high array<smallint>"
)


def _batch(n, **columns):
    return pa.RecordBatch.from_arrays(
        [columns[name] if name in columns else pa.nulls(n, kind) for name, kind in _SENT], schema=pa.schema(_SENT)
    )


def _settled(buckets, doc, tag, lo, width):
    """Rows of runs that need no other task; they pass through the next shuffle as they are, spread by document."""
    if len(doc):
        columns = _spans(doc, tag, lo, width)
        spread = pa.array((mix(columns[0].to_numpy().view(_U)) % _U(buckets)).astype(np.int32))
        yield _batch(len(spread), bucket=spread, **dict(zip(("doc_id", "tag", "lo", "width"), columns)))


def _to_send(buckets, key, doc, tag, lo, width, value):
    """One row per bucket: of the key the part above the bucket number, then all that the other side needs."""
    bucket = (key % _U(buckets)).astype(np.int32)
    order, cut = by_bucket(bucket)
    if not len(cut):
        return
    sent = lists(order, cut, [
        halves(key)[0], *halves(value), *low_high(doc), *low_high(tag), *low_high(lo.astype(np.int32)),
        width.astype(np.int8),
    ])
    names = ("key", "high", "low", "doc_low", "doc_high", "tag_low", "tag_high", "lo_low", "lo_high", "width")
    yield _batch(len(cut), bucket=pa.array(bucket[order][cut]), **dict(zip(names, sent)))


def _units(batch):
    """Slices of a batch of about ``UNIT`` bytes of text: ids, tags, texts, rows."""
    ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
    texts, lo, size = [], 0, 0
    for i, text in enumerate(batch.column("text")):
        texts.append(text.as_buffer().to_pybytes() if len(text.as_buffer()) else b"")
        size += len(texts[-1])
        if size >= UNIT or i + 1 == batch.num_rows:
            yield ids[lo : i + 1], tags[lo : i + 1], texts, batch.slice(lo, i + 1 - lo)
            texts, lo, size = [], i + 1, 0


def _round_one(buckets: int):
    def run(batches):
        for batch in batches:
            for ids, tags, texts, _ in _units(batch):
                key, value, text, lo, width = runs(texts)
                yield from _own_part(buckets, key, value, ids[text], tags[text], lo, width)

    return run


def _own_part(buckets, key, value, doc, tag, lo, width):
    """What a task can settle of its own runs, or parts of runs, and what it has to send."""
    later, several = settle(key, value, doc, np.zeros(len(key), bool))
    more = several & ~later
    yield from _settled(
        buckets, *(np.concatenate([x[later], x[more]]) for x in (doc, tag, lo)),
        np.concatenate([width[later], width[more] + _EXPAND]),
    )
    alone = ~later & ~several
    marks = np.unique(key[several])
    none = np.zeros(len(marks), np.int64)
    yield from _to_send(
        buckets, np.concatenate([key[alone], marks]), np.concatenate([doc[alone], none]),
        np.concatenate([tag[alone], none]), np.concatenate([lo[alone], none]),
        np.concatenate([width[alone], none - 1]), np.concatenate([value[alone], none.astype(_U)]),
    )


def _open_runs(batch):
    """Of the runs, or parts of runs, that are still open, by units of text: doc, tag, first window, windows less one, and their bytes."""
    for ids, tags, texts, rows in _units(batch):
        n = rows.column("lo").value_lengths().to_numpy()
        text = np.repeat(np.arange(len(texts)), n)
        lo, width = (rows.column(x).flatten().to_numpy().astype(np.int64) for x in ("lo", "width"))
        pick = width >= _EXPAND
        text, lo, width = text[pick], lo[pick], width[pick] - _EXPAND
        if len(lo):
            context = [texts[i][s : s + w + LENGTH] for i, s, w in zip(text.tolist(), lo.tolist(), width.tolist())]
            yield ids[text], tags[text], lo, width, context


def _round_parts(buckets: int):
    def run(batches):
        for batch in batches:
            for doc, tag, lo, width, context in _open_runs(batch):
                key, value, of, first, width = parts(context, width)
                yield from _own_part(buckets, key, value, doc[of], tag[of], lo[of] + first, width)

    return run


def _by_bucket(batches, judge):
    """Settled rows go through; the others are judged bucket by bucket, rows coming in order of their bucket."""
    through = []

    def rest():
        for batch in batches:
            through.append(batch.filter(batch.column("key").is_null()).select(["doc_id", "tag", "lo", "width"]))
            yield batch.filter(batch.column("key").is_valid())

    for _, rows in groups(rest()):
        yield pa.RecordBatch.from_arrays(judge(rows), names=["doc_id", "tag", "lo", "width"])
        while through:
            yield through.pop()
    yield from through


def _received(rows):
    """key, value, doc, tag, first window of what ``_to_send`` sent."""
    names = ("key", "high", "low", "doc_low", "doc_high", "tag_low", "tag_high", "lo_low", "lo_high")
    parts = {x: flat(rows, x) for x in names}
    return (
        parts["key"], joined(parts["high"], parts["low"]), from_low_high(parts["doc_low"], parts["doc_high"]),
        from_low_high(parts["tag_low"], parts["tag_high"]), from_low_high(parts["lo_low"], parts["lo_high"]),
    )


def _judge_one(rows):
    key, value, doc, tag, lo = _received(rows)
    width = flat(rows, "width")
    marks = width < 0
    later, several = settle(key, value, doc, marks)
    more = several & ~later & ~marks
    pick = (later & ~marks) | more
    return _spans(doc[pick], tag[pick], lo[pick], width[pick] + _EXPAND * more[pick].astype(np.int8))


def _windows(doc, tag, lo, width, context):
    """Every window of the runs: doc, tag, position, and its rank pair from the run's bytes."""
    raw = np.frombuffer(b"".join(context), np.uint8)
    starts = np.cumsum([0, *map(len, context)])[:-1]
    n = width + 1
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    a, b = pair_ranks(prefix_ranks(raw, PREFIX), starts[run] + step) if len(run) else (np.empty(0, _U), np.empty(0, _U))
    return doc[run], tag[run], lo[run] + step, a, b


def _judge_two(rows):
    key, value, doc, tag, at = _received(rows)
    later, _ = settle(key, value, doc, np.zeros(len(key), bool))
    return _spans(doc[later], tag[later], at[later], np.zeros(int(later.sum()), np.int64))


def _round_two(buckets: int):
    def run(batches):
        for batch in batches:
            for doc, tag, lo, width, context in _open_runs(batch):
                d, t, at, a, b = _windows(doc, tag, lo, width, context)
                later, _ = settle(a, b, d, np.zeros(len(a), bool))
                yield from _settled(buckets, d[later], t[later], at[later], np.zeros(int(later.sum()), np.int64))
                # each rank alone leaves out ten bytes of the window, so both deal it
                first, pair = ~later, mix(a * _U(3) + b)
                yield from _to_send(
                    buckets, pair[first], d[first], t[first], at[first], np.zeros(int(first.sum()), np.int64), b[first]
                )

    return run


def _cut(batches):
    for batch in batches:
        kept, removed, spans, sizes = [], [], [], []
        texts = batch.column("text")
        lo_, width_ = batch.column("lo"), batch.column("width")
        for i in range(batch.num_rows):
            text = texts[i].as_buffer().to_pybytes() if len(texts[i].as_buffer()) else b""
            sizes.append(len(text))
            lo = lo_[i].values.to_numpy().astype(np.int64) if lo_[i].is_valid else np.empty(0, np.int64)
            if len(lo):
                width = width_[i].values.to_numpy().astype(np.int64)
                lo, width = lo[width < _EXPAND], width[width < _EXPAND]
            if not len(lo):
                kept.append(text), removed.append(0), spans.append(0)
                continue
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, lo, 1)
            np.add.at(change, lo + width + LENGTH, -1)
            gone = np.cumsum(change)[:-1] > 0
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _tag(ids: DataFrame, doc_id: Column, text: Column) -> Column:
    """Tells the texts of one id apart: a hash of the text where the id may come again, and 0 for all others."""
    return F.when(may_be_in(doc_id, repeated_keys(ids)), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes ``kept`` of every document."""
    text = whole(F.col("text"))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(doc_id.alias("doc_id"), _tag(docs.select(doc_id.alias("doc_id")), doc_id, text).alias("tag"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    partitions = 1 + total // PARTITION_BYTES
    lists_ = [F.flatten(F.collect_list(x)).alias(x) for x in ("lo", "width")]

    def exchange(sent, judge, partitions):
        dealt = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(lambda batches: _by_bucket(batches, judge), SPANS).groupBy("doc_id", "tag").agg(*lists_)

    def dealt():
        return rows.repartition(partitions, "doc_id", "tag")

    def open_of(found, count):
        """The rows with runs that are still open, with their texts, and what ``count`` makes of such a run's width, summed up."""
        open_ = found.where(F.exists("width", lambda w: w >= _EXPAND))
        n = open_.agg(F.sum(F.aggregate(
            "width", F.lit(0).cast("long"), lambda n, w: n + F.when(w >= _EXPAND, count(w - _EXPAND)).otherwise(0)
        ))).first()[0] or 0
        return dealt().join(open_.hint("merge"), ["doc_id", "tag"]), n

    # each round is written and its shuffles go; texts are dealt again for the next, so that the disk holds one round at a time
    one = materialize(exchange(rows.mapInArrow(_round_one(buckets), _SENT_SQL), _judge_one, partitions), "runs", drop_shuffles=True)
    texts, n = open_of(one, lambda w: F.floor((w + 2 * PART - 1) / PART))
    cut_up = materialize(exchange(
        texts.mapInArrow(_round_parts(1 + n // BUCKET_WINDOWS), _SENT_SQL), _judge_one, 1 + n // PARTITION_WINDOWS
    ), "parts", drop_shuffles=True)
    texts, n = open_of(cut_up, lambda w: w + 1)
    two = materialize(exchange(
        texts.mapInArrow(_round_two(1 + n // BUCKET_WINDOWS), _SENT_SQL), _judge_two, 1 + n // PARTITION_WINDOWS
    ), "windows", drop_shuffles=True)
    spans = one.unionByName(cut_up).unionByName(two).groupBy("doc_id", "tag").agg(*lists_).hint("merge")
    cut = dealt().join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "lo", "width").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return cut.withColumn("doc_id", real_id(F.col("doc_id")))
