"""N-gram Jaccard join with signature trees.

A document's set is that of its distinct ``n``-word shingles; two link when 100 * intersection >= percent * union. Documents
with the same set are one class, compared once. Classes that could link share a key (pigeonhole over parts of the hash
range, by size level: sets that differ in at most d shingles agree on all but d parts), so unlike classes are seldom
brought together. What keys of one size level connect is joined by signature trees: leaves are classes, nodes hold the OR of their token
bitmaps and their size range, and a traversal of two trees at once drops node pairs whose maximum possible overlap is
below what the sizes ask for. Pairs that are left are verified on whole sets. A task yields the classes it linked as a
star, never all pairs. Groups of more than ``BLOCK`` classes are cut into blocks, every two of which meet in a task.

Nulls: a document without words (null, empty, blank) has an empty set and links with nothing; a null doc_id is smaller than
all others. Rows that repeat an id are one document. An empty table gives no rows. Columns beyond doc_id and text are
neither read nor in the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from reviewlake.llm.common import NULL_ID, real_id, whole
from reviewlake.llm.components import connected
from reviewlake.llm.hashing import mix, shingles, word_hashes
from reviewlake.llm.packing import by_bucket, flat, groups, halves, joined, lists
from reviewlake.session import materialize

BLOCK, FANOUT, BITMAP_WORDS, PAIRS = 8192, 8, 16, 1 << 14
#: One spare part for so many differences.
SPARE = 4
#: Of text: whose keys make a bucket, whose buckets make a partition, and whose sets a task holds at once.
BUCKET_BYTES, PARTITION_BYTES, PART_BYTES = 4 << 20, 16 << 20, 8 << 20
_U = np.uint64


_known_levels: dict[tuple[int, int], tuple[tuple[int, int, int], ...]] = {}


def levels(percent: int, size: int) -> tuple[tuple[int, int, int], ...]:
    if (percent, size) not in _known_levels:
        _known_levels[percent, size] = _levels(percent, size)
    return _known_levels[percent, size]


def _levels(percent: int, size: int) -> tuple[tuple[int, int, int], ...]:
    """(level, parts, spare parts) of the two levels at which a set of this size has keys.

    Level c compares sizes of class c with each other and with class c + 1; a linked pair is at most one class apart.
    """
    lo, c = 1, 0
    bounds = [1]
    while lo <= size:
        lo = lo * 100 // percent + 1
        bounds.append(lo)
        c += 1
    own = c - 1
    out = []
    for level in (own - 1, own):
        if level < 0:
            continue
        most = bounds[level + 1] - 1
        d = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
        if d:
            spare = -(-d // SPARE)
            out.append((level, d + 1 + spare, spare))
    return tuple(out)


def keys_of(own: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """Per level the keys of a sorted set: hashes of its parts, but for the ``spare`` smallest ones.

    Of d + 1 + spare parts at least spare + 1 agree when sets differ in at most d shingles. The largest of these, by size
    and then number, has ``spare`` others below it in both sets, so both keep it. Small parts are left out because they
    bring sets together that share little.
    """
    found = []
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(own))])
    for level, parts, spare in levels(percent, len(own)):
        part = ((own >> _U(32)) * _U(parts)) >> _U(32)
        cut = np.searchsorted(part, np.arange(parts + 1, dtype=_U))
        value = sums[cut[1:]] - sums[cut[:-1]]
        key = mix(value + mix(np.arange(parts, dtype=_U) + _U(level * 1_000_003)))
        found.append((level, key[np.argsort(np.diff(cut), kind="stable")[spare:]]))
    return found


def _sets(texts, n):
    for words in word_hashes([(t or "").encode().lower() for t in texts]):
        yield shingles(words, n)


def _parts_of(batches, size: int = 512):
    """Batches in parts of so many rows, or fewer if their texts are long; a text of any length is a part at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo, done = 0, 0
        while lo < batch.num_rows:
            hi = min(max(int(np.searchsorted(ends, done + PART_BYTES, "right")), lo + 1), lo + size)
            part = batch.slice(lo, hi - lo)
            yield part
            lo, done = lo + part.num_rows, int(ends[lo + part.num_rows - 1])


def _set_hash(own: np.ndarray, salt: int) -> int:
    return int(mix(own ^ _U(salt)).sum(dtype=_U).view(np.int64))


def _at_level(set_hash: int, level: int) -> int:
    """The number of a set at a level: what meets at one level isn't brought together with what meets at the next."""
    return int(mix(np.array([set_hash], np.int64).view(_U) + _U(level * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)[0])


def _signatures(n: int, percent: int):
    def run(batches):
        for part in _parts_of(batches):
            own = list(_sets(part.column("text").to_pylist(), n))
            h1, h2 = ([_set_hash(s, salt) for s in own] for salt in (0x51, 0xA2))
            at = [[_at_level(h, level) for level, *_ in levels(percent, len(s))] for h, s in zip(h1, own)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in own], pa.int64()),
                    pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(at, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n", "h1", "h2", "at"],
            )

    return run


_KEYED = [
    ("bucket", pa.int32()), ("high", pa.list_(pa.int32())), ("low", pa.list_(pa.int16())), ("set", pa.list_(pa.int64())),
    ("u", pa.int64()), ("v", pa.int64()),
]


def _edges(keys: np.ndarray, sets: np.ndarray):
    """Sets (by their number at a level) that share a key, as edges from each to the next, and which rows are the first of their key."""
    order = np.lexsort((sets, keys))
    k, d = keys[order], sets[order]
    again = k[1:] == k[:-1]
    pairs = np.stack([d[:-1], d[1:]], axis=1)[again]
    first = np.empty(len(k), bool)
    first[order] = np.append(True, ~again) if len(k) else again
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0), first


def _keys(n: int, percent: int, buckets: int):
    """Keys by bucket, of each key in a task's part only the first set; the others become edges here."""

    def run(batches):
        for part in _parts_of(batches, 4096):
            own = {_set_hash(s, 0x51): s for s in _sets(part.column("text").to_pylist(), n) if len(s)}
            found = [(_at_level(h, level), keys) for h, s in own.items() for level, keys in keys_of(s, percent)]
            sets = np.repeat(np.array([at for at, _ in found], np.int64), [len(keys) for _, keys in found])
            keys = np.concatenate([np.empty(0, _U), *(keys for _, keys in found)])
            pairs, first = _edges(keys, sets)
            keys, sets = keys[first], sets[first]
            bucket = (keys % _U(buckets)).astype(np.int32)
            order, cut = by_bucket(bucket)
            m = len(pairs)
            empty = [pa.nulls(m, kind) for _, kind in _KEYED[1:4]]
            spread = pa.array((np.arange(m) % buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([spread, *empty, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=pa.schema(_KEYED))
            if len(cut):
                none = [pa.nulls(len(cut), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][cut]), *lists(order, cut, [*halves(keys), sets]), *none], schema=pa.schema(_KEYED)
                )

    return run


def _match(batches):
    """Edges of each bucket, and those that came along."""
    through = []

    def rest():
        for batch in batches:
            through.append(batch.filter(batch.column("u").is_valid()).select(["u", "v"]))
            yield batch.filter(batch.column("u").is_null())

    for _, rows in groups(rest()):
        pairs, _ = _edges(joined(flat(rows, "high"), flat(rows, "low")), flat(rows, "set"))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
        while through:
            yield through.pop()
    yield from through


class Tree:
    """A signature tree: level 0 are the sets in order, a node above covers ``FANOUT`` nodes below."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]), i))
        self.sets = [sets[i] for i in self.order]
        size = np.array([len(s) for s in self.sets])
        bits = np.zeros((len(sets), BITMAP_WORDS * 64), bool)
        for i, own in enumerate(self.sets):
            bits[i, (own % _U(BITMAP_WORDS * 64)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1).view(_U)
        # more tokens than bits: what a common bit can hide
        spare = size - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, size, size, spare)]
        while len(self.levels[-1][0]) > FANOUT:
            maps, low, high, spare = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(spare, at),
            ))


def _may_link(x, y, a, b, percent: int) -> np.ndarray:
    """Which node pairs can hold a link: sizes near enough, and enough possible overlap for the least sizes."""
    low_a, low_b, high_a, high_b = x[1][a], y[1][b], x[2][a], y[2][b]
    ok = percent * np.maximum(low_a, low_b) <= 100 * np.minimum(high_a, high_b)
    most = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1) + np.minimum(x[3][a], y[3][b])
    return ok & ((100 + percent) * np.minimum(most, np.minimum(high_a, high_b)) >= percent * (low_a + low_b))


def tree_join(x: Tree, y: Tree, percent: int, link, apart) -> None:
    """Calls ``link(i, j)`` for set numbers that link; ``apart(i array, j array)`` says which pairs still matter."""
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    level_of = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    a = np.arange(len(level_of(x, top)[0])).repeat(len(level_of(y, top)[0]))
    b = np.tile(np.arange(len(level_of(y, top)[0])), len(level_of(x, top)[0]))
    stack = [(top, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS:
            stack += [(level, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
            continue
        if same:
            a, b = a[a <= b], b[a <= b]
        if level == 0:
            a, b = (a[a != b], b[a != b]) if same else (a, b)
            keep = apart(a, b)
            a, b = a[keep], b[keep]
        ok = _may_link(level_of(x, level), level_of(y, level), a, b, percent)
        a, b = a[ok], b[ok]
        if level == 0:
            for i, j in zip(a.tolist(), b.tolist()):
                one, two = x.sets[i], y.sets[j]
                if percent * (len(one) + len(two)) <= (100 + percent) * min(len(one), len(two)):
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    if (100 + percent) * shared >= percent * (len(one) + len(two)):
                        link(i, j)
            continue
        for i in range(0, len(a), PAIRS // FANOUT**2):
            stack.append((level - 1, *_children(x, y, level, a[i : i + PAIRS // FANOUT**2], b[i : i + PAIRS // FANOUT**2])))


def _children(x, y, level, a, b):
    deep = lambda t: level <= len(t.levels) - 1
    step = np.arange(FANOUT)
    ca = (a[:, None] * FANOUT + step if deep(x) else a[:, None])
    cb = (b[:, None] * FANOUT + step if deep(y) else b[:, None])
    a, b = np.repeat(ca, cb.shape[1], axis=1).ravel(), np.tile(cb, (1, ca.shape[1])).ravel()
    n = lambda t: len(t.levels[min(level - 1, len(t.levels) - 1)][0])
    ok = (a < n(x)) & (b < n(y))
    return a[ok], b[ok]


def link_group(nodes: list[int], sets: list[np.ndarray], block: np.ndarray, i: int, j: int, percent: int):
    """Stars (node, smallest node) over what links among blocks i and j of a group."""
    root = np.arange(len(nodes))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    x = Tree([sets[k] for k in left])
    y = x if i == j else Tree([sets[k] for k in right])
    at_x, at_y = left[x.order], right[y.order]
    pairs = [0]

    def flat():
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    def apart(a, b):
        flat()
        return np.flatnonzero(root[at_x[a]] != root[at_y[b]])

    def link(a, b):
        p, q = find(at_x[a]), find(at_y[b])
        if p != q:
            root[max(p, q)] = min(p, q)
            pairs[0] += 1

    tree_join(x, y, percent, link, apart)
    flat()
    best: dict[int, int] = {}
    for k, r in enumerate(root.tolist()):
        best[r] = min(best.get(r, nodes[k]), nodes[k])
    return [(nodes[k], best[r]) for k, r in enumerate(root.tolist()) if nodes[k] != best[r]]


def links_of_group(nodes: list[int], sets: list[np.ndarray], block: np.ndarray, i: int, j: int, percent: int):
    """All pairs (smaller node, larger node) that link among blocks i and j of a group."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    x = Tree([sets[k] for k in left])
    y = x if i == j else Tree([sets[k] for k in right])
    at_x, at_y = left[x.order], right[y.order]
    found = []

    def link(a, b):
        u, v = nodes[at_x[a]], nodes[at_y[b]]
        found.append((min(u, v), max(u, v)))

    tree_join(x, y, percent, link, lambda a, b: np.arange(len(a)))
    return found


def _groups(percent: int, of_group=link_group):
    """Rows come sorted by (c, i, j); a group may go on over several batches."""

    def stars(key, rows):
        nodes, blobs, blocks = zip(*rows)
        found = of_group(list(nodes), [np.frombuffer(b, _U) for b in blobs], np.array(blocks), key[1], key[2], percent)
        return pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"]
        )

    def run(batches):
        key, rows = None, []
        for batch in batches:
            c, i, j, node, block, own = (batch.column(x).to_pylist() for x in ("c", "i", "j", "node", "block", "own"))
            for k in range(len(c)):
                if (c[k], i[k], j[k]) != key:
                    if len(rows) > 1:
                        yield stars(key, rows)
                    key, rows = (c[k], i[k], j[k]), []
                rows.append((node[k], own[k], block[k]))
        if len(rows) > 1:
            yield stars(key, rows)

    return run


def _set_rows(n: int):
    def run(batches):
        for part in _parts_of(batches):
            own = [s.tobytes() for s in _sets(part.column("text").to_pylist(), n)]
            rest = [part.column(x) for x in ("c", "node", "blocks")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(own, pa.binary())], names=["c", "node", "blocks", "own"])

    return run


def _candidates(docs: DataFrame, n: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their classes, and the rows of candidate groups, dealt and sorted by pair of blocks."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), whole(F.col("text")).alias("text"),
        F.xxhash64(whole(F.col("text"))).alias("text_key"),
    )
    signed = materialize(texts.mapInArrow(
        _signatures(n, percent), "doc_id long, text_key long, n long, h1 long, h2 long, at array<long>"
    ), "signatures")
    # a class is named by its smallest doc_id, and stands by one text: texts without an id, or of one id, share the name only
    least = F.min(F.struct("doc_id", "text_key"))
    classes = signed.where("n > 0").groupBy("n", "h1", "h2").agg(least.alias("least"), F.first("at").alias("at"))
    classes = classes.select("n", "h1", "h2", F.col("least.doc_id").alias("node"), F.col("least.text_key").alias("key"), "at")
    classed = materialize(
        signed.drop("at").join(classes, ["n", "h1", "h2"], "left").select("doc_id", "text_key", "n", "node", "key", "at"), "classes"
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    partitions = min(buckets, 1 + total // PARTITION_BYTES)
    keyed = texts.mapInArrow(
        _keys(n, percent, buckets), "bucket int, high array<int>, low array<smallint>, set array<long>, u long, v long"
    )
    # neighbouring buckets together: a hash would deal some partitions several times the keys of others
    dealt = keyed.repartitionById(partitions, F.expr(f"cast(bucket * {partitions}L div {buckets}L as int)"))
    pairs = dealt.sortWithinPartitions("bucket").mapInArrow(_match, "u long, v long").distinct()
    stands = classed.where("doc_id = node and text_key = key")
    name = stands.select("node", "key", F.explode("at").alias("at")).distinct()
    together = connected(pairs, "candidates").select(F.col("node").alias("at"), F.col("label").alias("c"))
    groups_ = together.join(name, "at").select("node", "key", "c")
    sizes = groups_.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = groups_.join(sizes, "c").hint("merge")  # grows with the corpus: never broadcast, at any size
    one_text = (texts["doc_id"] == sized["node"]) & (texts["text_key"] == sized["key"])
    member = texts.join(sized, one_text).select("c", "node", "blocks", "text")
    rows = member.mapInArrow(_set_rows(n), "c long, node long, blocks int, own binary").where(F.octet_length("own") > 0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    rows = rows.select(
        "c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "own"
    )
    return classed, rows.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")


def components(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach from the document, itself included."""
    classed, rows = _candidates(docs, n, percent, block)
    stars = rows.mapInArrow(_groups(percent), "u long, v long")
    found = connected(stars, "links")
    labelled = classed.join(found, "node", "left")
    return labelled.select(
        real_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        real_id(F.coalesce("label", "node", "doc_id")).alias("component_id"),
    )


def links(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every pair of linked classes once, as ``class_a`` < ``class_b``, and doc_id, n_shingles, ``class_id``.

    A class is the documents of one set of shingles, named by their smallest doc_id; all of them are linked to each other and to all
    of each linked class. Ids are to be given and not repeated, as classes go by them.
    """
    classed, rows = _candidates(docs, n, percent, block)
    pairs = rows.mapInArrow(_groups(percent, links_of_group), "class_a long, class_b long").distinct()
    return pairs, classed.select(real_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("node").alias("class_id"))


def links_per_document(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, n_links: how many other documents link to each, counted by class sizes without making the pairs."""
    pairs, members = links(docs, n, percent, block)
    sizes = members.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("size"))
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    others = both.join(sizes, both["class_b"] == sizes["class_id"]).groupBy("class_a").agg(F.sum("size").alias("others"))
    own = sizes.join(others, sizes["class_id"] == others["class_a"], "left").select(
        "class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    return members.join(own, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents but for those that reach one of a smaller doc_id over links; of repeated rows one stays.

    Rows without an id can't be told apart: they stay unless id and text are equal. Columns as before.
    """
    first = components(docs, n, percent).where("doc_id <=> component_id").select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id")
    ).distinct()
    rows = docs.select(
        "*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(whole(F.col("text"))).alias("_key")
    ).join(first, "_id", "left_semi")
    again = Window.partitionBy("_id", "_key").orderBy("_key")
    return rows.withColumn("_n", F.row_number().over(again)).where("_n = 1").select(*docs.columns)
