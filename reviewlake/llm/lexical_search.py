"""Ranked lexical search for a set of items against all documents, by norm buckets in the manner of LEMP.

A document's impact vector has, for each term of the items, ``weight * tf part`` as an integer; an item is a vector of
ones. The score is their product, so the search is for the largest inner products:

1. One pass counts the items' terms in every document. The counts are written; texts are not read again. Weights follow
   from corpus counts over all documents.
2. Vectors are dealt by length (norm), longest first, with a random number after it that splits documents of equal length, and are
   cut into buckets of ``BUCKET`` vectors.
3. The longest buckets are searched first. The k-th best score that each item has there is its threshold in all others.
4. In a bucket, Cauchy-Schwarz with the bucket's greatest norm drops items (and, in the scan's filter, whole row groups
   of the table). The bucket's greatest impact of each term bounds what a document can gain from it: terms that can't reach the
   threshold together choose no candidates, so only documents with one of the other (focus) terms are looked at, and of
   those only the ones whose partial score and remaining norm can reach it survive.
5. Survivors are scored again over all terms, in 64-bit integers. Bounds are only used to drop what is strictly below
   the threshold, so ties are kept and ranked by doc_id.

Items are taken in blocks of ``BLOCK_BYTES``, which bounds what is broadcast: the items' terms, weights and thresholds. A task
keeps k rows per item.

Results in special cases: a null text has no terms, an item or a document without terms is in no result. Rows of one
item_id are one item with the terms of all of them; a null item_id is an item too. Rows that repeat a doc_id are documents
of their own, with a rank each; a null doc_id counts as the smallest one. Terms of any length count whole. Empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewlake.llm.common import NULL_ID, real_id, whole
from reviewlake.session import materialize

TOP = 10
#: Vectors of a bucket; vectors that are searched first, at least; bytes of item texts of a block, and of vectors of a partition.
BUCKET, FIRST, BLOCK_BYTES, PARTITION_BYTES = 4096, 16384, 4 * 2**20, 16 * 2**20
#: Norms are doubles; bounds are widened by this share, far beyond their rounding.
SLACK = 1e-9
_PIECE = 1 << 20
#: Terms are runs of ASCII letters, digits and all that lies beyond ASCII; A-Z are lower-cased, every other byte is a blank.
_TO_TERMS = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256)
)
_VECTOR = "doc_id long, n long, terms array<int>, tf array<int>"
_FOUND = "item_id long, doc_id long, score long"


def term_lists(text: str | None):
    """The terms of a text, as lists of byte strings, about a megabyte of text at a time."""
    data = (text or "").encode().translate(_TO_TERMS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def read_items(some: DataFrame) -> list[tuple[int | None, list[bytes]]]:
    """(item_id, its terms), by id, without items that have no terms."""
    found: dict[int | None, set[bytes]] = {}
    for item_id, text in some.collect():
        for terms in term_lists(text):
            found.setdefault(item_id, set()).update(terms)
    return [(i, sorted(found[i])) for i in sorted(filter(found.get, found), key=lambda i: NULL_ID if i is None else i)]


def _count(vocabulary):
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                n, own = 0, Counter()
                for words in term_lists(text.as_py()):
                    n += len(words)
                    own.update(known[w] for w in words if w in known)
                sizes.append(n)
                order = sorted(own)
                terms += order
                counts += [own[t] for t in order]
                ends.append(len(terms))
            cut = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    *(pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (terms, counts)),
                ],
                names=["doc_id", "n", "terms", "tf"],
            )

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one term adds to a score; ``n`` is the size of the document it stands in."""
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Vectors:
    """The vectors of some Arrow rows, end to end: ``doc`` is the row of each entry."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, shared: dict):
        def column(name):
            x = rows.column(name)
            return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x

        lists, counts = column("terms"), column("tf")
        self.ids = column("doc_id").to_numpy(zero_copy_only=False)
        size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.term = lists.flatten().to_numpy()
        n = column("n").to_numpy(zero_copy_only=False)[self.doc]
        tf = counts.flatten().to_numpy().astype(np.int64)
        self.impact = impacts(shared["weights"][self.term], tf, n, shared["docs"], shared["terms"])
        self.square = np.bincount(self.doc, self.impact.astype(float) ** 2, len(size))


def _norms(shared):
    def run(batches):
        for batch in batches:
            norm = np.sqrt(Vectors(batch, shared.value).square) * (1 + SLACK)
            yield batch.append_column("norm", pa.array(norm))

    return run


class Bucket:
    """Vectors of similar length, by term."""

    def __init__(self, vectors: Vectors):
        order = np.argsort(vectors.term, kind="stable")
        self.ids, self.square = vectors.ids, vectors.square
        self.norm = math.sqrt(self.square.max()) * (1 + SLACK)
        self.doc, self.impact = vectors.doc[order], vectors.impact[order]
        term = vectors.term[order]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.place = dict(zip(term[starts].tolist(), range(len(starts))))
        self.cut = np.append(starts, len(term))
        self.most = np.maximum.reduceat(self.impact, starts)

    def _entries(self, places):
        parts = [slice(self.cut[p], self.cut[p + 1]) for p in places]
        return np.concatenate([self.doc[s] for s in parts]), np.concatenate([self.impact[s] for s in parts])

    def search(self, terms: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of all documents that score ``least`` (above 0) or more, and perhaps some others."""
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        places = [self.place[t] for t in terms if t in self.place]
        if not places or math.sqrt(len(places)) * self.norm * (1 + SLACK) < least:
            return nothing
        places.sort(key=lambda p: -self.most[p])
        # what the terms from each place on can give together
        rest = np.append(np.cumsum(self.most[places][::-1])[::-1], 0)
        if rest[0] < least:
            return nothing
        focus = int(np.argmax(rest < least))
        doc, impact = self._entries(places[:focus])
        impact = impact.astype(float)
        n = len(self.ids)
        partial, square = np.bincount(doc, impact, n), np.bincount(doc, impact**2, n)
        left = np.sqrt(np.maximum(self.square * (1 + SLACK) - square, 0) * (len(places) - focus))
        bound = (partial + np.minimum(left, float(rest[focus]))) * (1 + SLACK)
        survives = (partial > 0) & (bound >= least)
        if not survives.any():
            return nothing
        doc, impact = self._entries(places)
        pick = survives[doc]
        score = np.zeros(n, np.int64)
        np.add.at(score, doc[pick], impact[pick])
        rows = np.flatnonzero(survives)
        return rows, score[rows]


class Best:
    """The k best (score, doc_id) of each item so far, and the least score that can still be of use."""

    def __init__(self, thresholds: list[int], k: int):
        self.k, self.least = k, list(thresholds)
        self.score = [np.empty(0, np.int64)] * len(thresholds)
        self.id = [np.empty(0, np.int64)] * len(thresholds)

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        pick = scores >= self.least[item]
        if not pick.any():
            return
        score, doc = np.append(self.score[item], scores[pick]), np.append(self.id[item], ids[pick])
        order = np.lexsort((doc, -score))[: self.k]
        self.score[item], self.id[item] = score[order], doc[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], int(self.score[item][-1]))


def buckets(batches, size: int):
    """Runs of at most ``size`` rows whose norms don't rise; a rise means that another file of the table begins."""
    held, n, last = [], 0, math.inf
    for batch in batches:
        norm = batch.column("norm").to_numpy()
        rises = np.flatnonzero(np.append(last, norm[:-1]) < norm).tolist() if len(norm) else []
        at = 0
        while at < len(norm):
            end = min([at + size - n, len(norm), *(r for r in rises if r > at)])
            if at in rises and held:
                yield pa.Table.from_batches(held)
                held, n, end = [], 0, min([at + size, len(norm), *(r for r in rises if r > at)])
            held.append(batch.slice(at, end - at))
            n, at = n + end - at, end
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        last = norm[-1] if len(norm) else last
    if held:
        yield pa.Table.from_batches(held)


def _search(shared, thresholds: list[int], k: int, bucket_size: int):
    def run(batches):
        value = shared.value
        best = Best(thresholds, k)
        for rows in buckets(batches, bucket_size):
            bucket = Bucket(Vectors(rows, value))
            for item, terms in enumerate(value["items"]):
                found, scores = bucket.search(terms, best.least[item])
                best.add(item, bucket.ids[found], scores)
        size = [len(s) for s in best.score]
        item = np.repeat(np.arange(len(size)), size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([value["ids"][i] for i in item.tolist()], pa.int64()),
                pa.array(np.concatenate([np.empty(0, np.int64), *best.id])),
                pa.array(np.concatenate([np.empty(0, np.int64), *best.score])),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first_norm(vectors: DataFrame, at_least: int) -> float:
    """A norm that this many of the longest vectors reach: from counts by eighths of a power of two."""
    level = F.floor(8 * F.log2("norm"))
    n, reached = 0, 0.0
    for row in vectors.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if n >= at_least:
            break
        n, reached = n + row["count"], 2.0 ** (row.level / 8)
    return reached


def _search_block(spark: SparkSession, texts: DataFrame, items: list, k: int, bucket_size: int, first: int) -> DataFrame:
    vocabulary = {t: at for at, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    counted = materialize(
        texts.mapInArrow(_count(spark.sparkContext.broadcast(vocabulary)), _VECTOR), "term-counts"
    )
    sums = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = {r.term: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    shared = spark.sparkContext.broadcast({
        "docs": sums[0], "terms": sums[1] or 1, "ids": [i for i, _ in items],
        "items": [[vocabulary[t] for t in terms] for _, terms in items],
        "weights": np.array([weight(sums[0], df.get(at, 0)) for at in range(len(vocabulary))], np.int64),
    })
    some = counted.where(F.size("terms") > 0).mapInArrow(_norms(shared), f"{_VECTOR}, norm double").where("norm > 0")
    partitions = 1 + 8 * sum(df.values()) // PARTITION_BYTES
    by_length = some.withColumn("salt", F.rand(1)).repartitionByRange(partitions, F.desc("norm"), "salt").drop("salt")
    vectors = materialize(by_length.sortWithinPartitions(F.desc("norm")), "vectors")

    def search(rows, thresholds):
        return rows.mapInArrow(_search(shared, thresholds, k, bucket_size), _FOUND)

    cut = _first_norm(vectors, first)
    longest = materialize(
        _ranked(search(vectors.where(F.col("norm") >= cut), [1] * len(items)), k), "longest-vectors"
    )
    full = longest.where(F.col("rank") == k).select("item_id", "score").collect()
    known = {r.item_id: r.score for r in full}
    thresholds = [known.get(i, 1) for i, _ in items]
    # no item gains its threshold from a shorter vector, by Cauchy-Schwarz
    shortest = min((t / math.sqrt(len(terms)) for t, (_, terms) in zip(thresholds, items)), default=0.0) * (1 - SLACK)
    others = vectors.where((F.col("norm") < cut) & (F.col("norm") >= shortest))
    return longest.select("item_id", "doc_id", "score").unionByName(search(others, thresholds))


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = TOP, bucket_size: int = BUCKET, first: int = FIRST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id``, ``rank`` (1 to k), ``doc_id`` and ``score`` of the best documents with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), whole(F.col("text")).alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // block_bytes
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    found = spark.createDataFrame([], _FOUND)
    for block in range(blocks):
        own = read_items(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
        if own:
            found = found.unionByName(_search_block(spark, texts, own, k, bucket_size, first))
    return _ranked(found, k).select("item_id", "rank", real_id(F.col("doc_id")).alias("doc_id"), "score")
