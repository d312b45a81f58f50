"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language come from a bounded sample of the labelled texts: each language is thinned
by a hash of doc_id to about ``SAMPLE`` texts (a documented bound of the fit; every text is scored). Log-probabilities are
kept as integers, so that sums don't depend on their order, and broadcast: at most ``CELLS`` numbers however many labels
there are, as more labels get fewer buckets. Scoring gathers a text's n-grams from the matrix, many texts at a time.

Texts are lower-cased and taken whole; long ones go through in pieces. Nulls: a null text, and one without a
letter, gives ``und`` and score 0; rows with a null label aren't learned from; a null doc_id counts as the text ''. Equal
scores go to the first label in order. Repeated rows are scored alike. With nothing to learn from, all is ``und``. An empty
table gives no rows. Columns beyond those named are neither read nor in the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.llm.hashing import mix

ORDERS, SAMPLE, CELLS, MOST_BITS, SMOOTHING, UNIT = 3, 20_000, 1 << 24, 16, 0.5, 1 << 16
PIECE = 1 << 19
_U = np.uint64


def remainder(doc_id: Column, n: int = 4) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def _pieces(texts: list[str | None]):
    """Groups of (text number, piece with two characters more, length without them), of bounded size."""
    group, size = [], 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for start in range(0, len(low), PIECE):
            piece = low[start : start + PIECE + ORDERS - 1]
            n = min(PIECE, len(low) - start)
            group.append((i, piece, n))
            size += len(piece) + ORDERS
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _grams(group, bits: int):
    """Bucket arrays of the n-grams, where each piece starts, and which positions count."""
    joined = "".join(piece + "\0" * (ORDERS - 1) for _, piece, _ in group)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    lengths = np.array([len(piece) + ORDERS - 1 for _, piece, _ in group])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counted = np.arange(len(codes)) - np.repeat(starts, lengths) < np.repeat([n for _, _, n in group], lengths)
    buckets, h = [], np.zeros(len(codes), _U)
    for order in range(ORDERS):
        ahead = np.zeros(len(codes), _U)
        ahead[: len(codes) - order] = codes[order:]
        h = mix(h * _U(0x9E3779B97F4A7C15) + ahead + _U(order + 1))
        buckets.append((h >> _U(64 - bits)).astype(np.int64))
    return buckets, starts, counted


def _count(bits: int):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def rows(counts):
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=schema
            )

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for group in _pieces(batch.column("text").to_pylist()):
                buckets, starts, counted = _grams(group, bits)
                lengths = np.diff(np.append(starts, len(counted)))
                of = np.repeat(np.unique([langs[i] for i, _, _ in group], return_inverse=True)[1], lengths)
                for k, lang in enumerate(sorted({langs[i] for i, _, _ in group})):
                    own = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                    here = counted & (of == k)
                    for b in buckets:
                        own += np.bincount(b[here], minlength=1 << bits)
                if len(counts) > 64:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """Labels in order and the matrix of log-probabilities, from rows (doc_id, text, lang)."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(CELLS >> 9).collect()}
    if len(sizes) >= CELLS >> 9:
        raise ValueError(f"more than {CELLS >> 9} labels")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "bits": 1, "matrix": np.zeros((0, 2), np.int32), "prior": np.zeros(0, np.int64)}
    bits = min(MOST_BITS, (CELLS // len(langs)).bit_length() - 1)
    large = {lang: sample / n for lang, n in sizes.items() if n > sample}
    if large:
        share = F.create_map(*(F.lit(x) for pair in large.items() for x in pair))
        draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
        rows = rows.where(draw < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0)))
    counted = rows.select("text", "lang").mapInArrow(_count(bits), "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    counts = np.zeros((len(langs), 1 << bits))
    number = {lang: i for i, lang in enumerate(langs)}
    counts[table["lang"].map(number).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * (1 << bits))
    prior = np.log(np.array([sizes[lang] for lang in langs]) / sum(sizes.values()))
    return {
        "langs": langs, "bits": bits, "matrix": np.round(np.log(share) * UNIT).astype(np.int32),
        "prior": np.round(prior * UNIT).astype(np.int64),
    }


def _score(model):
    def run(batches):
        own = model.value
        langs, bits, matrix, prior = own["langs"], own["bits"], own["matrix"], own["prior"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = np.zeros((len(texts), len(langs)), np.int64)
            for group in _pieces(texts) if langs else ():
                buckets, starts, counted = _grams(group, bits)
                at = [i for i, _, _ in group]
                for k in range(len(langs)):
                    each = np.zeros(len(counted), np.int64)
                    for b in buckets:
                        each += matrix[k][b]
                    each[~counted] = 0
                    np.add.at(sums[:, k], at, np.add.reduceat(each, starts))
            sums += prior
            named = np.array([bool(langs) and any(map(str.isalpha, t or "")) for t in texts], bool)
            best = sums.argmax(axis=1) if langs else np.zeros(len(texts), int)
            top = sums.max(axis=1, keepdims=True) if langs else sums
            score = 1 / np.exp((sums - top) / UNIT).sum(axis=1) if langs else np.zeros(len(texts))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest, pa.array([langs[b] if ok else "und" for b, ok in zip(best, named)], pa.string()),
                    pa.array(np.round(np.where(named, score, 0.0), 6)),
                ],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` but text, which is its last, with ``lang_pred`` and ``score``."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "text", "lang")
    model = fit(rows.where("not held_out").select("doc_id", "text", "lang"), sample)
    return predict(rows.select("doc_id", "held_out", F.col("text").cast("string").alias("text")), model)
