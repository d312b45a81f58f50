"""Alignment of two tokenizers over exact-text groups.

1. Documents are shuffled by their full text, so each distinct text is tokenised once; its multiplicity is a count.
2. Both tokenizers read the text with a space before it. Their tokens' ends, in bytes, cut the text into groups where
   ends coincide; the two tokens that end a group are linked. A task packs about ``CHUNK_BYTES`` of texts into one row (a chunk),
   which is written; tokens are not kept.
3. A chunk names each pair of linked ids once, with the number of links over all its texts and their multiplicities.
   Those rows, far fewer than links, are summed over the corpus, compared with the best of their B id, and joined back;
   each chunk then gets the counts of its own pairs and sums them up by text.
4. Measures join back to doc_ids by the SHA-256 of the text. A hot text is one row on the side of the measures.

Texts over ``PIECE`` characters are cut before a single space between other characters and tokenised piece by piece: neither
vocabulary has a token that goes on over such a space from the left, so tokens are the same (a text without such a place is taken
whole).

Results in special cases: texts that are null or empty, or whose tokens' bytes are not the space and the text (B normalises
some characters, and writes U+2581 as a space), have no tokens: zeros and an empty digest. A null doc_id stays null;
repeated rows get a row each and count each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.llm.common import whole
from reviewlake.session import materialize

#: Folder of the tokenizer files, and their names; None takes the folder of the installed package.
FOLDER, FILE_A, FILE_B = None, "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES, PIECE = 8 * 2**20, 1 << 20
#: A run of blanks beyond this length goes to the slower of the two readers of A's vocabulary; both give the same tokens.
LONG_BLANK = re.compile(r"\s{2000,}")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_CHUNK = (
    "chunk long, key array<binary>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>, "
    "link array<int>, pair_a array<int>, pair_b array<int>, weight array<long>"
)
_MEASURES = (
    "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, then from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + at): b for at, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers of one worker, and the bytes of their tokens."""

    def __init__(self, folder: str | None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        folder = folder or os.path.dirname(public_tokenizers.__file__)
        self.path_a = os.path.join(folder, FILE_A)
        with open(self.path_a, encoding="utf-8") as file:
            said = json.load(file)
        special = {t["id"] for t in said["added_tokens"]}
        byte = _byte_alphabet()
        ids = {bytes(byte[c] for c in t): i for t, i in said["model"]["vocab"].items() if i not in special}
        # an id is the rank of its merge, which is all that this faster reader of the vocabulary needs
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        self._a_slow = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, FILE_B))
        self.bytes_a = [b""] * (1 + max(ids.values()))
        for token, i in ids.items():
            self.bytes_a[i] = token
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # an id with what follows it, another of its kind or the end of its side of the group: A's, then B's
        self.written = [
            f"{i}{end}" for own, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends for i in range(len(own))
        ]

    @property
    def a_slow(self):
        if self._a_slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._a_slow = Tokenizer.from_file(self.path_a)
            self._a_slow.encode_special_tokens = True
        return self._a_slow

    def encode(self, piece: str) -> tuple[list[int], list[int]]:
        """A's ids of a space and the piece, and B's ids of the piece, which puts the space before it."""
        spaced = " " + piece
        if LONG_BLANK.search(spaced):
            return self.a_slow.encode(spaced, add_special_tokens=False).ids, self.b.encode(piece)
        return self.a.encode_ordinary(spaced), self.b.encode(piece)

    def align(self, text: str | None) -> tuple[int, int, np.ndarray, str]:
        """Number of A's and of B's tokens, the links (B's id in the upper half) and the digest of the groups."""
        n_a = n_b = 0
        links, digest = [], hashlib.sha256()
        for at, piece in enumerate(pieces(text) if text else ()):
            a, b = self.encode(piece)
            data = b" " + piece.encode()
            if any(b"".join([own[i] for i in ids]) != data for ids, own in ((a, self.bytes_a), (b, self.bytes_b))):
                return 0, 0, np.empty(0, np.int64), ""
            own, groups = self._groups(np.array(a, np.int64), np.array(b, np.int64))
            links.append(own)
            digest.update((";" * (at > 0) + groups).encode())
            n_a, n_b = n_a + len(a), n_b + len(b)
        return (n_a, n_b, np.concatenate(links), digest.hexdigest()) if links else (0, 0, np.empty(0, np.int64), "")

    def _groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, str]:
        _, last_a, last_b = np.intersect1d(
            np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), assume_unique=True, return_indices=True
        )
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a], ends_b[last_b] = len(self.bytes_a), len(self.bytes_b)
        order = np.empty(len(a) + len(b), np.int64)
        # the A tokens of a group stand behind all tokens of the groups before it, its B tokens behind its A tokens
        order[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = a + ends_a
        order[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = b + ends_b + 2 * len(self.bytes_a)
        written = self.written
        return (b[last_b] << 32) | a[last_a], "".join([written[i] for i in order.tolist()])[:-1]


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("\u2581", " ").encode()


def pieces(text: str):
    """The text cut before single spaces, which go: both tokenizers put one before each piece."""
    at = 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def tokenizers(folder: str | None) -> Tokenizers:
    """Those of this worker process. They outlive a task, unlike globals of this package, which travels by value."""
    kept = sys.modules.setdefault("_tokenizers_of_worker", types.ModuleType("_tokenizers_of_worker"))
    if folder not in vars(kept).setdefault("by_folder", {}):
        kept.by_folder[folder] = Tokenizers(folder)
    return kept.by_folder[folder]


# --- chunks --------------------------------------------------------------------------------------


def _list(values, kind) -> pa.ListArray:
    """One row with all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _chunk(number: int, rows: list[tuple]) -> pa.RecordBatch:
    keys, copies, n_a, n_b, links, digests = zip(*rows)
    n_links = np.array([len(x) for x in links])
    pair, link = np.unique(np.concatenate(links), return_inverse=True)
    weight = np.zeros(len(pair), np.int64)
    np.add.at(weight, link, np.repeat(np.array(copies, np.int64), n_links))
    columns = [
        pa.array([number]), _list(keys, pa.binary()), _list(n_a, pa.int64()), _list(n_b, pa.int64()),
        _list(n_links, pa.int64()), _list(digests, pa.string()), _list(link, pa.int32()),
        _list(pair & 0xFFFFFFFF, pa.int32()), _list(pair >> 32, pa.int32()), _list(weight, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(
        columns, ["chunk", "key", "n_a", "n_b", "n_links", "groups_sha256", "link", "pair_a", "pair_b", "weight"]
    )


def _align(folder: str | None, chunk_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        known = tokenizers(folder)
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for key, text, copies in zip(batch.column("key"), batch.column("text"), batch.column("copies")):
                text = text.as_py()
                rows.append((key.as_py(), copies.as_py(), *known.align(text)))
                size += len(text)
                if size >= chunk_bytes:
                    yield _chunk(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield _chunk(number, rows)

    return run


def _sum_up(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            def own(name, at=at):
                x = batch.column(name)[at]
                return x.values if x.is_valid else pa.array([], pa.int64())

            n, link = own("n_links").to_numpy(), own("link").to_numpy()
            pairs = own("pairs")
            ends = np.cumsum(n)
            sums = []
            for name in ("top", "count"):
                value = np.empty(len(pairs), np.int64)
                if len(pairs):
                    value[pairs.field("at").to_numpy()] = pairs.field(name).to_numpy()
                running = np.append(0, np.cumsum(value[link]))
                sums.append(pa.array(running[ends] - running[ends - n]))
            yield pa.RecordBatch.from_arrays(
                [own("key"), own("n_a"), own("n_b"), own("n_links"), own("n_links"), *sums, own("groups_sha256")],
                ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


# --- over Spark ----------------------------------------------------------------------------------


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``text``, its ``key`` and the number of its ``copies``; a null counts as an empty text."""
    texts = docs.groupBy(whole(F.col("text")).alias("text")).agg(F.count("*").alias("copies"))
    return texts.withColumn("key", _key(F.col("text")))


def aligned_chunks(docs: DataFrame, folder: str | None = FOLDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The written chunks; numbers are unique because each task of the written table has its own."""
    texts = distinct_texts(docs).select("key", "text", "copies")
    return materialize(texts.mapInArrow(_align(folder, chunk_bytes), _CHUNK), "aligned")


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """``chunk``, ``at``, ``a``, ``b`` and ``weight``: each pair of linked ids of a chunk once."""
    zipped = F.arrays_zip("pair_a", "pair_b", "weight")
    rows = chunks.select("chunk", F.posexplode(zipped).alias("at", "pair"))
    return rows.select("chunk", "at", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"), "pair.weight")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` over all documents, and ``top``: 1 where no other A id has more links with the B id."""
    counts = materialize(
        chunk_pairs(chunks).groupBy("a", "b").agg(F.sum("weight").alias("count")), "pair-counts"
    )
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    return counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("best")).cast("long").alias("top"))


def measures(chunks: DataFrame) -> DataFrame:
    """One row per distinct text, by ``key``."""
    pairs = chunk_pairs(chunks).select("chunk", "at", "a", "b").join(pair_counts(chunks), ["a", "b"])
    own = pairs.groupBy("chunk").agg(F.collect_list(F.struct("at", "count", "top")).alias("pairs"))
    joined = chunks.select("chunk", "key", "n_a", "n_b", "n_links", "groups_sha256", "link").join(own, "chunk", "left")
    return joined.drop("chunk").mapInArrow(_sum_up, _MEASURES)


def align_documents(docs: DataFrame, folder: str | None = FOLDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id`` and the measures of its text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    measured = measures(aligned_chunks(docs, folder, chunk_bytes))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(whole(F.col("text"))).alias("key"))
    return keys.join(measured, "key").drop("key")
