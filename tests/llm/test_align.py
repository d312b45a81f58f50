import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewlake.llm import align

TEXTS = [
    "Hello world, hello  world.\n", "naïve café ñandú über", "x <|endoftext|> <s> </s> <0x0A> y", "don't \n\n  stop\t\tnow ",
    "\U0001f600\x00\x01 é é ﬁ 漢字かな", "a ▁ b", "▁", " ", "  lead", "z" * 50 + " " * 40 + "z", "1234567 89 0.5e-7",
    "the the the the", "!!!???...", "\n", "line one\nline two\r\nline three", "mixedCASE Words_and_under-scores",
]


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers as given, by the libraries that their files are for."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of_char = align._byte_alphabet()

    def tokens(text):
        if not text:
            return None
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(of_char[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            piece = b.id_to_piece(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        if {b"".join(bytes_a), b"".join(bytes_b)} != {b" " + text.encode()}:
            return None
        return list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))

    return tokens


def _expected(rows, tokens):
    """Token by token, over all rows, without joining equal texts."""
    counts, all_ = Counter(), []
    for _, text in rows:
        both = tokens(text)
        if both is None:
            all_.append(None)
            continue
        ends = []
        for side in both:
            at, own = 0, {}
            for i, data in side:
                at += len(data)
                own[at] = i
            ends.append(own)
        links = [(ends[0][e], ends[1][e]) for e in ends[0] if e in ends[1]]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        sides = [[[], []] for _ in cuts]
        for side, own in enumerate(ends):
            for p, i in own.items():
                sides[bisect_left(cuts, p)][side].append(str(i))
        groups = ["|".join(",".join(own) for own in both) for both in sides]
        counts.update(links)
        all_.append((len(both[0]), len(both[1]), links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for (doc_id, _), own in zip(rows, all_):
        if own is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, links, groups = own
            yield (
                doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
                sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest(),
            )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk_bytes", [align.CHUNK_BYTES, 40])
def test_equals_plain_alignment(spark, plain, chunk_bytes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, TEXTS[0]) for i in range(30)]
    rows += [(200, None), (201, ""), (None, TEXTS[1]), (5, TEXTS[5]), (5, TEXTS[3]), (5, TEXTS[3])]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_a long, key string")
    found = align.align_documents(docs, chunk_bytes=chunk_bytes).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_expected(rows, plain), key=repr)


def test_real_texts(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = align.align_documents(docs).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_expected(rows, plain), key=repr)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    known = align.Tokenizers(None)
    text = " ".join(TEXTS[:5] + TEXTS[8:]) * 4
    whole = known.align(text)
    monkeypatch.setattr(align, "PIECE", 30)
    assert len(list(align.pieces(text))) > 20
    cut = known.align(text)
    assert whole[0] > 0 and cut[:2] == whole[:2] and cut[2].tolist() == whole[2].tolist() and cut[3] == whole[3]
    assert known.align(text + " ▁ x")[:2] == (0, 0)


def test_long_runs(plain):
    known = align.Tokenizers(None)
    for text in (" " * 400_000, "ab" + "\n" * 30_000 + "c", "z" * 300_000):
        n_a, n_b, links, _ = known.align(text)
        a, b = plain(text)
        assert (n_a, n_b) == (len(a), len(b)) and len(links) > 0


def test_no_token_goes_on_from_other_characters_to_a_space():
    known = align.Tokenizers(None)
    for own in (known.bytes_a, known.bytes_b):
        assert not [t for t in own if re.search(r"\S ", t.decode(errors="replace"))]


def test_empty_table(spark):
    assert align.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
