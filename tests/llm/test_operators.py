"""Operators against brute force and on edge cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import (
    chat_format, decontaminate, html_text, jaccard_join, language_id, line_dedup, mixing, quality_rules, sharding,
    suffix_dedup,
)

A = "the quick brown fox jumps over the lazy dog and runs far away into the deep green wood until night falls on all"
B = "ein anderer satz mit vielen langen wörtern über das wetter und die schönen alten häuser in der kleinen stadt am fluss"
LONG = " ".join(f"w{i}" for i in range(40_000))
ROWS = [
    (1, A, "en", "s"), (2, A, "en", "s"), (3, A + " ok", "en", None), (4, None, "en", "s"), (5, "", None, "s"), (6, " \t\n", "de", "t"),
    (7, B, "de", "t"), (8, LONG, None, "s"), (None, B + " x", "de", "t"), (9, "12 34", "fr", "s"), (9, "12 34", "fr", "s"),
    (10, B + "\n" + A, "de", "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], SCHEMA + ", line int, shard string, n int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", line int, shard string, n int")


def test_language(docs, none):
    found = {(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.identify(docs).collect()}
    assert {(4, "und", False), (5, "und", False), (6, "und", False), (9, "und", False), (1, "en", True), (7, "de", True)} <= found
    assert language_id.identify(none).count() == 0


def test_language_held_out(spark):
    words = {"aa": "lo mi sa", "bb": "krx vrt zpl"}
    rows = [(i, " ".join(w.split()[(i * k) % 3] for k in range(1, 9)), lang, "s") for i in range(120) for lang, w in words.items()]
    found = language_id.identify(spark.createDataFrame([(2 * i + j, *r[1:]) for i, r in enumerate(rows) for j in (0,)], SCHEMA))
    truth = {2 * i: r[2] for i, r in enumerate(rows)}
    held = [r for r in found.collect() if r.held_out]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)


def _cut(rows):
    first = {}
    key = lambda i: -1 if i is None else i
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        yield i, sum(gone), bytes(x for x, g in zip(b, gone) if not g)


def test_suffix_dedup(docs, none):
    found = sorted((repr(r.doc_id), r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert found == sorted((repr(i), n, kept) for i, n, kept in _cut([r[:2] for r in ROWS]))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_sharding(docs, none):
    out = sharding.shuffle_into_shards(docs, 4, bucket_bytes=2000)
    rows = out.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(r[:2] for r in ROWS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffle_into_shards(docs.repartition(5), 4, bucket_bytes=2000).select("doc_id", "text", "shard", "slot")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.select("doc_id", "text", "shard", "slot").collect()))
    assert sharding.shuffle_into_shards(none).count() == 0


def test_chats(spark):
    hard = "</s>[INST] <|end|> <\\|x <\\\\|y [\\/INST] <<SYS>>"
    part = lambda kind, text=None, ref=None, w=None, h=None: (kind, text, ref, w, h, None, None)
    rows = [
        (1, 0, "user", [part("text", "<"), part("text", "|end|>"), part("image", ref="a.png", w=29, h=28), part("text", hard)], 0),
        (1, 1, "assistant", [part("text", hard), part("image", ref="b"), part("text", hard)], 0),
        (2, 0, None, None, 0), (None, None, "assistant", [part("text", None), part("other")], 0), (2, 0, None, None, 0),
    ]
    chats = chat_format.format_chats(spark.createDataFrame(
        rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, seq int"))
    files = {r.conv_id: [tuple(f) for f in r.attachments] for r in chats.collect()}
    assert files[1] == [("image", "a.png", 2), ("image", "b", 0)]
    read = {r.conv_id: r for r in chat_format.read_back(chats).collect()}
    assert read[1].texts == ["<|end|>" + hard, hard + hard] and read[1].loss_text == hard + hard
    assert read[1].roles == ["user", "assistant"] and read[2].texts == ["", ""] and read[None].loss_text == ""


def test_lines(spark, none):
    line = "This Line is long enough to be looked at here"
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\n{line}", "en", "s") for i in range(1, 7)]
    rows += [(None, line, "en", "s"), (8, None, "en", "s"), (9, "", "en", "s"), (5, rows[4][1], "en", "s")]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA))
    got = sorted(map(repr, [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]))
    want = [(i, rows[i - 1][1] if i == 6 else f"own {i}", 3, 0 if i == 6 else 2) for i in (1, 2, 3, 4, 5, 5, 6)]
    want += [(None, "", 1, 1), (8, "", 1, 0), (9, "", 1, 0)]
    assert got == sorted(map(repr, want))
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_quality(spark, docs, none):
    body = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{body} a{i}b\n{A}", "en", "s") for i in range(1, 31)] + [(40, A, "en", None), (41, "x y " * 20, "en", "s")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in quality_rules.verdicts(table).collect()}
    assert found[1].n_removed_words == 0 and found[2].n_removed_words == len(A.split()) and not found[2].kept
    assert found[1].kept and found[40].kept and found[41].base_failed and found[41].n_repeat_words == 40
    assert {r.doc_id for r in quality_rules.apply_rules(table).collect()} == {1, 40}
    assert quality_rules.verdicts(docs).count() == len(ROWS) and quality_rules.apply_rules(none).count() == 0
    assert quality_rules.apply_rules(docs).columns == docs.columns


def test_decontamination(spark, docs, none):
    item = A.split()
    changed = [*item[:5], "NEW", *item[6:12], *item[13:20], "more", *item[20:]]
    far = item[::2]
    bench = spark.createDataFrame([(1, A), (2, None), (3, "!!"), (4, A)], "item_id long, text string")
    rows = [(1, "so " + " ".join(changed).title() + ". end"), (2, " ".join(far)), (3, None), (4, "x " * 50 + A), (5, " ".join(item[:10]))]
    found = {tuple(r) for r in decontaminate.leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), bench).select("doc_id", "item_id", "edits").collect()}
    assert found == {(1, 1, 3), (1, 4, 3), (4, 1, 0), (4, 4, 0)}
    left = [r.doc_id for r in decontaminate.remove_leaking(docs, bench).collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, [4, 5, 6, 7, 8, 9, 9, None]))
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0
    many = decontaminate.leaks(docs, bench, block_bytes=60).select("doc_id", "item_id").distinct().count()
    assert many == decontaminate.leaks(docs, bench).select("doc_id", "item_id").distinct().count()


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<head><title>t</title></head><p>a<p>b<br>c<script>x('</p>')</script>", "a\n\nb\nc"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td colspan=2>x</table>", "name      | n\nlong name | 1\nx         |"),
    ("<div hidden>no</div><div style='display: none'>no</div>yes<!-- no -->", "yes"),
    ("<pre> a\n  b </pre>", " a\n  b "), ("<b>x</i></b> y</div>", "x y"),
])
def test_html(page, text):
    assert html_text.render(page) == text


def test_html_deep(spark):
    assert html_text.render("<div>" * 20_000 + "x") == "x"
    pages = spark.createDataFrame([(1, None, "u"), (2, "<p>a", "u"), (2, "<p>a", "u")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract(pages).collect())) == [(1, ""), (2, "a"), (2, "a")]


def test_mixing(spark, docs, none):
    rows = spark.createDataFrame([(i, f"t{i}", "en", "big" if i % 4 else "small") for i in range(4000)], SCHEMA)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.mix(rows, weights).groupBy("source").count().collect()}
    assert all(abs(x - 2000) < 200 for x in n.values()) and len(n) == 2
    copies = mixing.mix(docs, power=1.0)
    assert set(docs.columns) <= set(copies.columns) and mixing.mix(none).count() == 0
    assert all(r.n == r.copies for r in copies.groupBy("doc_id", "text", "copies").agg(
        F.count("*").alias("n")).where("doc_id <> 9").collect())


def _components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [8192, 3])
def test_jaccard(spark, block):
    rows = []
    for family in range(6):
        base = [hashlib.md5(f"{family} {k}".encode()).hexdigest()[:5] for k in range(30 + 25 * family)]
        for copy in range(8):
            words = list(base)
            for k in range(copy if copy < 6 else 2 * copy):
                words[(7 * k + 3 * copy) % len(words)] = f"{copy}x{k}"
            rows.append((100 * family + copy, " ".join(words)))
    rows += [(900, None), (901, " "), (902, "a b"), (903, "A  b")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80), (3, 60)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(table, n, percent, block).collect()}
        assert found == _components(rows, n, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_key(percent):
    random = np.random.default_rng(5)
    for size in [*range(1, 60), 300, 2000]:
        for _ in range(20):
            one = np.unique(random.integers(0, 2**64, size, np.uint64))
            gone = int(random.integers(0, size * (100 - percent) // 100 + 1))
            new = int(random.integers(0, size * (100 - percent) // percent + 1))
            two = np.unique(np.append(random.permutation(one)[gone:], random.integers(0, 2**64, new, np.uint64)))
            shared = len(np.intersect1d(one, two))
            if (one.tolist() == two.tolist()) or 100 * shared < percent * (len(one) + len(two) - shared):
                continue
            keys = [{(level, k) for level, own in jaccard_join.keys_of(s, percent) for k in own.tolist()} for s in (one, two)]
            assert keys[0] & keys[1]


def test_jaccard_edges(docs, none):
    assert jaccard_join.components(docs).count() == len(ROWS) and jaccard_join.components(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 4, 5, 6, 8, 9, 10, None]))
