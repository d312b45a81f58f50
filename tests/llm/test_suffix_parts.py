"""Open runs are compared in parts before single windows, and a round's shuffle files go when it is written."""

import random
import time

import numpy as np

from reviewlake.llm import suffix_dedup
from test_operators import _cut

ABC = "abcdefghijklmnopqrstuvwxyz "


def _near_copies(texts, copies, seed):
    """Texts and copies of them with letters changed, put in or left out here and there."""
    pick = random.Random(seed)
    rows = []
    for i in range(texts):
        own = "".join(pick.choices(ABC, k=pick.randint(200, 900)))
        rows.append((i, own))
        for j in range(copies):
            copy = list(own)
            for _ in range(pick.randint(1, 8)):
                at = pick.randrange(len(copy))
                copy[at : at + pick.randint(0, 2)] = pick.choices(ABC, k=pick.randint(0, 2))
            rows.append((1000 + 100 * i + j, "".join(copy)[pick.randint(0, 70):]))
    pick.shuffle(rows)
    return rows


def test_near_copies_are_exact(spark):
    rows = _near_copies(12, 4, 1) + [(None, "x" * 300), (5000, "x" * 120), (5001, "xy" * 90), (5002, "yx" * 70), (5003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((repr(r.doc_id), r.n_removed, bytes(r.kept)) for r in found) == sorted((repr(i), n, k) for i, n, k in _cut(rows))


def test_parts_cover_their_runs_and_leave_few_windows():
    texts = [text.encode() for _, text in _near_copies(200, 1, 2)]
    key, value, text, lo, width = suffix_dedup.runs(texts)
    later, several = suffix_dedup.settle(key, value, text, np.zeros(len(key), bool))
    text, lo, width = (x[several & ~later] for x in (text, lo, width))
    context = [texts[i][s : s + w + suffix_dedup.LENGTH] for i, s, w in zip(text.tolist(), lo.tolist(), width.tolist())]
    key, value, run, first, less = suffix_dedup.parts(context, width)
    windows = sorted((r, f + k) for r, f, w in zip(run.tolist(), first.tolist(), less.tolist()) for k in range(w + 1))
    assert windows == [(r, k) for r, w in enumerate(width.tolist()) for k in range(w + 1)]
    assert less.max() < suffix_dedup.PART
    later, several = suffix_dedup.settle(key, value, text[run], np.zeros(len(key), bool))
    rows = len(key) + int((less[several & ~later] + 1).sum())
    assert rows < 0.7 * len(windows)


def test_shuffle_files_of_written_rounds_go(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles().toList()
        return {f.getPath(): f.length() for f in (every.apply(i) for i in range(every.size())) if f.getName().startswith("shuffle_")}

    docs = spark.createDataFrame(_near_copies(800, 1, 3), "doc_id long, text string")
    before = files()
    kept = suffix_dedup.remove_repeats(docs)
    for _ in range(40):
        left = sum(size for path, size in files().items() if path not in before)
        if left < 100_000:
            break
        time.sleep(0.25)
    assert left < 100_000
    assert kept.count() == 1600
