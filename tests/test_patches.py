import random

from reviewlake.operators import patches

PARTS = ["+a", "-b", " c", "+++i", "--- j", "\\ No newline", "@@ -1 +1 @@ f", "@@", "+@@ x", "", "+", "\r", "@"]


def expected(patch):
    """Hunks of a patch: header, added, removed, context."""
    out = []
    for line in patch.split("\n") if patch else []:
        if line[:2] == "@@":
            out.append((line, [], [], []))
        elif out:
            sign = {"+": 1, "-": 2}.get(line[:1], 3)
            if sign != 3 and line[:3] in ("+++", "---"):
                sign = 3
            out[-1][sign].append(line if sign == 3 else line[1:])
    return out


def test_hunks_like_a_plain_restatement(spark):
    rng = random.Random(23)
    texts = ["\n".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(800)] + ["", "@@", "\n@@\n", None]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, patch string")
    found = {}
    for row in patches.hunks(files).orderBy("file_id", "hunk").collect():
        hunks = found.setdefault(row.file_id, [])
        assert row.hunk == len(hunks)
        hunks.append((row.header, row.added, row.removed, row.context))
    lines = {}
    for row in patches.patch_lines(files).orderBy("file_id", "hunk", "pos").collect():
        lines.setdefault((row.file_id, row.hunk), []).append((row.kind, row.text))
    for at, text in enumerate(texts):
        assert found.get(at, []) == expected(text), repr(text)
        for hunk, (_, added, removed, context) in enumerate(expected(text)):
            ours = lines.get((at, hunk), [])
            assert [t for k, t in ours if k == "added"] == added
            assert [t for k, t in ours if k == "removed"] == removed
            assert [t for k, t in ours if k == "context"] == context
