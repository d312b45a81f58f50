"""Many pattern rules at once, by an inverted index of the texts that their matches must hold.

In ``scan`` each rule is an expression of the plan, which suits a few dozen. Here rules are rows: every rule lists literals
of which each match holds one, a literal is filed under one of its grams (runs of as many characters as the longest of ``SIZES`` that
it has room for, so that many long literals need not share short grams), and a line meets
only the rules whose grams it has. The plan is the same for any number of rules.

1. A task takes the first ``GRAM`` bytes from every place of a text at once and looks them up in a table of those that filed grams
   begin with. Only where they do, it takes the hashes of the longer runs and holds them against a Bloom filter of all filed
   grams, so almost none of them leaves it.
2. What is left joins the index by the gram's hash. Spark broadcasts the index where its size allows, and deals both sides
   by hash beyond that (a frequent gram may be split there, since the index's side can be repeated).
3. A joined line is tested for the literal and the rule's suffixes, then by the rule's pattern, which is a column.
   A rule that a line meets by several of its literals counts by the first of them alone, so nothing needs grouping.

Rules over several lines meet whole texts in the same way. Rules without a literal of that length can only be tried on
every line; they go through ``scan`` as expressions.

A table of rules is prepared by tasks: only rules without a literal, and filters of a bounded size, come to the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _parser as parser

from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake import catalog
from reviewlake.catalog import Rule
from reviewlake.functions import text
from reviewlake.functions.literals import FOLDED, FOLDED_TO, required_literals
from reviewlake.functions.regex import java_pattern
from reviewlake.operators import scan
from reviewlake.operators.findings import file_keys
from reviewlake.session import materialize, spread
from reviewlake.sources.rules import RULES, TEXTS, check_rules

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 4
#: Lengths of grams, the shortest being ``GRAM``.
SIZES = (GRAM, 5, 6, 8)
#: Bits of a filter per filed gram, and at most; the parts of a hash that give a gram's places in it.
BITS_PER_GRAM, MOST_BITS = 128, 1 << 28
PLACES = (0, 19, 38)
#: Bits of the number that stands for the first bytes of a gram, which is the size of their table; bytes looked up at once.
HEAD_BITS, SLICE = 22, 1 << 18
_PREPARED = f"{RULES}, rule_ord int, java string, literals array<string>, error string"


@dataclass(frozen=True)
class RuleIndex:
    """``filed`` has a row per rule and literal; ``open_rules`` are those without one, by their place in the order."""

    filed: DataFrame
    by_line: bool
    by_text: bool
    open_rules: tuple[tuple[int, Rule], ...]


def _prepare(batches):
    """Rows of rules with the spelling of their pattern in Java and the literals that matches hold."""
    import pyarrow as pa

    for batch in batches:
        java, literals, errors = [], [], []
        for name, pattern, multiline, own in zip(*(batch.column(x).to_pylist() for x in ("name", "pattern", "multiline", "own"))):
            spelled, held, error = None, [], None
            try:
                tree = parser.parse(pattern)
                spelled = java_pattern(pattern, ignore_case=True, multiline=multiline, tree=tree)
                held = list(own) if own and min(map(len, own)) >= GRAM else list(required_literals(pattern, GRAM, tree))
            except Exception as wrong:  # whatever the pattern does, its rule is to be named
                error = f"rule {name!r}: {wrong}"
            java.append(spelled), literals.append(held), errors.append(error)
        batch = batch.drop_columns(["own"]).append_column("java", pa.array(java, pa.string()))
        yield batch.append_column("literals", pa.array(literals, pa.list_(pa.string()))).append_column("error", pa.array(errors, pa.string()))


def _heads(data):
    """A number for the ``GRAM`` bytes from each place on."""
    import numpy as np

    n = max(len(data) - GRAM + 1, 0)
    value = data[:n].astype(np.uint32)
    for at in range(1, GRAM):
        value |= data[at:at + n].astype(np.uint32) << np.uint32(8 * at)
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - HEAD_BITS)


def _step(value, byte):
    """The hash of a run with one more byte, as numpy's wrapping integers."""
    import numpy as np

    value = (value ^ byte) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


def _gram_hashes(batches):
    """Adds the hash of each gram and the number of its first bytes."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        grams = [gram.encode() for gram in batch.column("gram").to_pylist()]
        size = np.array([*map(len, grams)], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(grams), np.uint8)
        value = np.zeros(len(grams), np.uint64)
        for at in range(int(size.max(initial=0))):
            longer = np.flatnonzero(size > at)
            value[longer] = _step(value[longer], data[start[longer] + at])
        heads = _heads(data)[start] if len(grams) else np.empty(0, np.uint32)
        batch = batch.append_column("hash", pa.array(value.view(np.int64)))
        yield batch.append_column("head", pa.array(heads.astype(np.int32)))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rules with their place in the order of names, numbered by the tasks that hold them."""
    placed = materialize(rows.orderBy("name").withColumn("place", F.monotonically_increasing_id()), "rules")
    sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    before, total = [F.lit(0)] * (1 + max((row.part for row in sizes), default=0)), 0
    for row in sizes:
        before[row.part] = F.lit(total)
        total += row["count"]
    own = F.get(F.array(*before), F.shiftright("place", 33).cast("int")) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("rule_ord", own.cast("int")).drop("place")


def index_table(rows: DataFrame) -> RuleIndex:
    """Files the rules of a table, checked and in the order of their names as ``sources.rules.rules_from_table`` gives them."""
    own = F.col("literals") if "literals" in rows.columns else F.lit(None).cast("array<string>")
    rules = rows.select(*TEXTS, "extensions", F.coalesce("multiline", F.lit(False)).alias("multiline"), own.alias("own"))
    return _index(_ordered(rules))


def index_rules(spark: SparkSession, rules: Sequence[Rule]) -> RuleIndex:
    """Files rules in the order given; a rule's own ``literals`` go before those read off its pattern."""
    listed = [
        (r.name, r.pattern, r.severity, r.description, r.recommendation, None if r.extensions is None else list(r.extensions),
         r.multiline, list(r.literals), at) for at, r in enumerate(rules)
    ]
    return _index(spark.createDataFrame(listed, f"{RULES}, own array<string>, rule_ord int"), any_text=True)


def _index(rules: DataFrame, any_text: bool = False) -> RuleIndex:
    prepared = materialize(spread(rules).mapInArrow(_prepare, _PREPARED), "prepared-rules")
    if not any_text:
        _check(prepared)
    open_rules = prepared.where("error is null and size(literals) = 0").orderBy("rule_ord").collect()
    wrong = prepared.where("error is not null").select(F.min_by("error", "rule_ord")).first()[0]
    if wrong is not None:
        raise ValueError(wrong)
    each = prepared.where("size(literals) > 0").withColumn("literal", F.explode("literals"))
    size = reduce(lambda least, n: F.when(F.length("literal") >= n, n).otherwise(least), SIZES[1:], F.lit(SIZES[0]))
    grams = each.select("rule_ord", "literal", size.alias("size")).distinct().select(
        "rule_ord", "literal", F.posexplode(F.expr("transform(sequence(1, length(literal) - size + 1), i -> substring(literal, i, size))")).alias("at", "gram"))
    grams = materialize(grams, "rule-grams")
    use = grams.select("literal", "gram").distinct().groupBy("gram").agg(F.count("*").alias("use"))
    # the gram that the fewest literals share; the last of them, as names differ at their ends
    anchors = grams.join(use, "gram").groupBy("rule_ord", "literal").agg(F.min_by("gram", F.struct("use", -F.col("at"))).alias("gram"))
    filed = each.join(anchors, ["rule_ord", "literal"]).select(
        "gram", "literal", "literals", F.col("java").alias("pattern"), "severity", F.col("name").alias("issue"), "description",
        "recommendation", "extensions", "multiline", "rule_ord")
    schema = ", ".join(f"{name} {kind}" for name, kind in filed.dtypes) + ", hash long, head int"
    filed = materialize(filed.mapInArrow(_gram_hashes, schema), "rule-index")
    kinds = {row.multiline for row in filed.select("multiline").distinct().collect()}
    return RuleIndex(filed, False in kinds, True in kinds, tuple(
        (row.rule_ord, Rule(*(row[name] for name in TEXTS), None if row.extensions is None else tuple(row.extensions),
                            multiline=row.multiline)) for row in open_rules))


def _check(prepared: DataFrame) -> None:
    """What ``rules_from_table`` refuses, named by the first such rule."""
    twice = prepared.groupBy("name").count().where("count > 1 and name is not null").first()
    if twice is not None:
        raise ValueError("names of rules must differ")
    missing = prepared.where(" or ".join(f"{name} is null" for name in TEXTS)).first()
    if missing is not None:
        raise ValueError(f"rule {missing.name!r}: {', '.join(TEXTS)} must be given")
    unknown = prepared.where(~F.col("severity").isin(*catalog.SEVERITIES)).first()
    if unknown is not None:
        raise ValueError(f"rule {unknown.name!r}: severity must be one of {catalog.SEVERITIES}, not {unknown.severity!r}")
    tried = prepared.where("java is not null")
    low, high = 0, prepared.count()
    while low < high:
        half = tried.where((F.col("rule_ord") >= low) & (F.col("rule_ord") < high))
        try:
            half.agg(F.count_if(F.rlike(F.lit(""), F.col("java")))).collect()
            return
        except PySparkException:
            middle = (low + high) // 2
            if high - low == 1:
                row = half.first()
                check_rules(prepared.sparkSession, [Rule(*(row[name] for name in TEXTS), multiline=row.multiline)])
                raise
            try:
                tried.where((F.col("rule_ord") >= low) & (F.col("rule_ord") < middle)).agg(
                    F.count_if(F.rlike(F.lit(""), F.col("java")))).collect()
                low = middle
            except PySparkException:
                high = middle


def _bits(places: DataFrame, bits: int):
    """The places of a filter of so many bits (as a power of two), as bytes."""
    import numpy as np

    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    held = np.zeros(1 << bits - 6, np.int64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return held.tobytes()


def _filter(filed: DataFrame):
    """The sizes of the filed grams; for line rules and text rules the table of their first bytes, and a Bloom filter of them, of
    ``MOST_BITS`` at most, with its bits."""
    sizes = sorted(row[0] for row in filed.select(F.length("gram")).distinct().collect())
    tables, sized = [], []
    for kind in (False, True):
        own = filed.where(F.col("multiline") == kind)
        bits = min(max(1 << (own.count() * BITS_PER_GRAM - 1).bit_length(), 1 << 10), MOST_BITS).bit_length() - 1
        places = F.array(*(F.shiftrightunsigned(F.shiftleft("hash", skip), 64 - bits) for skip in PLACES))
        heads = _bits(own.select(F.col("head").alias("place")), HEAD_BITS)
        tables.append((heads, _bits(own.select(F.explode(places).alias("place")), bits)))
        sized.append(bits)
    return sizes, sized, filed.sparkSession.sparkContext.broadcast(tables)


def _hits(sizes: list[int], sized: list[int], tables):
    """The function that gives lines, and whole texts, with the hashes of their grams that may be filed for such, each once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tables_ = [[np.frombuffer(table, np.uint8) for table in pair] for pair in tables.value]
        line_heads, text_heads = (np.unpackbits(heads, bitorder="little") for heads, _ in tables_)
        heads = line_heads | text_heads << 1

        def look_up(data, ends, at, row, known, bits):
            """Row, place and hash of the grams from the given places on that the filter has."""
            value, done, found = np.zeros(len(at), np.uint64), 0, []
            for size in sizes:
                # grams that begin in one text and end in the next are none
                inside = at + size <= ends[row + 1]
                at, row, value = at[inside], row[inside], value[inside]
                for step in range(done, size):
                    value = _step(value, data[at + step])
                done, maybe = size, np.arange(len(at))
                for skip in PLACES:
                    place = (value[maybe] << np.uint64(skip)) >> np.uint64(64 - bits)
                    maybe = maybe[(known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                found.append(np.stack([value[maybe].view(np.int64), at[maybe], row[maybe]]))
            return np.concatenate(found, axis=1)

        def distinct(found):
            found = found[:, np.lexsort(found)]
            new = np.append(np.full(min(1, found.shape[1]), True), (found[:, 1:] != found[:, :-1]).any(axis=0))
            return found[:, new]

        for batch in batches:
            folded = batch.column("folded")
            ends = np.frombuffer(folded.buffers()[1], np.int32)[folded.offset:folded.offset + len(folded) + 1].astype(np.int64)
            data = np.frombuffer(folded.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
            ends -= ends[0]
            at, kind = [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
            for low in range(0, len(data), SLICE):
                kinds = heads[_heads(data[low:low + SLICE + GRAM - 1])]
                some = np.flatnonzero(kinds)
                at.append(some + low), kind.append(kinds[some])
            at, kind = np.concatenate(at), np.concatenate(kind)
            row = np.searchsorted(ends, at, "right") - 1
            contents = batch.column("content")
            keys = batch.drop_columns(["folded", "content"])

            pick = kind & 1 == 1
            hashes, places, of = look_up(data, ends, at[pick], row[pick], tables_[0][1], sized[0])
            if len(of):
                breaks = np.flatnonzero(data == 10)
                line = np.searchsorted(breaks, places) - np.searchsorted(breaks, ends[of])
                hashes, line, of = distinct(np.stack([hashes, line, of]))
                split = {one: contents[one].as_py().split("\n") for one in np.unique(of).tolist()}
                lines = [split[one][nth] for one, nth in zip(of.tolist(), line.tolist())]
                yield _hit_rows(keys, of, False, pa.array(line + 1, pa.int32()), pa.array(lines, pa.string()), hashes)

            pick = kind & 2 == 2
            hashes, _, of = look_up(data, ends, at[pick], row[pick], tables_[1][1], sized[1])
            if len(of):
                hashes, of = distinct(np.stack([hashes, of]))
                yield _hit_rows(keys, of, True, pa.nulls(len(of), pa.int32()), contents.take(pa.array(of)), hashes)

    return run


def _hit_rows(keys, of, multiline: bool, line_no, unit, hashes):
    import pyarrow as pa

    rows = keys.take(pa.array(of)).append_column("line_no", line_no).append_column("unit", unit)
    return rows.append_column("multiline", pa.array([multiline] * len(of), pa.bool_())).append_column("hash", pa.array(hashes, pa.int64()))


def _met(source: DataFrame, filed: DataFrame) -> DataFrame:
    """Lines, with their number, and whole texts (``unit``) with each rule of which they hold a literal, once."""
    keys = ", ".join(f"{name} {kind}" for name, kind in source.dtypes if name != "content")
    units = source.select(*(n for n in source.columns if n != "content"), "content", _folded("content").alias("folded"))
    hits = units.mapInArrow(_hits(*_filter(filed)), f"{keys}, line_no int, unit string, multiline boolean, hash long")
    met = hits.join(filed, ["hash", "multiline"]).withColumn("folded", _folded("unit"))
    first = F.get(F.filter("literals", lambda literal: F.contains("folded", literal)), F.lit(0))
    in_scope = F.col("extensions").isNull() | F.array_contains("extensions", F.col("ext"))
    return met.where(in_scope & (first == F.col("literal"))).drop("folded", "hash", "head", "gram", "literal", "literals", "extensions")


def _folded(column: str) -> Column:
    beyond = F.lower(F.translate(column, FOLDED, FOLDED_TO))
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(beyond)


def _filed_findings(source: DataFrame, filed: DataFrame) -> DataFrame:
    """Findings in lines and in whole texts. For a rule over several lines the line of a match is the one it begins on, and its
    code is not stripped."""
    met, of_text = _met(source, filed), F.col("multiline")
    marked = text.split_lines(F.regexp_replace(F.translate("unit", "\x01", "\x02"), F.col("pattern"), F.lit("\x01$0")))
    own = met.select(
        *file_keys(source), "severity", "issue", "description", "recommendation", "rule_ord", "multiline", "line_no", "unit",
        F.when(of_text, text.split_lines(F.col("unit"))).alias("lines"), F.when(of_text, scan.lines_of_marks(marked)).alias("marks"),
        F.regexp_extract_all("unit", F.col("pattern"), F.lit(0)).alias("found"),
    )
    in_text = F.transform(F.arrays_zip(F.col("marks").alias("line_no"), F.col("found").alias("matched")), lambda m: F.struct(
        m["line_no"].alias("line_no"), m["matched"].alias("matched"), F.get("lines", m["line_no"] - 1).alias("code")))
    in_line = F.transform("found", lambda m: F.struct(
        F.col("line_no"), m.alias("matched"), text.strip(F.col("unit")).alias("code")))
    located = own.withColumn("matches", F.when(of_text, in_text).otherwise(in_line)).drop("lines", "marks", "found", "unit", "line_no")
    matched = located.select("*", F.posexplode_outer("matches").alias("match_ord", "match")).where("match is not null")
    matched, empty = matched.select("*", "match.*").drop("match", "matches"), F.lit(None).cast("string")
    return matched.select(
        *file_keys(matched), F.lit("security").alias("type"), F.lit(catalog.PATTERN_TOOL).alias("tool"), "severity", "issue",
        "description", F.col("line_no").alias("line"), "code", "matched", empty.alias("confidence"),
        "recommendation", F.lit(scan.PATTERN_PHASE).alias("phase"), "rule_ord", F.col("line_no").cast("long").alias("pos"),
        "match_ord",
    )


def scan_index(files: DataFrame, index: RuleIndex) -> DataFrame:
    """Findings of all rules of the index, with the columns of ``scan`` and equal to what it finds."""
    source = scan.reviewable(files)
    found = [_filed_findings(source, index.filed)] if index.by_line or index.by_text else []
    if index.open_rules:
        place = F.array(*(F.lit(at) for at, _ in index.open_rules))
        rest = scan.scan(files, [rule for _, rule in index.open_rules], quality=False, whole_file=False)
        found.append(rest.withColumn("rule_ord", F.get(place, F.col("rule_ord"))))
    if not found:
        raise ValueError("nothing to scan for: the index has no rules")
    return reduce(DataFrame.unionByName, found)
