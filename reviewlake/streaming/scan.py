"""Detectors and counts on arriving files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlake import catalog
from reviewlake.catalog import RULES, Rule
from reviewlake.operators import listings
from reviewlake.operators.scan import PATTERN_PHASE, scan
from reviewlake.schemas import ORDER_KEY
from reviewlake.session import new_folder
from reviewlake.streaming.tables import MergedTable


def append_findings(findings: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of findings to a Parquet table, then stop when all input there is is read.

    The detectors keep no state, so the stream is the batch scan applied to each new batch of files,
    and the file sink gives every finding exactly once.
    """
    return (
        findings.writeStream.format("parquet").outputMode("append")
        .option("path", table).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def with_version(files: DataFrame) -> DataFrame:
    """Adds what tells deliveries apart; both columns go through the scan to its findings."""
    return files.withColumns({
        "ts": F.col("ts").cast("timestamp"), "content_sha": F.sha2("content", 256),
    })


def _vectors(names: list[str]):
    """The function that counts each delivery's findings by severity, nested so that it travels to the workers by value.

    Findings of a delivery come one after the other. The last ones of a batch are held back until the next one shows
    where they end; a finding that a delivery has twice was delivered twice in a row, and counts once.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, held = ["file_id", "content_sha", "part"], None

        def starts(rows):
            same = np.ones(rows.num_rows, bool)
            for name in keys:
                own = rows.column(name).combine_chunks()
                if len(own) > 1:
                    same[1:] &= np.asarray(pc.fill_null(pc.equal(own.slice(1), own.slice(0, len(own) - 1)), False))
            same[0] = False
            return ~same

        def counted(rows, first):
            delivery = np.cumsum(first) - 1
            finding = rows.column("finding").to_numpy()
            once = np.lexsort((finding, delivery))
            d, f = delivery[once], finding[once]
            once = once[np.append(True, (d[1:] != d[:-1]) | (f[1:] != f[:-1]))]
            severity = np.asarray(pc.fill_null(pc.index_in(rows.column("severity"), pa.array(names)), len(names)))[once]
            place = delivery[once] * (len(names) + 1) + severity
            counts = np.bincount(place, minlength=(delivery[-1] + 1) * (len(names) + 1)).reshape(-1, len(names) + 1)
            one = rows.take(np.flatnonzero(first)).select([*keys, "ts"]).combine_chunks()
            columns = [one.column(name).combine_chunks() for name in one.schema.names]
            return pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(counts[:, at]) for at in range(len(names)))], [*keys, "ts", *names]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            first = starts(rows)
            last = int(np.flatnonzero(first)[-1])
            if last:
                yield counted(rows.slice(0, last), first[:last])
            held = rows.slice(last)
        if held is not None:
            yield counted(held, starts(held))

    return run


def delivery_vectors(files: DataFrame, rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """``file_id``, ``content_sha``, ``part``, ``ts`` and one count per severity of each delivery with findings.

    A delivery is counted where it is scanned. A rule that is tried on whole texts has a row of its own, told by
    ``part``, as those findings come apart from the others.
    """
    found = scan(with_version(files), rules, **options)
    whole = [at for at, rule in enumerate(rules) if rule.multiline and not rule.within_line]
    apart = (F.col("type") == "security") & (F.col("phase") == PATTERN_PHASE) & F.col("rule_ord").isin(whole)
    small = found.select(
        "file_id", "content_sha", F.when(apart, F.col("rule_ord")).otherwise(-1).alias("part"), "ts", "severity",
        F.xxhash64("type", "issue", "pos", "match_ord").alias("finding"),
    )
    kind, names = dict(small.dtypes)["file_id"], list(catalog.SEVERITIES)
    return small.mapInArrow(
        _vectors(names), f"file_id {kind}, content_sha string, part int, ts timestamp, " + ", ".join(f"{n} long" for n in names)
    )


def delivery_counts(files: DataFrame, lateness: str, rules: Sequence[Rule] = RULES, **options) -> DataFrame:
    """The vectors of new deliveries of a stream, that is of each new content of a file.

    What moves, and what state is kept of, is one row of a few numbers, whatever the number of a delivery's findings. The
    same content again within the lateness bound counts no more.
    """
    vectors = delivery_vectors(files, rules, **options).withWatermark("ts", lateness)
    return vectors.dropDuplicatesWithinWatermark(["file_id", "content_sha", "part"])


WINDOWS = "window_start timestamp, severity string, findings long"


def _sum_windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window_start", "severity").agg(F.sum("findings").alias("findings"))


def windows_table(folder: str) -> MergedTable:
    """Findings per severity and time window; a batch adds what its new deliveries count."""
    return MergedTable(folder, WINDOWS, _sum_windows)


def add_windows(counts: DataFrame, table: str, checkpoint: str, width: str = "1 day") -> StreamingQuery:
    """Adds each batch of ``delivery_counts`` to a ``windows_table``."""
    kept = windows_table(table)

    def add(batch: DataFrame, number: int) -> None:
        by_severity = F.array(*(F.struct(F.lit(name).alias("severity"), F.col(name).alias("findings")) for name in catalog.SEVERITIES))
        one_each = batch.select(F.window("ts", width)["start"].alias("window_start"), F.inline(by_severity))
        kept.add(one_each.where("findings > 0"), number)

    return counts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def first_table(folder: str, schema: str, n: int = catalog.LISTED_FINDINGS) -> MergedTable:
    """The first ``n`` findings of each change, in discovery order; a finding that comes again is kept once."""
    order = Window.partitionBy("change_id").orderBy(*ORDER_KEY)

    def cut(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= n)
        return ranked.dropDuplicates(["change_id", "rank"]).drop("rank")

    return MergedTable(folder, schema, cut)


def add_first_security(findings: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps what ``listings.first_security`` lists per change, batch by batch, as a ``first_table``."""
    listed = findings.where(F.col("severity").isin("critical", "high"))
    kept = first_table(table, _ddl(listed))
    return listed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(kept.add).start()


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def read_first_security(spark: SparkSession, table: str, findings: DataFrame) -> DataFrame:
    """The kept findings with their rank."""
    kept = first_table(table, _ddl(findings)).read(spark)
    return listings.first_security(kept, "change_id")


def run_to_table(start, output: DataFrame, name: str) -> str:
    """Run ``start`` on a stream until its input is used up; the folder of the table it wrote."""
    folder = new_folder(output.sparkSession, name)
    query = start(output, f"{folder}/table", f"{folder}/state")
    query.awaitTermination()
    return f"{folder}/table"
