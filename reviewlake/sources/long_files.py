"""Files that are longer than one value may be: read line by line in blocks, given as parts that can be scanned apart.

Spark's text source cuts a file into blocks and gives each line to one of them. A task packs the lines of a block into
pieces of about ``PART_BYTES``, in order; no text is shuffled for that. Line numbers are prefix sums of the pieces' line
counts, over a row per piece.

A text is only cut where no check can look across: after a line with text that does not end in what a pattern may go on
from, before a line that does not begin with what one may end in. Where the end of a block is no such place, its
last piece is joined to the next one, so a scan of the parts finds what a scan of the whole text would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewlake.functions import text
from reviewlake.functions.literals import FOLDED, FOLDED_TO
from reviewlake.session import materialize
from reviewlake.sources.files import MAX_BYTES, relative_name

PART_BYTES = 8 * 2**20
#: What the patterns over line ends go on from, lower-case, and what one of them ends in.
GOES_ON = ("var", "eval", ".innerhtml", "select", "=")
ENDS_IN = "="
_PIECE = (
    "path string, size long, start long, piece int, content string, bytes long, lines int, joins_last boolean, "
    "joins_next boolean, valid boolean"
)


def _packer(part_bytes: int):
    """The packing function, nested so that it travels to the workers by value."""
    folded, goes_on, ends_in = str.maketrans(FOLDED, FOLDED_TO), GOES_ON, ENDS_IN

    def pack(batches):
        import pyarrow as pa

        block, piece, held, size, valid, open_end = None, 0, [], 0, True, True

        def close():
            content = "\n".join(held)
            return (*block, piece, content if valid else None, size, content.count("\n") + 1,
                    held[0].startswith(ends_in), open_end, valid)

        def batch_of(rows):
            columns = [pa.array(c) for c in zip(*rows)]
            columns[3], columns[6] = columns[3].cast(pa.int32()), columns[6].cast(pa.int32())
            columns[4] = columns[4].cast(pa.string())
            names = ["path", "size", "start", "piece", "content", "bytes", "lines", "joins_last", "joins_next", "valid"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for path, file_size, start, raw in zip(*(batch.column(at) for at in range(4))):
                own = path.as_py(), file_size.as_py(), start.as_py()
                raw = raw.as_py()
                try:
                    line = raw.decode().removesuffix("\r").replace("\r", "\n")
                except UnicodeDecodeError:
                    valid, line = False, ""
                full = size >= part_bytes and not open_end and not line.startswith(ends_in)
                if held and (own != block or full):
                    bad = own == block and not valid
                    yield batch_of([close()])
                    piece = piece + 1 if own == block else 0
                    held, size, valid = [], 0, not bad
                block = own
                held.append(line)
                size += len(raw) + 1
                tail = line.rstrip()
                open_end = tail.translate(folded).lower().endswith(goes_on) if tail else open_end or size == len(raw) + 1
        if held:
            yield batch_of([close()])

    return pack


def read_pieces(spark: SparkSession, root: str, least: int = MAX_BYTES + 1, part_bytes: int = PART_BYTES) -> DataFrame:
    """The pieces of all files of at least ``least`` bytes below ``root``; smaller files are not opened."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    about = lines.where(F.col("_metadata.file_size") >= least).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"),
    )
    return about.mapInArrow(_packer(part_bytes), _PIECE)


def read_parts(spark: SparkSession, root: str, least: int = MAX_BYTES + 1, part_bytes: int = PART_BYTES) -> DataFrame:
    """Parts of the long code files below ``root``: ``filename``, ``part``, ``first_line``, ``content`` and what
    ``source_files`` adds. A file with bytes that are not UTF-8 has no parts (see ``skipped_long_files``)."""
    pieces = materialize(read_pieces(spark, root, least, part_bytes), "pieces")
    return parts_of(pieces, root)


def parts_of(pieces: DataFrame, root: str) -> DataFrame:
    name = relative_name(F.col("path"), root)
    pieces = pieces.where(text.is_code_file(name))
    order = Window.partitionBy("path").orderBy("start", "piece")
    every = Window.partitionBy("path")
    facts = pieces.select("path", "size", "start", "piece", "bytes", "lines", "joins_last", "joins_next", "valid")
    joined = F.coalesce(F.col("joins_last") | F.lag("joins_next").over(order), F.lit(False))
    placed = facts.select(
        "path", "start", "piece", (1 + F.sum("lines").over(order) - F.col("lines")).cast("int").alias("first_line"),
        joined.alias("joined"), F.bool_and("valid").over(every).alias("valid"),
        F.row_number().over(order).alias("nth"), F.count("*").over(every).alias("n"),
        (F.col("size") - F.sum("bytes").over(every)).alias("rest"),
    ).where("valid")
    # the source leaves out a byte order mark, and does not tell whether a line feed ends the text; the size does
    placed = placed.withColumn("part", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order).cast("int"))
    content = F.concat(
        F.when((F.col("nth") == 1) & (F.col("rest") > 0), "\ufeff").otherwise(""), "content",
        F.when((F.col("nth") == F.col("n")) & F.col("rest").isin(0, 3), "\n").otherwise(""),
    )
    own = pieces.join(placed.drop("joined", "valid"), ["path", "start", "piece"]).withColumn("content", content)
    several = placed.groupBy("path", "part").agg(F.count("*").alias("pieces"), F.min("first_line").alias("line"))
    own = own.join(several, ["path", "part"]).select("path", "part", "pieces", "line", "start", "piece", "content")
    alone = own.where("pieces = 1").select("path", "part", "line", "content")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "piece", "content"))), lambda p: p["content"])
    joined_up = own.where("pieces > 1").groupBy("path", "part", "line").agg(F.array_join(in_order, "\n").alias("content"))
    return alone.unionByName(joined_up).select(
        name.alias("filename"), F.xxhash64(name).alias("file_id"), name.alias("file_ord"), text.file_ext(name).alias("ext"),
        F.lit("review").alias("status"), F.lit("").alias("patch"), "part", F.col("line").alias("first_line"), "content",
    )


def skipped_long_files(pieces: DataFrame, root: str) -> DataFrame:
    """The long files that have no parts, with the reason; ``pieces`` is (written) ``read_pieces``."""
    by_file = pieces.groupBy("path").agg(F.bool_and("valid").alias("valid"))
    name = relative_name(F.col("path"), root)
    reason = F.when(~text.is_code_file(name), "not a code file").when(~F.col("valid"), "not UTF-8")
    return by_file.select(name.alias("filename"), reason.alias("reason")).where("reason is not null")
