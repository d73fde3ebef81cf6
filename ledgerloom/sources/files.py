"""Reading ledger files: encodings, spreadsheet row numbers, guards, fingerprints."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.config import LEDGER
from ledgerloom.operators.scale import stage
from ledgerloom.sources.mapping import LedgerError

FIRST_DATA_ROW = 2
#: Bytes of a file that are hashed in one go, and names that readers of text unpack.
PIECE = 1 << 14
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
BINARY = "It does not look like a CSV file: it contains binary data."
UNCLOSED = "A quoted field is never closed."

# What bytes 0x80-0x9F mean in Windows-1252, by position ("\x81" etc. stay).
LATIN_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0))
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def physical_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as bytes with file, file block and position in it, written to the shared folder.

    Written once, because positions must not change when a later job splits the files otherwise.
    UTF-16 has line ends the splitter cannot see: such a file is decoded whole by one task and must be of upload size.
    """
    lines = stage(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"),
        )
    )
    wide = (
        lines.where(F.col("block") == 0).groupBy("file").agg(F.min_by("bytes", "at").alias("head"))
        .where(F.hex(F.substring("head", 1, 2)).isin("FFFE", "FEFF")).select("file")
    )
    if wide.isEmpty():
        return lines.withColumn("wide", F.lit(False))
    whole = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "content")
    body = F.regexp_replace(F.decode("content", "UTF-16"), r"\r?\n$", "")
    decoded = whole.join(wide, "file", "left_semi").select("file", F.posexplode(F.split(body, r"\r?\n")).alias("at", "value"))
    decoded = decoded.select(
        "file", F.lit(0).cast("bigint").alias("block"), F.col("at").cast("bigint"), F.encode("value", "UTF-8").alias("bytes"), F.lit(True).alias("wide")
    )
    return lines.join(wide, "file", "left_anti").withColumn("wide", F.lit(False)).unionByName(decoded)


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line ends within a quoted field, if it starts within one (``inside``) or not."""
    closed = '"[^"]*+(?:""[^"]*+)*+"'
    if inside:
        first = F.regexp_replace(line, '^[^"]*+(?:""[^"]*+)*+"', "x")
        return (first == line) | ends_inside(first, False)
    return F.regexp_replace(line, f"(^|,){closed}", "$1x").rlike('(?:^|,)"')


def file_blocks(lines: DataFrame) -> DataFrame:
    """Per block of a file: lines before it, and of its file the encoding and whether quotes span lines."""
    text = F.col("bytes").cast("string")
    counted = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.bool_or("wide").alias("wide"),
        F.bool_and(F.is_valid_utf8(text)).alias("valid"),
        F.bool_or(F.contains("bytes", F.lit(b"\0"))).alias("nulls"),
        F.bool_or(F.contains(text, F.lit('"')) & ends_inside(text, False)).alias("spans"),
    )
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    encoding = (
        F.when(F.bool_or("wide").over(whole), "utf-16").when(F.bool_or("nulls").over(whole), "binary")
        .when(F.bool_and("valid").over(whole), "utf-8").otherwise("windows-1252")
    )
    return counted.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), encoding.alias("encoding"),
        F.bool_or("spans").over(whole).alias("spans"),
    )


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """Per file: ``utf-16``, ``utf-8``, ``windows-1252`` or ``binary`` (refused), with its size.

    Null bytes and validity are looked for in every line, in file blocks; contents are not gathered.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path", "length")
    known = file_blocks(physical_lines(spark, path)).select("file", "encoding").distinct()
    return files.join(known, "file", "left").select(
        "path", F.col("length").alias("size_bytes"), F.coalesce("encoding", F.lit("utf-8")).alias("encoding")
    )


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, bytes) of one task, joined again to pieces of about ``PIECE`` bytes and numbered as they come."""
    seq, held, size, spot = 0, [], 0, None

    def piece() -> pa.RecordBatch:
        cells = [[spot[0]], [spot[1]], [seq], [b"\n".join(held)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["file", "block", "seq", "bytes"])

    for batch in batches:
        for file, block, line in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if held and (size >= PIECE or (file, block) != spot):
                yield piece()
                seq, held, size = seq + 1, [], 0
            spot = (file, block)
            held.append(line)
            size += len(line) + 1
    if held:
        yield piece()


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its pieces in order. Its size tells what the reader left out: a mark at the start, a break at the end."""
    file, size, seen, plain, marked = None, 0, 0, None, None

    def digest() -> pa.RecordBatch:
        missing = size - seen
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{file} has {size} bytes, {seen} were read")
        whole = marked if missing >= 3 else plain
        whole.update(b"\n" * (missing % 3))
        return pa.RecordBatch.from_pydict({"file": [file], "sha256": [whole.hexdigest()]})

    for batch in batches:
        for name, length, part in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if name != file:
                if file is not None:
                    yield digest()
                file, size, seen, plain, marked = name, length, 0, hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)
            else:
                part = b"\n" + part
            seen += len(part)
            plain.update(part)
            marked.update(part)
    if file is not None:
        yield digest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of every file, none of which is ever held whole.

    Files are read as lines, split as any table, and joined to pieces; one task hashes the pieces of a file in order, because
    a hash runs from front to end. Readers of text would unpack files with a name such as ``.gz``: those are hashed whole.
    """
    name, packed = F.col("_metadata.file_path"), F.col("file").rlike(PACKED)
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), "content", name.alias("file"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("bytes"),
    ).where(~packed)
    known = files.where(~packed).drop("content")
    dealt = lines.mapInArrow(pieces, "file string, block bigint, seq bigint, bytes binary").join(
        F.broadcast(known.select("file", "size_bytes")), "file"
    ).repartition("file").sortWithinPartitions("file", "block", "seq")
    hashes = dealt.select("file", "size_bytes", "bytes").mapInArrow(hash_pieces, "file string, sha256 string")
    # A file of which the reader returns nothing holds a mark and nothing else.
    mark = F.when(F.col("size_bytes") == len(BYTE_ORDER_MARK), F.sha2(F.lit(BYTE_ORDER_MARK), 256))
    return known.join(hashes, "file", "left").select("path", "size_bytes", F.coalesce("sha256", mark).alias("sha256")).unionByName(
        files.where(packed).select("path", "size_bytes", F.sha2("content", 256).alias("sha256"))
    )


def folded(lines: DataFrame) -> DataFrame:
    """Lines of files in which quoted fields hold line breaks, as whole records: ``file, source_row, value, open``.

    What a line does to "within quotes" is one of four: nothing, the opposite, always out, always in. A running
    count inside each block and one over the blocks give the state at every line, so no file passes through one task.
    ``open`` marks the file's records if its last quote is never closed.
    """
    out, within = ends_inside(F.col("value"), False), ends_inside(F.col("value"), True)
    fixed = F.when(out == within, out.cast("int"))
    flip = F.when(out & ~within, 1).otherwise(0)
    block = Window.partitionBy("file", "block").orderBy("at")
    marked = lines.withColumn("fixed", fixed).withColumn("flips", F.sum(flip).over(block))

    def latest(order: Window) -> tuple[Column, Column]:
        """The last fixed state so far and the flips counted up to it."""
        last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "flips")), ignorenulls=True).over(order)
        return last["fixed"], F.coalesce(last["flips"], F.lit(0))

    base, since = latest(block)
    inner = marked.withColumn("base", base).withColumn("turns", F.col("flips") - since).select(
        "file", "block", "at", "value", "base", "turns"
    )
    ends = inner.groupBy("file", "block").agg(
        F.max_by("base", "at").alias("fixed"), F.max_by("turns", "at").alias("turns")
    )
    # A block's own turns count from its fixed state, if it has one, so they join the running count before or after it.
    along = Window.partitionBy("file").orderBy("block")
    chain = ends.withColumn("all", F.sum("turns").over(along)).withColumn("until", F.col("all") - F.when(F.col("fixed").isNotNull(), F.col("turns")).otherwise(0))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "until")), ignorenulls=True).over(along)
    state = F.pmod(F.coalesce(last["fixed"], F.lit(0)) + F.col("all") - F.coalesce(last["until"], F.lit(0)), F.lit(2))
    chain = chain.withColumn("end", state)
    chain = chain.select(
        "file", "block", F.coalesce(F.lag("end").over(along), F.lit(0)).alias("enter"),
        (F.max_by("end", "block").over(Window.partitionBy("file")) == 1).alias("open"),
    )
    known = inner.join(stage(chain), ["file", "block"])
    after = F.pmod(F.coalesce("base", "enter") + F.col("turns"), F.lit(2))
    begun = known.withColumn("starts", (F.coalesce(F.lag(after).over(block), F.col("enter")) == 0).cast("int"))
    begun = stage(begun.withColumn("record", F.sum("starts").over(block)).drop("base", "turns", "enter", "starts"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    sizes = begun.groupBy("file", "block").agg(F.max("record").alias("n"))
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = begun.join(stage(offsets), ["file", "block"]).withColumn("source_row", F.col("offset") + F.col("record"))
    # An open file is refused: its lines stay apart, so that no group grows to the end of the file.
    apart = F.when(F.col("open"), F.struct("block", "at"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    return numbered.groupBy("file", "source_row", apart.alias("apart")).agg(
        F.array_join(parts["value"], "\n").alias("value"), F.bool_or("open").alias("open")
    ).drop("apart")


def csv_records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """CSV records as text, ``file, source_row, value``, and the files refused, ``file, reason``.

    ``source_row`` is the row a spreadsheet shows: blank lines count, a record with line breaks in quotes is one
    row (breaks become ``\\n``). Each file is read in the encoding that fits it. Text is shuffled only for files
    whose quotes span lines.
    """
    lines = physical_lines(spark, path)
    blocks = stage(file_blocks(lines))
    latin = F.translate(F.decode("bytes", "ISO-8859-1"), LATIN_CONTROLS, WINDOWS_1252)
    text = F.when(F.col("encoding") == "windows-1252", latin).otherwise(F.col("bytes").cast("string"))
    row = F.col("offset") + F.col("at") - F.col("first") + 1
    known = (
        lines.join(blocks.where(F.col("encoding") != "binary"), ["file", "block"])
        .withColumn("row", row)
        .withColumn("value", F.when(F.col("row") == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text))
    )
    plain = known.where(~F.col("spans")).select("file", F.col("row").alias("source_row"), "value")
    refused = blocks.where(F.col("encoding") == "binary").select("file", F.lit(BINARY).alias("reason")).distinct()
    if blocks.where(F.col("spans")).isEmpty():
        return plain, refused
    whole = stage(folded(known.where("spans").select("file", "block", "at", "value")))
    open_files = whole.where("open").select("file", F.lit(UNCLOSED).alias("reason")).distinct()
    return plain.unionByName(whole.where(~F.col("open")).drop("open")), refused.unionByName(open_files)


def numbered_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``csv_records`` of files that must all be readable."""
    records, refused = csv_records(spark, path)
    first = refused.first()
    if first:
        raise LedgerError(f"{first['file']}: {first['reason']}")
    return records


def header_of(lines: DataFrame) -> list[str]:
    first = lines.where(F.col("source_row") == 1).select("value").first()
    return split_header(first[0] if first else "")


def split_header(line: str) -> list[str]:
    if not line.strip():
        raise LedgerError("The file has no columns.")
    return [h.strip() for h in next(csv.reader([line]))]


def parse_rows(lines: DataFrame, headers: list[str], keep: list[Column] | None = None) -> DataFrame:
    """Text lines to columns, every value text, only the empty field null."""
    keep = keep or []
    fields = [f"c{i}" for i in range(len(headers))]
    schema = ", ".join(f"{f} string" for f in fields)
    parsed = F.from_csv("value", F.lit(schema), {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    body = lines.where(F.col("source_row") > 1).select("source_row", *keep, parsed.alias("r"))
    return body.select(
        *[c for c in body.columns if c != "r"], *[F.nullif(F.col(f"r.{f}"), F.lit("")).alias(h) for f, h in zip(fields, headers, strict=True)]
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV ledger as text with ``source_row`` (header is row 1), in whichever encoding fits each file."""
    lines = numbered_text(spark, path)
    return parse_rows(lines, header_of(lines))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def intake_guards(
    rows: DataFrame, size_bytes: Column | None = None, max_rows: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Expectations as a table ``(check, ok, value)``; limits are off unless given."""
    columns = len([c for c in rows.columns if c != "source_row"])
    n, size = F.col("n"), F.col("size")
    checks = [
        ("has_columns", F.lit(columns > 0), F.lit(columns)),
        ("has_rows", n > 0, n),
        ("rows_within_limit", F.lit(True) if max_rows is None else n <= max_rows, n),
        ("bytes_within_limit", F.lit(True) if max_bytes is None else F.coalesce(size <= max_bytes, F.lit(True)), size),
    ]
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.max(size_bytes if size_bytes is not None else F.lit(None).cast("bigint")).alias("size"))
    rows_of = F.array(*[F.struct(F.lit(c).alias("check"), ok.alias("ok"), v.cast("bigint").alias("value")) for c, ok, v in checks])
    return one.select(F.inline(rows_of))


def preview(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of ``limit`` rows of a raw file, by spreadsheet row."""
    first = FIRST_DATA_ROW + offset
    return rows.where(F.col("source_row").between(first, first + limit - 1))


def register_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: one per (engagement, content hash) not recorded yet, earliest upload first."""
    key = ["engagement_id", "sha256"]
    cols = [c for c in incoming.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct("uploaded_at", "id")).alias("r"))
    return first.select(*key, "r.*").join(existing.select(*key), key, "left_anti").select(*incoming.columns)


def live_sources(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Source records with who deleted them and when (first deletion counts)."""
    gone = tombstones.groupBy("id").agg(
        F.min("deleted_at").alias("deleted_at"), F.min_by("deleted_by", "deleted_at").alias("deleted_by")
    )
    return records.join(gone, "id", "left").withColumn("live", F.col("deleted_at").isNull())


def unreferenced_hashes(sources: DataFrame) -> DataFrame:
    """Content hashes no live record points at: their bytes may go."""
    return sources.groupBy("sha256").agg(F.max("live").alias("live")).where(~F.col("live")).select("sha256")


def write_ledger(lines: DataFrame, path: str) -> None:
    """Ledger to parquet, one folder per ledger, so one ledger is one pruned partition."""
    lines.write.mode("overwrite").partitionBy(LEDGER).parquet(path)
