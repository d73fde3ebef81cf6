"""An order-independent digest of a ledger's content that combines map-side.

Each line is hashed (SHA-256 over its columns in name order, provenance left out), the hash
is cut into four 64-bit words, the words are summed per ledger with the line count, and the
sums are hashed. Equal sets of lines give equal digests in any order and any partitioning,
and no sort of the ledger is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import LEDGER

PROVENANCE = {"source_row", "ledger_id"}
#: Separates columns.
GAP = "\u001f"


def line_text(lines: DataFrame) -> Column:
    kept = sorted(c for c in lines.columns if c not in PROVENANCE)
    return F.concat_ws(GAP, *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in kept])


def ledger_digest(lines: DataFrame) -> DataFrame:
    hashed = lines.select(LEDGER, F.sha2(line_text(lines), 256).alias("h"))
    word = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(28,0)")
    sums = hashed.groupBy(LEDGER).agg(
        F.count(F.lit(1)).alias("n_lines"), *[F.sum(word(i)).alias(f"s{i}") for i in range(4)]
    )
    return sums.select(
        LEDGER, F.sha2(F.concat_ws(":", "n_lines", "s0", "s1", "s2", "s3"), 256).alias("digest"), "n_lines"
    )


def table_fingerprint(frame: DataFrame, places: int = 4) -> DataFrame:
    """Digest of a small result table with its doubles rounded, to compare two runs."""
    parts = [
        F.format_number(F.col(f.name), places) if f.dataType.typeName() == "double" else F.col(f.name).cast("string")
        for f in sorted(frame.schema.fields, key=lambda f: f.name)
    ]
    row = F.concat_ws(GAP, *[F.coalesce(p, F.lit("␀")) for p in parts])
    return ledger_digest(frame.select(F.lit("all").alias(LEDGER), row.alias("row"))).select(
        F.substring("digest", 1, 16).alias("fingerprint"), F.col("n_lines").alias("rows")
    )
