"""Line dedup: hashes ranged over partitions, first occurrences streamed, decisions as per-document bitmaps.

Only 16-byte line hashes travel: they are range-partitioned with a secondary sort by document and
position, the first occurrence in each document is recognised from the row before, and what comes
back to the documents is a sparse bitmap (64-line words that lose at least one line). Built-in
functions only.

Defined cases: a null or empty text is one empty line; a null doc_id counts as one document, smaller
than any other; rows that repeat a doc_id belong to one document, and each row is answered; an empty
table gives an empty result; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, fold
from ledgerloom.operators.scale import stage

#: Lines of one hash that are streamed together; more are cut into slices by document.
SLICE_ROWS = 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(fold(line), F.lit(SPACE))


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Which lines go: (doc_id, text_key, words map<word, bits>, n_dropped) for documents that lose any.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines
    except in the largest doc_id that holds them. Bit i % 64 of word i / 64 stands for line i.
    """
    keyed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    long_enough = F.filter(keyed, lambda s: F.char_length(s["key"]) >= min_chars)
    marks = stage(
        docs.select(
            F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
            F.transform(long_enough, lambda s: F.struct(s["pos"].alias("pos"), F.unhex(F.md5(s["key"])).alias("h"))).alias("marks"),
        ).where(F.size("marks") > 0)
    )
    found = marks.select("doc", "text_key", F.inline("marks"))
    hot = stage(
        found.groupBy("h").count().where(F.col("count") > slice_rows)
        .select("h", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    )
    placed = found.join(hot, "h", "left").withColumns({
        "slices": F.coalesce("slices", F.lit(1)),
        "slice": F.expr("cast(pmod(xxhash64(doc), coalesce(slices, 1)) as int)"),
    })
    latest_first = [F.col("h"), F.col("slice"), F.col("doc").desc_nulls_last(), F.col("text_key"), F.col("pos")]
    ranged = placed.repartitionByRange("h", "slice").sortWithinPartitions(*latest_first)
    run = Window.partitionBy("h", "slice").orderBy(*latest_first[2:])
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    streamed = ranged.withColumn("first", (F.row_number().over(run) == 1) | ~F.col("doc").eqNullSafe(F.lag("doc").over(run)))
    marked = stage(
        streamed.withColumns({"docs": F.sum(F.col("first").cast("long")).over(whole), "top": F.first("doc").over(whole)})
        .where((F.col("slices") > 1) | (F.col("docs") >= min_docs)).drop("first")
    )
    # A key that was cut into slices: one row per slice, then one per key, then back to the slices.
    per_slice = marked.where("slices > 1").groupBy("h", "slice").agg(F.max("docs").alias("docs"), F.max("top").alias("top"), F.max("slices").alias("slices"))
    merged = stage(
        per_slice.groupBy("h").agg(F.sum("docs").alias("docs_all"), F.max("top").alias("top_all"), F.max("slices").alias("slices"))
        .where(F.col("docs_all") >= min_docs)
        .select("h", "top_all", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))
    )
    drops = marked.where((F.col("slices") == 1) & ~F.col("doc").eqNullSafe(F.col("top"))).select("doc", "text_key", "pos").unionByName(
        marked.where("slices > 1").join(merged, ["h", "slice"]).where(~F.col("doc").eqNullSafe(F.col("top_all"))).select("doc", "text_key", "pos")
    )
    words = drops.groupBy("doc", "text_key", F.expr("cast(pos div 64 as int)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")
    )
    return words.groupBy("doc", "text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped")
    )


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """Every row of docs as ``row`` (a struct, so no column can clash) with kept_text, n_lines, n_dropped and words."""
    bitmaps = drop_bitmaps(docs.select("doc_id", "text"), **how)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("row_key"))
    joined = held.join(bitmaps, held["row.doc_id"].eqNullSafe(bitmaps["doc"]) & (held["row_key"] == bitmaps["text_key"]), "left")
    lines = lines_of(F.col("row.text"))
    kept = F.filter(lines, lambda x, i: F.coalesce(F.col("words")[(i / 64).cast("int")], F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0)
    return joined.select(
        "row", F.when(F.col("words").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "words",
    )


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with the dropped lines gone from text (a null text stays null), n_chars brought up to date if there."""
    out = drop_lines(docs, **how)
    kept = F.when(F.col("words").isNull(), F.col("row.text")).otherwise(F.col("kept_text"))
    new = {"text": kept, "n_chars": F.when(F.col("words").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {"text": kept}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
