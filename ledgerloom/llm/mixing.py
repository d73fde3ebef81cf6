"""Mixing sources to target weights: exact block quotas dealt to output shards by a splitting tree.

1. Each source's target is its share of all words by weight, at most ``most`` times its own size; what
   is cut off goes to the other sources by weight until no source is above.
2. A source's documents lie in hash-drawn blocks. A target of k.f times the source means k whole
   passes, and one pass over the first blocks until f is reached (to the nearest document).
3. The block instances of all sources are dealt to shards: a node of the tree halves its shards and
   draws, source by source and block by block without replacement, how many of each source's blocks
   go left (a multivariate hypergeometric draw with exact totals), down to single shards.
4. Each shard draws that many blocks from a fixed permutation of the source's block instances, so
   shards are disjoint; rows are shuffled inside their shard only.

Everything is drawn by hashes of whole rows, so reruns agree. Built-in functions only.

Defined cases: a null text has size 0 and is taken as often as its source says, adding nothing; a null
source is a source of its own, last in order; identical rows are separate documents; no words at all
give targets of 0; an empty table gives an empty result; all columns travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, uniform
from ledgerloom.operators.scale import ranked, stage

#: Documents in a block, on average, and blocks that are summed together first.
BLOCK_DOCS = 256
BLOCKS_PER_SUM = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From (no_source, source_name, size): one row per source with source_size, docs and target (staged)."""
    per = stage(sizes.groupBy("no_source", "source_name").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("one", F.lit(1)))
    numbered = ranked(per, ["one"], ["no_source", "source_name"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, len(weights)) + 1).cast("int"))
    sources = stage(numbered.select("no_source", "source_name", "source_size", "docs", weight.alias("weight")))
    cap = F.col("source_size") * most
    total, mass = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, capped = (total / mass if mass else 0.0), -1
    while True:
        over = cap < F.col("weight") * level
        n, kept, held = sources.where(over).agg(F.count("*"), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if n == capped or held >= mass:
            break
        capped, level = n, (total - kept) / (mass - held)
    return stage(sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level)))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """From (source_no, blocks), exact: (source_no, shard, blocks) for ``shards`` shards of equal totals.

    The vector of quotas is one cell per tree node: one entry per source. Below the root a node only
    sees the blocks that came down to it, and the nodes of a level are split side by side.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("source_no", "blocks"))).alias("quota")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quota").where(F.size("quota") > 0)
    node = stage(node.withColumn("sum_all", F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q["blocks"])))
    span = shards
    while span > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        at = lambda m: F.floor(F.col("sum_all") * m / shards)
        need = (at(mid) - at(F.col("lo"))).cast("long")
        rest = F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q["blocks"])

        def deal(state: Column, q: Column) -> Column:
            """One source: its blocks go left one at a time, with probability need / rest."""
            steps = F.when(q["blocks"] > 0, F.sequence(F.lit(1).cast("long"), q["blocks"])).otherwise(F.array().cast("array<bigint>"))

            def one(s: Column, i: Column) -> Column:
                left = (uniform(F.lit(seed), F.col("lo"), F.col("hi"), q["source_no"], i) * s["rest"] < s["need"]).cast("long")
                return F.struct((s["rest"] - 1).alias("rest"), (s["need"] - left).alias("need"), (s["got"] + left).alias("got"))

            start = F.struct(state["rest"].alias("rest"), state["need"].alias("need"), F.lit(0).cast("long").alias("got"))
            end = F.aggregate(steps, start, one)
            return F.struct(end["rest"].alias("rest"), end["need"].alias("need"), F.concat(state["got"], F.array(end["got"])).alias("got"))

        whole = F.struct(rest.alias("rest"), need.alias("need"), F.array().cast("array<bigint>").alias("got"))
        dealt = stage(node.where("hi - lo > 1").withColumns({"mid": mid, "got": F.aggregate("quota", whole, deal)["got"]}))
        part = lambda take: F.transform("quota", lambda q, i: F.struct(q["source_no"].alias("source_no"), take(q, F.col("got")[i]).alias("blocks")))
        left = dealt.select("lo", F.col("mid").alias("hi"), part(lambda q, g: g).alias("quota"), "sum_all")
        right = dealt.select(F.col("mid").alias("lo"), "hi", part(lambda q, g: q["blocks"] - g).alias("quota"), "sum_all")
        node = stage(left.unionByName(right).unionByName(node.where("hi - lo = 1")))
        span = (span + 1) // 2
    return node.select(F.col("lo").alias("shard"), F.inline("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 16, seed: int = 5, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Every row of docs as ``row`` with size, source_size, target, shards (one entry per time it is taken) and taken."""
    # Hashes of whole rows, taken where the texts are (nulls hash as their place): rows tie only if all they hold is equal.
    held = [F.struct(F.lit(i), docs[f.name]) for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()]
    everything = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), word_count(docs["text"]).alias("size"),
        docs["source"].isNull().alias("no_source"), F.coalesce(docs["source"], F.lit("")).alias("source_name"),
        uniform(F.lit(seed), *held).alias("draw"), F.xxhash64(F.lit(~seed), *held).alias("tie"),
    )
    sources = source_targets(everything.select("no_source", "source_name", "size"), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    sources = stage(sources.withColumns({
        "source_no": F.xxhash64("no_source", "source_name"), "passes": whole, "blocks": F.ceil(F.col("docs") / block_docs),
    }).withColumn("rest", F.when(F.col("passes") >= most, 0.0).otherwise(F.col("target") - F.col("passes") * F.col("source_size"))))
    placed = everything.join(sources, ["no_source", "source_name"]).withColumn(
        "block", F.least(F.floor(F.col("draw") * F.col("blocks")), F.col("blocks") - 1)
    )
    # Words before each block: within runs of blocks, and over the runs.
    key = ["no_source", "source_name"]
    per_block = stage(placed.groupBy(*key, "block").agg(F.sum("size").alias("words")).withColumn("run", F.expr(f"block div {BLOCKS_PER_SUM}")))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = per_block.groupBy(*key, "run").agg(F.sum("words").alias("words")).withColumn("run_before", F.coalesce(F.sum("words").over(so_far(Window.partitionBy(*key).orderBy("run"))), F.lit(0))).drop("words")
    before = (
        per_block.withColumn("in_run", F.coalesce(F.sum("words").over(so_far(Window.partitionBy(*key, "run").orderBy("block"))), F.lit(0)))
        .join(runs, [*key, "run"]).select(*key, "block", "words", (F.col("in_run") + F.col("run_before")).alias("before"))
    )
    # Block instances of each source: all blocks once per whole pass, and the first ones once more.
    facts = before.join(sources.select(*key, "source_no", "passes", "blocks", "rest"), key).withColumn("touched", F.col("before") < F.col("rest"))
    facts = stage(facts)
    quotas = stage(
        facts.groupBy(*key, "source_no", "passes", "blocks").agg(F.max(F.when(F.col("touched"), F.col("block") + 1).otherwise(0)).alias("extra"))
        .select(*key, "source_no", (F.col("passes") * F.col("blocks") + F.col("extra")).cast("long").alias("instances"))
    )
    dealt = split_quotas(quotas.select("source_no", F.col("instances").alias("blocks")), shards, seed)
    spans = dealt.withColumn("to", F.sum("blocks").over(Window.partitionBy("source_no").orderBy("shard"))).withColumn("start", F.col("to") - F.col("blocks"))
    slots = spans.where("blocks > 0").select("source_no", F.explode(F.expr("sequence(start, to - 1)")).alias("slot"), "shard")
    # A fixed permutation of a source's instances: an affine map with a prime factor (2^31 - 1).
    instances = facts.join(quotas.select(*key, "instances"), key).select(
        *key, "source_no", "block", "instances",
        F.explode(F.expr("sequence(0, passes - 1 + if(touched, 1, 0))")).alias("nth"), "blocks", "passes", "touched",
    ).where("nth >= 0 and nth < passes + if(touched, 1, 0)").withColumn(
        "slot", F.expr(f"pmod((nth * blocks + block) * 2147483647 + pmod(xxhash64({seed}, source_no), instances), instances)")
    )
    homes = stage(
        instances.join(slots, ["source_no", "slot"]).groupBy(*key, "block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shard"))), lambda s: s["shard"]).alias("homes"))
    )
    blocks = stage(facts.join(homes, [*key, "block"], "left").select(
        *key, "block", "before", "rest", "passes", F.coalesce("homes", F.array().cast("array<int>")).alias("homes")
    ))
    rows = placed.select("row", "size", *key, "source_size", "target", "draw", "tie", "block").join(blocks, [*key, "block"])
    inside = Window.partitionBy(*key, "block").orderBy("draw", "tie")
    here = F.col("before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    times = F.col("passes") + (here + F.col("size") / 2 < F.col("rest")).cast("int")
    return rows.withColumn("shards", F.slice("homes", F.lit(1), times)).select(
        "row", "size", "source_size", "target", "shards", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "draw"
    )


def mixed(docs: DataFrame, shards: int = 16, seed: int = 5, **how) -> DataFrame:
    """The mixed corpus: rows of docs as often as they are taken, shuffled inside their shard."""
    dealt = mix(docs, shards=shards, seed=seed, **how).select("row", F.posexplode("shards").alias("nth", "shard"))
    order = F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("nth"))
    return dealt.withColumn("turn", order).repartition("shard", F.pmod(F.col("turn"), F.lit(16))).sortWithinPartitions("shard", "turn").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns]
    )
