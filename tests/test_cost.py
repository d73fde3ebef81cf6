"""Work that is done once: what the large tables of a review would otherwise pay for several times."""

from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import forest, fusion, review, scale, vouchers
from ledgerloom.plans import evaluation, fixtures, textaudit

SMALL = "/root/testdata/sf0.001"


def test_facts_are_taken_apart_once(spark):
    assert str(textaudit.supported_numbers(F.col("facts"))).count("facts") == 1
    facts = '{"amount_paise":12345600,"share":0.256,"list":[7,-3],"evidence":"{\\"low\\":99,\\"text\\":\\"12-05 of 1,500.50\\"}"}'
    df = spark.createDataFrame([(facts, "123,456.00 25.6% 26 7 99 1500.5 05 41 0.50")], "facts string, text string")
    got = df.select(textaudit.unsupported_numbers(F.col("text"), F.col("facts")).alias("x")).first().x
    assert got == ["0.50", "41"]
    # Also beside a generator.
    beside = df.select(textaudit.supported_numbers(F.col("facts")).alias("x"), F.explode(F.array("text", "text")).alias("t"))
    assert ["123456" in r.x for r in beside.collect()] == [True, True]


def test_forbidden_phrases_keep_their_order(spark):
    df = spark.createDataFrame([("It proves Fraud.",), ("defraud",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(textaudit.forbidden_found(F.col("t")).alias("x")).collect()]
    assert got == [["fraud", "proves"], [], [], []]


def test_order_lines_read_the_items_once(spark):
    plan = fixtures.order_lines(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_one_task_is_not_asked_to_sort_millions_of_rows():
    assert scale.HOT_ROWS <= 200_000


def test_ranking_builds_no_reasons(spark):
    from checks.queries import Book

    book = Book(spark, SMALL)
    assert book.found.count() > 0 and "hits" not in vars(book)
    assert "reason" not in book.marks.columns


def test_features_and_scores_are_made_once_for_a_book(spark, monkeypatch):
    from checks.queries import Book

    calls, make = [], forest.voucher_features
    monkeypatch.setattr(forest, "voucher_features", lambda frames: calls.append(1) or make(frames))
    book = Book(spark, SMALL)
    forest.ml_scores(book.frames).count()
    forest.ml_anomaly_hits(book.frames).count()
    assert len(calls) == 1


def test_lines_are_dealt_by_voucher_before_they_are_grouped(spark, book):
    lines = book.add("L", "V1").add("L", "V2").frame(spark)
    plan = vouchers.voucher_view(lines)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("partial_sum") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "REPARTITION_BY_COL")
    done = vouchers.voucher_view(lines)._jdf.queryExecution().executedPlan().toString()
    assert done.count("Exchange hashpartitioning") == 1


def test_a_search_takes_digits_from_the_amount_itself(spark):
    amounts = [None, 0, 5, -7, 99, 100, -100, 12345, 100000, 123456789012345]
    df = spark.createDataFrame([(a,) for a in amounts], "amount_paise bigint")
    shown = F.regexp_replace(money.format_inr(F.col("amount_paise")), "[^0-9]", "")
    got = df.select(shown.alias("a"), money.amount_digits(F.col("amount_paise")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len({r.b for r in got}) > 6
    rows = df.select("amount_paise", *[F.lit("x").alias(c) for c in ("voucher_id", "narration", "created_by")], F.array(F.lit("y")).alias("account_names"))
    found = review.queue_search(rows, "x 345")
    assert "regexp" not in found._jdf.queryExecution().analyzed().toString()
    assert [r.amount_paise for r in found.orderBy("amount_paise").collect()] == [12345, 123456789012345]


def test_wide_tables_are_written_with_methods_the_jvm_compiles(spark, monkeypatch):
    from checks import queries

    wide = []
    note = lambda df, wide_=wide, **more: wide_.append((len(df.columns), more.get("wide", False))) or scale.stage(df, **more)
    monkeypatch.setattr(queries, "stage", note)
    monkeypatch.setattr(fusion, "stage", note)
    book = queries.Book(spark, SMALL)
    fusion.queue(book.found)
    assert [w for n, w in wide if n > 10] == [True, True, True]
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") != scale.COMPILED_METHOD


def test_variants_carry_what_is_interesting(spark):
    hits = spark.createDataFrame(
        [("L", f"V{n}", k, 0.5) for n in range(6) for k in ("weekend_posting", "missing_evidence")],
        "ledger_id string, voucher_id string, kind string, strength double",
    )
    context = hits.select("ledger_id", "voucher_id", F.lit(0.5).alias("completeness")).distinct()
    good = spark.createDataFrame([("L", "V1"), ("L", "V1"), ("L", "V4"), ("L", "V9"), (None, "V2")], "ledger_id string, voucher_id string")
    by = ["ledger_id", "variant"]
    carried = evaluation.variant_queues(hits, context, good)
    assert {(r.voucher_id, r.found) for r in carried.collect()} == {(f"V{n}", int(n in (1, 4))) for n in range(6)}
    looked_up = evaluation.queue_quality(evaluation.variant_queues(hits, context), good, by)
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert read(evaluation.queue_quality(carried, good, by)) == read(looked_up)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert joins(evaluation.found_marks(carried, good)) == 0
