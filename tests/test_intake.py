import csv
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators import scale
from ledgerloom.sources import conform, export, files, mapping, validate


def one(spark, expr_of, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr_of(F.col("v"))).collect()]


def test_dates_are_read_value_by_value(spark):
    texts = ["2024-04-01", "2024-04-01 11:30:05", "03/05/2024", "3-5-24", "03.05.2024", "45383", "45399", "2024/04/17",
             "1 Apr 2024", "04/25/2024", "05-06-2024 2:30 PM", "", None, "junk", "31-02-2024"]
    d = lambda *a: dt.datetime(*a)
    want = [d(2024, 4, 1), d(2024, 4, 1, 11, 30, 5), d(2024, 5, 3), d(2024, 5, 3), d(2024, 5, 3), d(2024, 4, 1), d(2024, 4, 17),
            d(2024, 4, 17), d(2024, 4, 1), d(2024, 4, 25), d(2024, 6, 5, 14, 30), None, None, None, None]
    assert one(spark, dates.parse_ledger_date, texts) == want


def test_money_text(spark):
    texts = ["₹1,23,456.78", "(1,200)", " -50.5 ", "abc", None, "0.07"]
    assert one(spark, money.rupee_text_to_paise, texts) == [12345678, -120000, -5050, 0, 0, 7]
    assert one(spark, money.format_inr, [12345678, -100, 0, 99, 100000, 1234567890], "bigint") == [
        "₹1,23,456.78", "-₹1.00", "₹0.00", "₹0.99", "₹1,000.00", "₹1,23,45,678.90"
    ]
    assert one(spark, money.exact_rupees_to_paise, ["1.25", "1.255", "x"]) == [125, None, None]
    assert one(spark, money.money_problem, ["1.25", "1.255", "inf", "10000000001"]) == [
        None, "finer_than_a_paisa", "not_a_finite_number", "beyond_the_sanity_limit"
    ]


def test_spreadsheet_formulas_are_made_inert(spark):
    cells = ["=1+1", "  @x", "\tx", "plain", "-5", "a=b", None]
    assert one(spark, text.spreadsheet_safe, cells) == ["'=1+1", "'  @x", "'\tx", "plain", "'-5", "a=b", None]


@pytest.mark.parametrize("headers", [
    ["Date", "Voucher", "Ledger", "Amount"], ["Txn Date", "Txn ID", "Account Head", "Dr", "Cr"],
    ["Date", "Vch No.", "Particulars", "Debit", "Credit"], ["posting_date", "document_id", "account_description", "debit", "credit"],
])
def test_header_shapes_are_usable(headers):
    found = mapping.use_posting_date(mapping.map_headers(headers))
    mapping.check_usable(found)
    assert found.missing == []


def test_two_headers_for_one_field_are_ambiguous_and_overrides_win():
    found = mapping.map_headers(["Date", "Txn Date", "Foo"], {"Foo": "narration"})
    assert found.ambiguous == {"Txn Date": ["voucher_date"], "Date": ["voucher_date"]}
    assert found.resolved == {"Date": "voucher_date", "Foo": "narration"}
    with pytest.raises(mapping.LedgerError, match="a voucher number"):
        mapping.check_usable(found)
    many = mapping.map_headers(["Vch No", "Date", "Doc No", "What", "Voucher", "Amount", "Ledger"], {"What": "narration"})
    assert many.resolved == {"Vch No": "voucher_id", "Date": "voucher_date", "What": "narration", "Amount": "amount", "Ledger": "account_name"}
    assert set(many.ambiguous) == {"Vch No", "Doc No", "Voucher"} and many.unmapped == [] and many.missing == []
    late = mapping.use_posting_date(mapping.map_headers(["Posting Date", "Foo"]))
    assert late.resolved == {"Posting Date": "voucher_date"} and late.unmapped == ["Foo"] and late.missing == ["account_name", "voucher_id", mapping.AMOUNT]


def tally(spark):
    rows = [
        (2, "01-04-2024", "V1", "Purc", "Rent", "2,00,000.00", "", "April rent"),
        (3, "01-04-2024", "V1", "Purc", "Bank", "", "2,00,000.00", ""),
        (4, None, None, None, None, None, None, None),
        (5, "sometime", "V2", "Jrnl", "Rent", "1", "", "bad date"),
        (6, "02-04-2024", " ", "Jrnl", "Rent", "1", "", "no voucher"),
    ]
    names = ["Date", "Vch No.", "Vch Type", "Particulars", "Debit", "Credit", "Narration"]
    return spark.createDataFrame(rows, "source_row bigint, " + ", ".join(f"`{n}` string" for n in names))


def test_a_day_book_becomes_lines_and_says_what_it_did(spark):
    lines, report, seen = conform.conform(tally(spark), ledger_id="T")
    got = lines.orderBy("source_row").collect()
    assert [(r.line_id, r.debit_paise, r.credit_paise, r.account_code, r.voucher_type) for r in got] == [
        ("V1-01", 20_000_000, 0, "Rent", "purchase"), ("V1-02", 0, 20_000_000, "Bank", "purchase")
    ]
    assert [r.source_row for r in got] == [2, 3] and got[0].fiscal_year == "FY2024-25" and got[0].period == 1
    r = report.first()
    assert (r.rows_in, r.rows_out, r.unreadable_dates) == (4, 2, 1) and "document_ref" in r.defaulted and len(r.notes) == 4
    assert "account_code (from the ledger name)" in seen.derived


def test_signed_amounts_split(spark):
    raw = spark.createDataFrame(
        [(2, "2024-04-01", "V1", "Rent", "1,50,000.00"), (3, "2024-04-01", "V1", "Bank", "-1,50,000.00")],
        "source_row bigint, Date string, Voucher string, Ledger string, Amount string",
    )
    got = conform.conform(raw, ledger_id="T")[0].orderBy("source_row").collect()
    assert [(r.debit_paise, r.credit_paise) for r in got] == [(15_000_000, 0), (0, 15_000_000)]


def test_line_numbers_of_a_voucher_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 20)
    rows = [(n + 2, "2024-04-01", "V1", f"A{n}", "1") for n in range(150)]
    raw = spark.createDataFrame(rows, "source_row bigint, Date string, Voucher string, Ledger string, Amount string")
    got = conform.conform(raw, ledger_id="T")[0].orderBy("source_row").collect()
    assert [r.line_number for r in got] == list(range(1, 151)) and got[99].line_id == "V1-100" and got[8].line_id == "V1-09"


def test_csv_rows_keep_their_spreadsheet_numbers(spark, tmp_path):
    path = tmp_path / "book.csv"
    path.write_text("﻿Date,Voucher,Ledger,Amount\n2024-04-01,V1,\"Rent, office\",10\n\n2024-04-02,V2,Bank,-3\n", encoding="utf-8")
    rows = files.read_csv(spark, str(path))
    got = {r.source_row: (r.Date, r.Ledger) for r in rows.collect()}
    assert got == {2: ("2024-04-01", "Rent, office"), 3: (None, None), 4: ("2024-04-02", "Bank")}
    lines = conform.conform(rows, ledger_id="T")[0]
    assert sorted(r.source_row for r in lines.collect()) == [2, 4]


def test_blocks_of_one_file_number_on(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("h\n" + "\n".join(f"row {n:05d}" for n in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = files.numbered_text(spark, str(path)).where("source_row > 1").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5000 and all(r.value == f"row {r.source_row - 2:05d}" for r in got)


def test_encodings(spark, tmp_path):
    body = "Date,Voucher,Ledger,Amount\n2024-04-01,V1,Café €,10\n"
    (tmp_path / "a.csv").write_text(body, encoding="utf-8")
    (tmp_path / "b.csv").write_text(body, encoding="cp1252")
    (tmp_path / "c.csv").write_text(body, encoding="utf-16")
    (tmp_path / "d.csv").write_bytes(b"PK\x00\x01")
    found = {r.path[-5:]: r.encoding for r in files.file_encodings(spark, str(tmp_path / "*.csv")).collect()}
    assert found == {"a.csv": "utf-8", "b.csv": "windows-1252", "c.csv": "utf-16", "d.csv": "binary"}
    for name in ("a.csv", "b.csv", "c.csv"):
        assert files.read_csv(spark, str(tmp_path / name)).first().Ledger == "Café €"
    with pytest.raises(mapping.LedgerError, match="binary"):
        files.read_csv(spark, str(tmp_path / "d.csv"))


QUOTED = [
    ['plain', 'a, "b"', ''], ['two\nlines', 'x', 'y'], ['', '', ''], ['"', '\n"\n', 'z'], ['12 pipe', 'three\n\nlines, "q"', '9'],
    ['end', 'of', 'file\n'],
]


@pytest.mark.parametrize("split", ["40", "134217728"])
def test_line_breaks_in_quotes_stay_in_their_record(spark, tmp_path, split):
    path = tmp_path / "quoted.csv"
    with path.open("w", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerows([["a", "b", "c"], *QUOTED * 20])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.read_csv(spark, str(path)).orderBy("source_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.source_row for r in got] == list(range(2, 2 + 20 * len(QUOTED)))
    assert [[r.a or "", r.b or "", r.c or ""] for r in got] == QUOTED * 20


def test_a_quote_inside_a_plain_field_opens_nothing_and_an_unclosed_one_is_refused(spark, tmp_path):
    (tmp_path / "inch.csv").write_text('a,b\n12" pipe,1\n8" pipe,2\n')
    assert [r.b for r in files.read_csv(spark, str(tmp_path / "inch.csv")).orderBy("source_row").collect()] == ["1", "2"]
    (tmp_path / "open.csv").write_text('a,b\nx,"never\ny,2\n')
    with pytest.raises(mapping.LedgerError, match="never closed"):
        files.read_csv(spark, str(tmp_path / "open.csv"))


def test_rules_reject_lines_without_stopping(spark, book):
    lines = book.add("L", "V1").add("L", "V2", amount=0).add("L", "V3", currency="inr").frame(spark)
    checked = validate.check_lines(lines)
    assert {(r.voucher_id, tuple(r.problems)) for r in validate.rejected(checked).collect()} == {
        ("V2", ("not_one_sided",)), ("V3", ("currency_shape",))
    }
    assert validate.ingest_summary(checked).first().accepted == 2
    assert validate.error_report(checked, 3).count() == 3


def test_day_book_round_trip(spark, book):
    lines = book.add("L", "V1", amount=123_456).add("L", "V2", amount=99, date="2024-07-01").frame(spark)
    back = conform.conform(export.daybook(lines, ["source_row"]), ledger_id="L")[0]
    cols = ["line_id", "voucher_date", "debit_paise", "credit_paise", "account_name", "narration", "document_ref", "approved_by", "created_by", "posted_at"]
    assert sorted(back.select(cols).collect()) == sorted(lines.select(cols).collect())


def test_a_date_is_rewritten_and_cast_once(spark):
    texts = ["05-01-2024 12:15 am", "5 jan 2024 12:15 PM", "05/01/24, 1:02:03 pm", "05-01-2024 13:05 pm", "05-01-2024 13:05 am",
             "05-01-2024 24:00 pm", "2024-01-05 10:00 pm", "2024/1/5 10:00", "45000.5", "19999", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", dates.parse_ledger_date(F.col("t")))
    got = [r.d and r.d.isoformat() for r in rows.orderBy("i").collect()]
    assert got == ["2024-01-05T00:15:00", "2024-01-05T12:15:00", "2024-01-05T13:02:03", "2024-01-05T13:05:00", "2024-01-05T01:05:00",
                   None, None, "2024-01-05T10:00:00", "2023-03-15T12:00:00", None, None]
    # The month names stand in the plan as often as the text is rewritten.
    assert rows._jdf.queryExecution().analyzed().toString().lower().count("feb") == 1


def test_files_are_laid_end_to_end_without_moving_their_rows(spark):
    from ledgerloom.streaming.ingest import laid_end_to_end

    rows = [(f"file:/drop/folder={b}/part-{p}.csv", n, f"{b}{p}{n}") for b in "XY" for p in range(2) for n in range(1, 4 + p)]
    records = spark.createDataFrame(rows, "file string, source_row bigint, value string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed, sizes = laid_end_to_end(records, "folder")
        plan = placed._jdf.queryExecution().sparkPlan().toString()
        got = {(r.ledger_id, r.value): r.offset for r in placed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "SortMergeJoin" not in plan and "regexp_extract" not in plan
    assert got == {(f"folder={b}", f"{b}{p}{n}"): 3 * p for b in "XY" for p in range(2) for n in range(1, 4 + p)}
    assert sorted(r.rows_read for r in sizes.collect()) == [3, 3, 4, 4]


def test_a_wide_stage_leaves_the_session_as_it_was(spark):
    from ledgerloom.operators.scale import stage

    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    assert sorted(r[0] for r in stage(spark.range(3).toDF("a"), wide=True).collect()) == [0, 1, 2]
    assert spark.conf.get(limit) == before


def test_fingerprints_of_any_bytes_without_holding_a_file(spark, tmp_path):
    """Marks, breaks of every kind, none at all, and files read in many splits hash as their bytes do."""
    import gzip
    import hashlib
    import random

    mark = b"\xef\xbb\xbf"
    noise = random.Random(7).randbytes(300_000)
    contents = {
        "plain.bin": noise, "ended.bin": noise + b"\n", "marked.bin": mark + noise, "both.bin": mark + noise + b"\n\n", "mark only.bin": mark,
        "mark break.bin": mark + b"\n", "break.bin": b"\n", "breaks.bin": b"\r\n\r\n\n\r", "zeros.bin": b"\0" * 70_000, "x.gz": gzip.compress(noise),
    }
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = files.fingerprints(spark, f"{tmp_path}/*")
        got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in found.collect()}
        plan = found.where("path not like '%.gz'")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in contents.items()}
    assert "MapInArrow" in plan
