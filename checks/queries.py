"""One query per operator, each over whole given tables (or ledgers Spark derives from them)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.config import KEY, LEDGER, threshold_frame
from ledgerloom.functions import dates, labels, money, text
from ledgerloom.operators import balances, digest, evidence, fusion, review, signals, similar, statistics, vouchers
from ledgerloom.operators.scale import shared_dir, stage
from ledgerloom.operators.vouchers import LedgerFrames
from ledgerloom.plans import evaluation, explain, fixtures, textaudit
from ledgerloom.plans.review import EVERYTHING, all_hits, build_findings
from ledgerloom.sources import conform, export, files, mapping, sap, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LEDGER_ROLES = balances.AccountRoles(
    sales="2", purchases="5", debtors="50", creditors="20", cash="2001",
    dues=["2002", "2003"], output_tax=["2004", "2005"], input_tax=["5001"],
)


class Book:
    """Frames of the two derived ledgers, prepared once per session and table folder."""

    _open: dict[tuple[str, str], Book] = {}

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    @property
    def tag(self) -> str:
        return self.sf.strip("/").replace("/", "-")

    @classmethod
    def of(cls, spark: SparkSession, sf: str) -> Book:
        return cls._open.setdefault((spark.sparkContext.applicationId, sf), cls(spark, sf))

    @cached_property
    def lines(self) -> DataFrame:
        return stage(fixtures.both_lines(self.spark, self.sf), wide=True)

    @cached_property
    def frames(self) -> LedgerFrames:
        return LedgerFrames(self.lines, overrides=threshold_frame(self.spark, fixtures.LEDGER_THRESHOLDS))

    @cached_property
    def hits(self) -> DataFrame:
        return stage(all_hits(self.frames, use_model=False))

    @cached_property
    def marks(self) -> DataFrame:
        """Hits without reasons and evidence, for those who count or rank; the whole ones, if they are there."""
        return self.hits if "hits" in vars(self) else stage(all_hits(self.frames, use_model=False, detail=False))

    @cached_property
    def model_marks(self) -> DataFrame:
        return stage(all_hits(self.frames, use_model=True, detail=False))

    @cached_property
    def found(self) -> DataFrame:
        return stage(fusion.findings(self.marks, self.frames.context(*EVERYTHING)), wide=True)

    @cached_property
    def queue(self) -> DataFrame:
        return stage(fusion.queue(self.found))

    @cached_property
    def signalled(self) -> DataFrame:
        # Hits first, so that the findings come from them.
        hits = self.hits
        return stage(fusion.with_signals(self.found, hits))

    @cached_property
    def truth(self) -> DataFrame:
        return stage(fixtures.both_truth(self.spark, self.sf))

    @cached_property
    def trail(self) -> DataFrame:
        return stage(decision_trail(self.found))

    def daybook(self, ledger: str) -> DataFrame:
        """The day book of one ledger, all text, with the row each line came from."""
        return export.daybook(self.lines.where(F.col(LEDGER) == ledger), keep=["source_row"])


def query(name: str):
    def add(fn: Callable[[Book], DataFrame]):
        QUERIES[name] = lambda spark, sf: fn(Book.of(spark, sf))
        return fn

    return add


def joined(column: str, sep: str = "|") -> Column:
    return F.array_join(column, sep).alias(column)


def day(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def decision_trail(found: DataFrame) -> DataFrame:
    """Decisions on findings, all of one ledger and two in three of the other; a later second one for every seventh."""
    k = F.substring("voucher_id", 2, 9).cast("bigint")
    rows = found.where((F.col(LEDGER) == "EVT") | (k % 3 != 0)).select(F.col(LEDGER).alias("engagement_id"), "voucher_id", k.alias("k"))
    turns = F.explode(F.when(F.col("k") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    both = rows.withColumn("turn", turns)
    pick = (F.col("k") + F.col("turn")) % 4
    action = F.element_at(F.array(*map(F.lit, validate.ACTIONS)), (pick + 1).cast("int"))
    made = both.select(
        "engagement_id", "voucher_id",
        (F.col("k") * 2 + F.col("turn") + 1).alias("sequence"),
        action.alias("action"),
        F.concat(F.lit("R"), (F.col("k") % 3).cast("string")).alias("reviewer"),
        F.when(action == "reject", "checked to the invoice").alias("note"),
        F.when(action == "adjust", "low").alias("adjusted_band"),
        (F.lit("2024-06-01 09:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("k") * 2 + F.col("turn")).cast("int"))).alias("decided_at"),
    )
    return made


# --- sources and sinks --------------------------------------------------------

def dropped_daybook(b: Book, ledger: str = "ORD") -> str:
    """The day book written as CSV files into the shared folder."""
    path = f"{shared_dir(b.spark)}/daybook-{b.tag}-{ledger}"
    export.daybook(b.lines.where(F.col(LEDGER) == ledger)).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(path)
    return path


@query("read_csv_text")
def _(b):
    rows = files.read_csv(b.spark, dropped_daybook(b) + "/*.csv")
    return rows.select(
        F.col("Voucher No").alias("voucher_no"), F.col("Date").alias("date"), F.col("Ledger").alias("ledger"),
        F.col("Debit").alias("debit"), F.col("Credit").alias("credit"), F.col("Doc Ref").alias("doc_ref"),
        F.col("Approved By").alias("approved_by"),
    )


@query("csv_encoding_sniff")
def _(b):
    return files.file_encodings(b.spark, dropped_daybook(b) + "/*.csv").select("encoding", "size_bytes")


@query("read_parquet_ledger")
def _(b):
    rows = files.read_parquet(b.spark, f"{b.sf}/lineitem.parquet")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("paise")
    )


@query("intake_guards")
def _(b):
    return files.intake_guards(b.spark.read.parquet(f"{b.sf}/lineitem.parquet"), max_rows=50_000)


def sap_extract(b: Book) -> DataFrame:
    """Line items in the shape of an SAP extract."""
    o, i = b.spark.read.parquet(f"{b.sf}/orders.parquet"), b.spark.read.parquet(f"{b.sf}/lineitem.parquet")
    kinds = F.array(*map(F.lit, ["DR", "KR", "SA", "DZ", "KZ", "XX"]))
    groups = F.array(*map(F.lit, ["Asset", "revenue", "EXPENSE", "other"]))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    null = lambda cond, e: F.when(cond, e)
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(
        k.alias("document_id"), n.alias("line_number"), (F.col("l_suppkey") % 3).cast("int").alias("company_code"),
        F.col("o_orderdate").alias("document_date"), F.col("l_shipdate").alias("posting_date"),
        F.element_at(kinds, (k % 6 + 1).cast("int")).alias("document_type"),
        (F.col("l_suppkey") % 25 + 5000).cast("int").alias("gl_account"),
        null(n % 4 != 0, F.concat(F.lit("GL "), F.col("l_suppkey"))).alias("account_description"),
        F.element_at(groups, (F.col("l_partkey") % 4 + 1).cast("int")).alias("financial_statement_category"),
        null(n % 2 == 0, F.col("l_extendedprice")).alias("debit_amount"),
        null(n % 2 == 1, F.col("l_extendedprice")).alias("credit_amount"),
        null(k % 5 != 0, F.lit("INR")).alias("currency"),
        null(k % 7 != 0, F.concat(F.lit("U"), k % 9)).alias("created_by"),
        null(k % 3 != 0, F.concat(F.lit("R"), k)).alias("reference"),
        null(n % 3 == 0, F.concat(F.lit("line "), n)).alias("line_text"),
        null(k % 2 == 0, F.concat(F.lit("head "), k)).alias("header_text"),
        F.lit(None).cast("string").alias("cost_center"),
        (k % 4 == 0).alias("is_manual"), null(k % 10 != 1, k % 11 == 0).alias("is_post_close"),
        (F.col("l_returnflag") == "R").alias("is_fraud"), F.lit(False).alias("is_anomaly"),
        F.lit("x").alias("fraud_type"), F.lit("y").alias("anomaly_type"),
    )


@query("adapt_sap_corpus")
def _(b):
    out = sap.adapt_sap(sap_extract(b))
    return out.select(
        "ledger_id", "line_id", "fiscal_year", "period", day("voucher_date"), "time_fidelity", "voucher_type",
        "account_code", "account_name", "account_group", "debit_paise", "credit_paise", "currency", "created_by",
        "document_ref", "narration", "is_manual", "is_post_close",
    )


@query("file_fingerprint")
def _(b):
    return files.fingerprints(b.spark, f"{b.sf}/*.parquet").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size_bytes", "sha256"
    )


def source_rows(b: Book) -> DataFrame:
    """Upload records: one per (customer segment, order day), the same content arriving repeatedly."""
    o = b.spark.read.parquet(f"{b.sf}/orders.parquet")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("S"), k).alias("id"), F.concat(F.lit("E"), F.col("o_custkey") % 50).alias("engagement_id"),
        F.concat(F.lit("file"), F.col("o_custkey") % 97, F.lit(".csv")).alias("filename"),
        F.sha2(F.concat(F.lit("content "), F.col("o_custkey") % 97), 256).alias("sha256"),
        F.col("o_orderdate").alias("uploaded_at"), F.concat(F.lit("U"), k % 5).alias("uploaded_by"),
        (k % 1000).alias("rows_read"),
    )


@query("register_source")
def _(b):
    rows = source_rows(b)
    known = rows.where(F.col("uploaded_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    fresh = rows.where(F.col("uploaded_at") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return files.register_sources(known, fresh).select("id", "engagement_id", "sha256", "filename", "uploaded_by")


@query("source_preview")
def _(b):
    page = files.preview(b.daybook("ORD"), offset=5_000, limit=100_000)
    return page.select("source_row", F.col("Voucher No").alias("voucher_no"), F.col("Ledger").alias("ledger"), F.col("Debit").alias("debit"))


def tombstones(b: Book) -> DataFrame:
    rows = source_rows(b)
    gone = F.substring("id", 2, 12).cast("bigint") % 3 != 0
    return rows.where(gone).select(
        "id", (F.col("uploaded_at") + F.make_dt_interval(F.lit(10))).alias("deleted_at"), F.lit("admin").alias("deleted_by")
    )


@query("source_liveness")
def _(b):
    live = files.live_sources(source_rows(b), tombstones(b))
    gone = files.unreferenced_hashes(live).withColumn("unreferenced", F.lit(1))
    return live.join(gone, "sha256", "left").groupBy("engagement_id").agg(
        F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("deleted"),
        F.count("unreferenced").alias("unreferenced"),
    )


@query("ingest_stream")
def _(b):
    from ledgerloom.streaming.ingest import ingest_stream

    root = f"{shared_dir(b.spark)}/stream-{b.spark.sparkContext.applicationId}-{b.tag}"
    drop, out = f"{root}/drop", f"{root}/out"
    # Each ledger is a folder of as many part files as Spark writes.
    book = export.daybook(b.lines, [F.col(LEDGER).alias("folder")])
    book.write.mode("overwrite").partitionBy("folder").option("header", True).option("escape", '"').csv(drop)
    ingest_stream(b.spark, drop + "/*/*.csv", out, fixtures.EVENT_THRESHOLDS, use_model=False, by="folder").awaitTermination()
    lines, queue = b.spark.read.parquet(f"{out}/lines"), b.spark.read.parquet(f"{out}/queue")
    stray = queue.join(lines, KEY, "left_anti").groupBy(LEDGER).agg(F.count(F.lit(1)).alias("stray"))
    kept = lines.groupBy(LEDGER).agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("voucher_id").alias("vouchers"), F.countDistinct("voucher_id", "line_id").alias("line_ids"),
        F.sum("debit_paise").alias("debit_paise"), F.sum("credit_paise").alias("credit_paise"),
    )
    return kept.join(stray, LEDGER, "left").withColumn("stray", F.coalesce("stray", F.lit(0))).withColumn(
        LEDGER, F.replace(LEDGER, F.lit("folder="), F.lit(""))
    )


@query("write_ledger")
def _(b):
    path = f"{shared_dir(b.spark)}/ledger-{b.tag}"
    files.write_ledger(b.lines, path)
    back = b.spark.read.parquet(path).where(F.col(LEDGER) == "ORD")
    return back.groupBy(LEDGER).agg(F.count(F.lit(1)).alias("n"), F.sum("debit_paise").alias("debit_paise"))


@query("report_frame")
def _(b):
    return review.report_frame(b.signalled, b.trail, b.lines)


@query("report_csv_safe")
def _(b):
    d = b.spark.read.parquet(f"{b.sf}/documents.parquet")
    lead = F.element_at(F.array(*map(F.lit, ["", "=", "+", " -", "@", "\t", "\r", "a", "'"])), (F.col("doc_id") % 9 + 1).cast("int"))
    cells = d.select("doc_id", F.concat(lead, "text").alias("cell"))
    safe = export.spreadsheet_safe(cells)
    return safe.select("doc_id", F.md5("cell").alias("cell_md5"), F.length("cell").alias("cell_length"))


@query("daybook_export")
def _(b):
    book = b.daybook("EVT")
    return book.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in book.columns if c != "source_row"])


@query("report_tally")
def _(b):
    return review.queue_counts(review.findings_decisions(b.found, b.trail))


# --- projection, conformance, filters --------------------------------------------

@query("header_normalise")
def _(b):
    p = b.spark.read.parquet(f"{b.sf}/part.parquet")
    return p.select("p_partkey", text.normalised_header(F.concat("p_name", F.lit("  (No.)_"), "p_type", F.lit("--X"))).alias("header"))


DAYBOOK_HEADERS = ["Voucher No", "Date", "Posted", "Vch Type", "Ledger", "Debit", "Credit", "Narration", "Doc Ref", "Entered By", "Approved By"]


@query("infer_mapping")
def _(b):
    headers = [c for c in b.daybook("EVT").columns if c != "source_row"]
    rows = b.daybook("EVT").select(*[F.count_if(F.col(f"`{h}`") != "").alias(h) for h in headers])
    filled = rows.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, headers)), F.array(*[F.col(f"`{h}`") for h in headers]))).alias("header", "filled"))
    table = mapping.mapping_table(b.spark, headers, mapping.map_headers(headers))
    return table.join(filled, "header").select("position", "header", "field", "state", "filled")


@query("mapping_missing")
def _(b):
    items = b.spark.read.parquet(f"{b.sf}/lineitem.parquet")
    needs = mapping.missing_table(b.spark, mapping.map_headers(items.columns))
    # One count of the file, then one row per requirement.
    counted = items.agg(F.count(F.lit(1)).alias("rows"))
    each = counted.select("rows", F.explode(F.array(*[F.lit(r["requirement"]) for r in needs.collect()])).alias("requirement"))
    return needs.join(each, "requirement")


def text_lines(b: Book) -> DataFrame:
    """Canonical columns of both ledgers as text, the way a file brings them."""
    null_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return b.lines.select(*[null_text(c).alias(c) if c != "source_row" else F.col(c) for c in b.lines.columns])


@query("canonical_passthrough")
def _(b):
    lines, _report, _d = conform.conform(text_lines(b))
    return lines.select("line_id", "ledger_id", "debit_paise", "credit_paise", "is_manual", "approved_by", "document_ref", day("voucher_date"))


@query("coerce_types")
def _(b):
    e = fixtures.event_vouchers(b.spark, b.sf)
    k = F.col("k")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    raw = e.select(
        "voucher_id", pick(["7", " 8 ", "x", "", "12.9"]).alias("line_number"), pick(["3", "bad"]).alias("period"),
        F.col("amount").cast("string").alias("debit_paise"), pick(["", "nope", "5"]).alias("credit_paise"),
        F.when(k % 4 == 0, "not a date").otherwise(F.col("voucher_date").cast("string")).alias("voucher_date"),
        pick(["TRUE", " yes", "t", "0", "no", "Y", "1"]).alias("is_manual"), pick(["false", "true"]).alias("is_post_close"),
        pick(["", "  ", "A1"]).alias("approved_by"), pick([" D1 ", " "]).alias("document_ref"),
        F.col("narration"), F.lit("").alias("cost_centre"),
        F.when(k % 5 == 0, "").otherwise(F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss")).alias("posted_at"),
    )
    out = conform.coerce_types(raw)
    return out.select(
        "voucher_id", "line_number", "period", "debit_paise", "credit_paise", day("voucher_date"),
        F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"), "is_manual", "is_post_close",
        "approved_by", "document_ref", "narration", "cost_centre",
    )


@query("posting_date_fallback")
def _(b):
    raw = b.daybook("EVT").select(
        "source_row", F.col("Voucher No").alias("Voucher"), F.col("Posted").alias("Posting Date"), "Ledger", "Debit", "Credit"
    )
    lines, _r, d = conform.conform(raw, ledger_id="EVT")
    return lines.select("line_id", day("voucher_date"), "posted_at", "time_fidelity", "debit_paise")


@query("usable_check")
def _(b):
    tables = ["orders", "lineitem", "events", "customer"]
    rows = []
    for t in tables:
        found = mapping.map_headers(b.spark.read.parquet(f"{b.sf}/{t}.parquet").columns)
        try:
            mapping.check_usable(found)
            rows.append((t, ""))
        except mapping.LedgerError as problem:
            rows.append((t, str(problem)))
    counts = None
    for t in tables:
        one = b.spark.read.parquet(f"{b.sf}/{t}.parquet").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(t))
        counts = one if counts is None else counts.unionByName(one)
    return b.spark.createDataFrame(rows, "table string, problem string").join(counts, "table")


@query("carry_text_defaults")
def _(b):
    raw = b.daybook("ORD").select("source_row", "Voucher No", "Date", "Ledger", "Debit", "Credit", "Narration", "Approved By")
    lines, _r, _d = conform.conform(raw, ledger_id="ORD")
    return lines.select("line_id", "created_by", "entity_id", "currency", "narration", "approved_by", "document_ref", "cost_centre")


@query("amounts_to_paise")
def _(b):
    v = fixtures.event_vouchers(b.spark, b.sf)
    k, amount = F.col("k"), F.col("amount")
    rupees = F.concat(F.when(k % 3 == 0, "₹ ").otherwise(""), money.format_inr(amount).substr(2, 30))
    signed = F.when(k % 4 == 1, F.concat(F.lit("("), rupees, F.lit(")"))).when(k % 4 == 2, F.concat(F.lit("-"), rupees)).when(
        k % 11 == 0, "n/a").otherwise(rupees)
    src = v.select("voucher_id", signed.alias("amount"))
    both = conform.amounts(["amount"], conform.Disclosure())
    return src.select("voucher_id", *[e.alias(c) for c, e in both.items()])


def date_texts(b: Book) -> DataFrame:
    """Every event's day written the way some ledger would write it."""
    v = fixtures.event_vouchers(b.spark, b.sf)
    d = F.col("voucher_date")
    shapes = [
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd-MM-yyyy"), F.date_format(d, "d/M/yyyy"),
        F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy/MM/dd"), F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"),
        F.date_format(d, "d MMM yyyy"), F.concat(F.date_format(d, "dd-MM-yyyy"), F.lit(" 14:05")), F.lit("not a date"), F.lit(""),
    ]
    return v.select("voucher_id", F.element_at(F.array(*shapes), (F.col("k") % len(shapes) + 1).cast("int")).alias("t"))


@query("parse_dates")
def _(b):
    return date_texts(b).select("voucher_id", F.date_format(dates.parse_ledger_date(F.col("t")), "yyyy-MM-dd HH:mm").alias("parsed"))


@query("time_fidelity_at_intake")
def _(b):
    out = None
    for ledger, cols in [("EVT", ["Posted"]), ("ORD", ["Posted"]), ("EVT-none", [])]:
        raw = b.daybook(ledger[:3]).select("source_row", "Voucher No", "Date", "Ledger", "Debit", "Credit", *cols)
        one = conform.conform(raw, ledger_id=ledger)[0].groupBy(LEDGER, "time_fidelity").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("identity_defaults")
def _(b):
    raw = b.daybook("ORD").select("source_row", "Voucher No", "Date", F.when(F.col("source_row") % 5 != 0, F.col("Ledger")).alias("Ledger"), "Debit", "Credit")
    return conform.conform(raw, ledger_id="ORD")[0].groupBy("account_code").agg(F.count(F.lit(1)).alias("n"), F.sum("debit_paise").alias("debit_paise"))


@query("classify_voucher_type")
def _(b):
    p = b.spark.read.parquet(f"{b.sf}/part.parquet")
    words = ["Sales", "Cash Sale", "PURC order", "Purchase Debit Note", "receipt", "Payment", "Contra", "JRNL", "debit note", "Credit Note", "Opening", "misc", None]
    t = F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    return p.select("p_partkey", text.voucher_type(F.concat_ws(" ", t, "p_type")).alias("voucher_type"))


@query("classify_account_group")
def _(b):
    p = b.spark.read.parquet(f"{b.sf}/part.parquet")
    words = ["Current Assets", "LIABILITY", "equity share", "Income", "Expenses", "Revenue from ops", "misc", None]
    t = F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    return p.select("p_partkey", text.account_group(t).alias("account_group"))


@query("flag_columns")
def _(b):
    p = b.spark.read.parquet(f"{b.sf}/part.parquet")
    words = ["TRUE", " yes ", "1", "Y", "t", "false", "", "0", None]
    t = F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    return p.select("p_partkey", text.truthy(t).alias("flag"))


def broken_daybook(b: Book) -> DataFrame:
    """The day book with blank rows, missing vouchers and unreadable dates put in by arithmetic."""
    d = b.daybook("ORD")
    n = F.col("source_row")
    cells = []
    for c in [c for c in d.columns if c != "source_row"]:
        value = F.col(f"`{c}`")
        if c == "Voucher No":
            value = F.when(n % 13 == 0, " ").otherwise(value)
        if c == "Date":
            value = F.when(n % 17 == 0, "31 sometime").when(n % 19 == 0, "").otherwise(value)
        cells.append(F.when(n % 11 != 0, value).alias(c))
    return d.select("source_row", *cells)


@query("drop_unusable_rows")
def _(b):
    lines, report, _d = conform.conform(broken_daybook(b), ledger_id="ORD")
    return report.select("rows_in", "rows_out", "unreadable_dates")


@query("intake_report")
def _(b):
    raw = broken_daybook(b).drop("Approved By", "Posted").withColumn("Mystery", F.lit("x"))
    return conform.conform(raw, ledger_id="ORD")[1]


def dented_lines(b: Book) -> DataFrame:
    """Event lines of every amount, with rule breaks put in by arithmetic on the voucher number."""
    lines = fixtures.event_lines(b.spark, b.sf, positive_only=False)
    k = F.substring("voucher_id", 2, 9).cast("bigint")
    return lines.withColumns({
        "currency": F.when(k % 101 == 1, "inr").otherwise(F.col("currency")),
        "period": F.when(k % 103 == 2, F.lit(14)).when(k % 107 == 3, F.lit(1)).otherwise(F.col("period")).cast("int"),
        "credit_paise": F.when(k % 109 == 4, F.col("credit_paise") + 5).otherwise(F.col("credit_paise")),
        "account_name": F.when(k % 113 == 5, "").otherwise(F.col("account_name")),
        "fiscal_year": F.when(k % 127 == 6, "2024").otherwise(F.col("fiscal_year")),
        "voucher_type": F.when(k % 131 == 7, "memo").otherwise(F.col("voucher_type")),
    })


@query("validate_lines")
def _(b):
    checked = validate.check_lines(dented_lines(b))
    return checked.select("line_id", F.array_join("problems", "; ").alias("problems"))


@query("money_guard")
def _(b):
    e = b.spark.read.parquet(f"{b.sf}/events.parquet")
    k = F.col("event_id")
    base = F.col("value").cast("decimal(20,2)").cast("string")
    t = F.when(k % 10 == 1, F.concat(base, F.lit("5"))).when(k % 10 == 2, "NaN").when(k % 10 == 3, "123456789012345.00").otherwise(base)
    return e.select("event_id", money.money_problem(t).alias("problem"), money.exact_rupees_to_paise(t).alias("paise"))


@query("decision_rules")
def _(b):
    c = b.spark.read.parquet(f"{b.sf}/conversations.parquet")
    k = F.col("conv_id") * 7 + F.col("turn")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    rows = c.select(
        "conv_id", "turn", pick(["accept", "reject", "investigate", "adjust", "close"]).alias("action"),
        F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, " two  words ").alias("note"),
        F.when(k % 2 == 0, "low").alias("adjusted_band"), F.when(k % 17 != 0, "R1").otherwise("").alias("reviewer"),
    )
    return review.check_decisions(rows).select("conv_id", "turn", "problem")


def queue_rows(b: Book) -> DataFrame:
    now = review.findings_decisions(b.found, b.trail)
    return now.withColumn("concerns", fusion.headline_concerns(F.col("contributions")))


@query("queue_filter")
def _(b):
    rows = review.queue_filter(queue_rows(b), band="high", concern="missing_evidence", undocumented=True, state="open")
    return rows.select(*KEY, "priority", "status", joined("concerns"))


@query("queue_search")
def _(b):
    facts = b.frames.vouchers.select(*KEY, "narration", "created_by", "account_names")
    rows = b.found.select(*KEY, "amount_paise").join(facts, KEY)
    return review.queue_search(rows, "Expense 5003").select(*KEY, "amount_paise")


@query("lines_for_voucher")
def _(b):
    high = b.found.where(F.col("band") == "high")
    return review.lines_for(b.lines, high).select(*KEY, "source_row", "line_id", "account_code", "debit_paise", "credit_paise")


@query("owner_scope")
def _(b):
    rows = engagements(b)
    return review.owner_scope(rows, "U3").select("id", "owner_id")


# --- joins ------------------------------------------------------------------

@query("account_pairs")
def _(b):
    return vouchers.account_pairs(b.frames.vouchers)


@query("freq_lookup")
def _(b):
    c = b.frames.context("pairs", "preparer")
    return c.select(*KEY, F.col("rarest.times_seen").alias("rarest_pair"), F.round("familiarity", 6).alias("familiarity"))


@query("findings_decisions")
def _(b):
    return review.findings_decisions(b.found, b.trail).select(*KEY, "status", "reviewer", "note", "sequence")


@query("findings_assemble")
def _(b):
    n = b.lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("lines_behind"))
    return b.signalled.join(n, KEY).select(
        *KEY, F.array_join(F.array_sort(F.col("signals")["kind"]), "|").alias("kinds"), "completeness", "amount_paise",
        day("voucher_date"), "lines_behind",
    )


@query("similar_entries")
def _(b):
    out = similar.similar_entries(b.frames.vouchers, b.found)
    return out.select(*KEY, "similar_rank", "similar_id", "basis", F.round("distance", 6).alias("distance"), "days")


@query("account_names")
def _(b):
    return review.account_names(b.lines)


@query("approach_only")
def _(b):
    return evaluation.approach_only(evaluation.approach_sets(b.hits), "statistics", "rules")


@query("truth_join")
def _(b):
    return evaluation.decoys_queued(b.found, b.truth)


def engagements(b: Book) -> DataFrame:
    c = b.spark.read.parquet(f"{b.sf}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("E"), k).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("U"), k % 7).alias("owner_id"),
        (F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 2500).cast("int"))).alias("opened_at"),
    )


@query("engagement_summary")
def _(b):
    o = b.spark.read.parquet(f"{b.sf}/orders.parquet")
    e = F.concat(F.lit("E"), F.col("o_custkey")).alias("engagement_id")
    stats = o.groupBy(e).agg(F.count(F.lit(1)).alias("flagged"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("high"))
    trail = o.select(e, F.concat(F.lit("V"), F.col("o_orderkey") % 40).alias("voucher_id"), F.col("o_orderdate").alias("decided_at"))
    srcs = o.select(
        e, F.concat(F.lit("f"), "o_orderkey", F.lit(".csv")).alias("filename"), F.col("o_orderdate").alias("uploaded_at"),
        (F.col("o_orderkey") % 3 != 0).alias("live"),
    )
    out = review.engagement_summary(engagements(b), stats, trail, srcs)
    return out.select("id", "flagged", "high", "reviewed", "latest_file", day("last_activity"))


@query("same_book")
def _(b):
    digests = digest.ledger_digest(b.lines)
    opened = digest.ledger_digest(b.lines.withColumn("narration", F.when((F.col(LEDGER) == "ORD") & (F.col("line_number") == 1), F.lit("edited")).otherwise(F.col("narration"))))
    return review.same_book(digests, opened.withColumnRenamed("digest", "content_sha256"))


# --- aggregations ---------------------------------------------------------------

@query("voucher_view")
def _(b):
    return b.frames.vouchers.select(
        *KEY, "amount_paise", joined("accounts"), joined("debit_accounts"), joined("credit_accounts"), joined("account_names"),
        "document_ref", "evidence_lines", "line_count", "approved_by", "created_by", "is_manual", "is_post_close",
        "voucher_type", "narration", day("voucher_date"), "primary_account",
    )


@query("pair_counts")
def _(b):
    return b.frames.pair_counts.select(*vouchers.PAIR, "times_seen")


@query("preparer_account_counts")
def _(b):
    return b.frames.preparer_counts.select(LEDGER, "created_by", "account_code", "entries")


@query("account_amount_counts")
def _(b):
    return b.frames.account_amounts


@query("time_fidelity")
def _(b):
    return b.frames.times.select(LEDGER, "fidelity", "n_vouchers")


@query("year_end")
def _(b):
    return b.frames.times.select(LEDGER, day("year_end"))


@query("account_profile")
def _(b):
    p = statistics.account_profile(b.frames.vouchers)
    return p.select(LEDGER, "primary_account", "n", *[F.round(c, 2).alias(c) for c in ("median_paise", "low_paise", "high_paise")])


@query("benford_by_account")
def _(b):
    out = statistics.benford(b.frames.vouchers, b.frames.times)
    return out.select(LEDGER, "primary_account", "sample_size", F.round(F.col("observed")[0], 6).alias("ones"), "mad", "conformity")


@query("hits_by_kind")
def _(b):
    return signals.hits_by_kind(b.hits, ledgers=b.frames.times)


@query("hits_by_voucher")
def _(b):
    return signals.hits_by_voucher(b.hits).select(*KEY, F.array_join(F.col("signals")["kind"], "|").alias("kinds"))


@query("flagged_vouchers")
def _(b):
    return signals.flagged_vouchers(b.marks)


@query("unbalanced_vouchers")
def _(b):
    return validate.unbalanced(dented_lines(b))


@query("balanced_vouchers")
def _(b):
    return validate.balanced_lines(dented_lines(b)).select("line_id", "voucher_id", "line_number")


@query("trial_balance")
def _(b):
    return balances.trial_balance(b.lines)


@query("ledger_ratios")
def _(b):
    return balances.ledger_ratios(balances.trial_balance(b.lines), b.lines, LEDGER_ROLES)


@query("monthly_movement")
def _(b):
    return balances.tax_set_off(balances.monthly_movement(b.lines), LEDGER_ROLES).select(
        LEDGER, day("month"), day("due_month"), "output_paise", "input_paise", "net_due_paise"
    )


@query("ledger_digest")
def _(b):
    return digest.ledger_digest(b.lines)


@query("engagement_open")
def _(b):
    rows = review.engagement_rows(b.lines, digest.ledger_digest(b.lines))
    return rows.select("ledger_id", "entity_id", "fiscal_year", "name", "voucher_count")


@query("queue_counts")
def _(b):
    return review.queue_counts(review.findings_decisions(b.found, b.trail))


@query("concern_counts")
def _(b):
    return review.concern_counts(b.found, fusion.headline_concerns(F.col("contributions")))


@query("noisy_or")
def _(b):
    s = fusion.strongest(b.hits)
    return s.select(*KEY, F.round(fusion.noisy_or(fusion.contribution_order(C.SIGNAL_WEIGHTS)), 6).alias("base"))


# --- windows -----------------------------------------------------------------------

@query("duplicate_entry")
def _(b):
    return signals.duplicate_pairs(b.frames).select(
        *KEY, "amount_paise", "days_apart", F.col("earlier.voucher_id").alias("earlier_voucher_id"),
        F.col("earlier.voucher_date").cast("string").alias("earlier_date"),
    )


@query("line_numbers")
def _(b):
    return vouchers.number_lines(b.lines.withColumn("source_row", -F.col("source_row"))).select(
        LEDGER, "line_id", "line_number", "account_code", "debit_paise", "source_row"
    )


@query("decision_current")
def _(b):
    return review.current_decisions(b.trail).select("engagement_id", "voucher_id", "sequence", "action")


@query("decision_trail")
def _(b):
    first = b.trail.where(F.col("sequence") % 2 == 1)
    later = b.trail.where(F.col("sequence") % 2 == 0).drop("sequence")
    grown = first.unionByName(review.append_decisions(first, later).select(*first.columns))
    return grown.select("engagement_id", "voucher_id", "sequence", "action")


@query("account_owner")
def _(b):
    return b.frames.account_owner.select(LEDGER, "account_code", "total", "owner", F.round("owner_share", 6).alias("owner_share"))


@query("contribution_order")
def _(b):
    return b.found.select(
        *KEY, F.array_join(fusion.by_strength(F.col("contributions"))["kind"], "|").alias("ordered"),
        fusion.top_concern(F.col("contributions")).alias("top"),
        F.array_join(fusion.headline_concerns(F.col("contributions")), "|").alias("headline"),
    )


@query("similarity_rank")
def _(b):
    ends = b.found.where(F.array_contains("kinds", "amount_outlier"))
    out = similar.similar_entries(b.frames.vouchers.where(F.col("primary_account") != ""), ends)
    return out.select(*KEY, "similar_rank", "similar_id")


@query("top_features")
def _(b):
    from ledgerloom.operators.forest import feature_centres, top_features

    feats = stage(statistics.voucher_features(b.frames))
    return top_features(feats, feature_centres(feats)).select(*KEY, F.array_join(F.col("top")["feature"], "|").alias("top"))


@query("cumulative_hits")
def _(b):
    return evaluation.cumulative_hits(b.queue, evaluation.anomalous(b.truth)).select(*KEY, "rank", "found_so_far")


@query("source_row")
def _(b):
    rows = files.numbered_text(b.spark, dropped_daybook(b, "EVT") + "/*.csv")
    per_file = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_row").alias("numbers"), F.min("source_row").alias("lo"), F.max("source_row").alias("hi")
    )
    return per_file.agg(
        F.sum(F.col("n") - 1).alias("data_rows"), F.sum(F.col("n") - F.col("numbers")).alias("repeated"),
        F.sum(F.col("hi") - F.col("n")).alias("gaps"), F.min("lo").alias("lo"),
    )


# --- sorts, sets ----------------------------------------------------------------------

@query("hits_sorted")
def _(b):
    return signals.sorted_hits(b.hits).select(*KEY, "kind", F.round("strength", 6).alias("strength"))


@query("queue_ranked")
def _(b):
    return b.queue.select(*KEY, "rank", "priority", "band")


@query("queue_top")
def _(b):
    return b.queue.where(F.col("rank") <= 50).select(*KEY, "rank", "priority").orderBy(LEDGER, "rank")


@query("detect_ranked")
def _(b):
    return fusion.by_total_strength(b.hits).select(*KEY, "total", "rank")


@query("queue_unranked")
def _(b):
    return evaluation.unranked(b.found).select(*KEY, "rank")


@query("page")
def _(b):
    return review.page(b.queue, 2).select(*KEY, "rank")


@query("union_hits")
def _(b):
    f = b.frames
    every = signals.run_signals(f, C.RULE_KINDS).unionByName(signals.run_signals(f, C.STATISTIC_KINDS))
    return every.groupBy(LEDGER, "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 4).alias("strength"))


@query("approach_sets")
def _(b):
    sets = evaluation.approach_sets(b.hits)
    return sets.groupBy(LEDGER, "approach").agg(F.count(F.lit(1)).alias("flagged"))


@query("set_intersect")
def _(b):
    return b.found.select(*KEY).intersect(evaluation.innocent(b.truth))


@query("set_except")
def _(b):
    # Anomalies that the high band alone would miss.
    return evaluation.anomalous(b.truth).exceptAll(b.found.where(F.col("band") == "high").select(*KEY))


@query("distinct_sides")
def _(b):
    return vouchers.distinct_sides(b.lines)


@query("drop_signals")
def _(b):
    kept = b.hits.where(~F.col("kind").isin("missing_evidence", "off_hours_posting"))
    out = fusion.findings(kept, b.frames.context(*EVERYTHING))
    return out.select(*KEY, "priority", "band")


# --- signals -----------------------------------------------------------------------------

SIGNAL_FACTS = {
    "sig_duplicate_entry": ("duplicate_entry", ["days_apart", "earlier_voucher_id"]),
    "sig_round_amount": ("round_amount", ["times_seen_on_account", "round_step_paise"]),
    "sig_off_hours": ("off_hours_posting", ["hour", "posted_at"]),
    "sig_weekend": ("weekend_posting", ["basis", "date"]),
    "sig_period_end": ("period_end_concentration", ["days_before_close", "year_end"]),
    "sig_rare_pair": ("rare_account_pair", ["debit_account", "credit_account", "times_seen", "rare_below"]),
    "sig_threshold_adjacent": ("threshold_adjacent", ["shortfall_paise", "approval_limit_paise"]),
    "sig_missing_evidence": ("missing_evidence", ["amount_paise", "lines"]),
    "sig_unusual_preparer": ("unusual_preparer_account", ["account_code", "regular_owner", "entries_by_this_preparer"]),
    "sig_post_close": ("post_close_entry", ["lag_days", "source_flag"]),
    "sig_amount_outlier": ("amount_outlier", ["account_code", "account_median_paise", "entries_compared"]),
}


def signal_query(kind: str, facts: list[str]):
    def run(b: Book) -> DataFrame:
        hits = signals.run_signals(b.frames, [kind])
        return hits.select(
            *KEY, F.round("strength", 6).alias("strength"), *[F.get_json_object("evidence", f"$.{f}").alias(f) for f in facts]
        )

    return run


for _name, (_kind, _facts) in SIGNAL_FACTS.items():
    query(_name)(signal_query(_kind, _facts))


# --- statistics and model -------------------------------------------------------------------

@query("amount_deviation")
def _(b):
    return statistics.amount_deviation(b.frames.vouchers).select(*KEY, "primary_account", F.round("deviation", 6).alias("deviation"))


@query("voucher_features")
def _(b):
    return statistics.voucher_features(b.frames).select(*KEY, *[F.round(f, 6).alias(f) for f in statistics.FEATURES])


@query("first_digit")
def _(b):
    a = F.col("amount_paise")
    return b.frames.vouchers.select(*KEY, statistics.first_digit(a).alias("first_digit"), statistics.trailing_zeros(a).alias("trailing_zeros"))


@query("trailing_zeros")
def _(b):
    zeros = statistics.trailing_zeros(F.col("debit_paise") + F.col("credit_paise"))
    return b.lines.groupBy(LEDGER, zeros.alias("trailing_zeros")).agg(F.count(F.lit(1)).alias("n"))


@query("pair_rarity")
def _(b):
    c = b.frames.context("pairs")
    rarity = -F.log10(F.coalesce(F.col("rarest.times_seen"), F.lit(1)) / F.col("n_vouchers"))
    return c.select(*KEY, F.round(rarity, 6).alias("rarity"))


@query("preparer_familiarity")
def _(b):
    return b.frames.context("preparer").select(*KEY, F.round(F.coalesce("familiarity", F.lit(1.0)), 6).alias("familiarity"))


@query("iforest_score")
def _(b):
    from ledgerloom.operators.forest import ml_scores

    return ml_scores(b.frames).select(*KEY, F.round("score", 6).alias("score"))


@query("sig_ml_anomaly")
def _(b):
    return signals.run_signals(b.frames, ["ml_anomaly"])


@query("analysis_side_by_side")
def _(b):
    sets = evaluation.approach_sets(b.model_marks)
    return evaluation.side_by_side(sets, b.frames.times, statistics.benford(b.frames.vouchers, b.frames.times))


# --- evidence, fusion, findings ----------------------------------------------------------------

@query("evidence_score")
def _(b):
    return evidence.evidence_scores(b.frames.context()).drop("missing")


@query("evidence_missing")
def _(b):
    e = evidence.evidence_scores(b.frames.context())
    return e.select(*KEY, joined("missing"), evidence.evidence_summary(F.col("missing")).alias("summary"))


@query("evidence_state")
def _(b):
    e = evidence.evidence_states(b.frames.context(), ["narration"])
    return e.select(*KEY, F.array_join(F.col("items")["state"], "|").alias("states"), "present_items", "expected_items")


@query("corroboration")
def _(b):
    more = b.hits.select(*KEY, "kind", "strength").unionByName(
        b.frames.vouchers.select(*KEY, F.lit("ml_anomaly").alias("kind"), F.lit(1.0).alias("strength"))
    )
    fused = fusion.fuse(fusion.strongest(more), completeness=None)
    return fused.select(*KEY, F.round("priority", 6).alias("priority"))


@query("fuse_priority")
def _(b):
    return b.found.select(*KEY, "priority")


@query("contributions")
def _(b):
    return b.found.select(*KEY, F.explode("contributions").alias("x")).select(
        *KEY, F.col("x.kind").alias("kind"), F.round("x.contribution", 4).alias("contribution")
    )


@query("risk_band")
def _(b):
    return b.found.groupBy(LEDGER, "band").agg(F.count(F.lit(1)).alias("findings"))


@query("build_findings")
def _(b):
    q = build_findings(LedgerFrames(b.lines, overrides=threshold_frame(b.spark, fixtures.LEDGER_THRESHOLDS)), use_model=False)
    return q.select(*KEY, "rank", "priority", "band", "amount_paise", day("voucher_date"), joined("kinds"), "completeness", joined("missing"))


@query("weights_table")
def _(b):
    n = b.hits.groupBy("kind").agg(F.count(F.lit(1)).alias("hits"))
    return fusion.weights_table(b.spark).join(n, "kind", "left").na.fill(0, ["hits"])


@query("structured_facts")
def _(b):
    return explain.structured_facts(b.signalled, explain.source_line_ids(b.lines, b.found)).select(*KEY, "facts")


# --- explanation as data ---------------------------------------------------------------------------

@query("reason_text")
def _(b):
    return b.hits.select(*KEY, "kind", "reason")


@query("explain_deterministic")
def _(b):
    return explain.explanation(b.signalled, explain.source_line_ids(b.lines, b.found)).select(*KEY, "explanation")


@query("signal_cards")
def _(b):
    cards = stage(explain.signal_cards(b.signalled))
    return cards.join(explain.card_summary(cards), KEY).select(*KEY, "position", "kind", "title", "level", "minor", F.to_json("working").alias("working"), "summary")


def written_texts(b: Book) -> DataFrame:
    """Two texts per finding: the deterministic one, and one altered by voucher arithmetic."""
    found = b.signalled
    ids = explain.source_line_ids(b.lines, found)
    facts = explain.structured_facts(explain.explanation(found, ids))
    k = F.substring("voucher_id", 2, 9).cast("bigint")
    plain = F.array_join(F.col("signals")["reason"], " ")
    worse = (
        F.when(k % 5 == 0, F.concat(plain, F.lit(" A total of 987,654 was moved.")))
        .when(k % 5 == 1, F.concat(plain, F.lit(" This certainly proves fraud.")))
        .when(k % 5 == 2, F.lit(" "))
        .when(k % 5 == 3, F.lit("Something happened here."))
        .otherwise(plain)
    )
    both = F.explode(F.array(
        F.struct(F.lit("deterministic").alias("variant"), F.col("deterministic").alias("text"), F.lit(0.0).alias("latency_seconds")),
        F.struct(F.lit("generated").alias("variant"), worse.alias("text"), ((k % 40) / 10.0 + 4).alias("latency_seconds")),
    ))
    # The numbers that the facts allow are worked out once per finding, below the step that lays out its texts.
    allowed = textaudit.supported_numbers(F.col("facts")).alias("allowed")
    own = [*KEY, "signals", "facts", "allowed", "deterministic"]
    known = facts.select(*KEY, "signals", "facts", allowed, F.col("explanation").alias("deterministic"))
    return known.select(*own, both.alias("v")).select(*own, "v.*")


TEXT_KEYS = [*KEY, "variant", "latency_seconds", "deterministic"]


@query("number_grounding")
def _(b):
    rows = written_texts(b)
    return rows.select(*KEY, "variant", F.array_join(textaudit.unsupported_numbers(F.col("text"), F.col("facts"), F.col("allowed")), "|").alias("unsupported"))


def phrase_texts(b: Book) -> DataFrame:
    e = b.spark.read.parquet(f"{b.sf}/events.parquet")
    phrases = [*textaudit.FORBIDDEN_PHRASES, "approval", "provenance", "reviewed", "Clearly Shows", "defraud"]
    p = F.element_at(F.array(*map(F.lit, phrases)), (F.col("event_id") % len(phrases) + 1).cast("int"))
    made = e.select(F.concat(F.lit("e"), "event_id").alias("id"), F.concat(F.lit("The entry "), p, F.lit(", in part: "), "event_type").alias("text"))
    d = b.spark.read.parquet(f"{b.sf}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return made.unionByName(d)


@query("forbidden_language")
def _(b):
    t = F.col("text")
    words = textaudit.word_count(F.translate(t, "\t\n\r\u000b\u000c", "     "))
    return phrase_texts(b).select("id", F.array_join(textaudit.forbidden_found(t), "|").alias("phrases"), words.alias("words"), (words > textaudit.MAX_WORDS).alias("too_long"))


@query("omitted_concerns")
def _(b):
    e = fixtures.event_vouchers(b.spark, b.sf)
    k = F.col("k")
    kinds = F.array(*map(F.lit, C.ALL_KINDS))
    at = lambda i: F.element_at(kinds, ((k + i) % len(C.ALL_KINDS) + 1).cast("int"))
    cues = F.array(*[F.lit(explain.CUES[kind][0]) for kind in C.ALL_KINDS])
    rows = e.select(
        "voucher_id",
        F.concat(F.lit("Noted: "), F.element_at(cues, (k % len(C.ALL_KINDS) + 1).cast("int")), F.lit(".")).alias("text"),
        F.array(
            F.struct(at(0).alias("kind"), F.lit(0.5).alias("contribution")),
            F.struct(at(5).alias("kind"), ((k % 20) / 100.0).alias("contribution")),
        ).alias("signals"),
    )
    return textaudit.omitted_concerns(rows, ["voucher_id"]).select("voucher_id", joined("omitted"))


@query("text_quality")
def _(b):
    audited = textaudit.audit(written_texts(b), TEXT_KEYS)
    quality = textaudit.text_quality(audited, [*KEY, "variant", "latency_seconds"])
    # No model wrote the deterministic text, however well it passes.
    modelled = F.col("passed") & (F.col("variant") != "deterministic")
    return textaudit.quality_by_variant(quality.withColumn("source", F.when(modelled, "model").otherwise("deterministic")))


@query("fallback_choice")
def _(b):
    audited = textaudit.audit(written_texts(b).where(F.col("variant") == "generated"), TEXT_KEYS)
    return textaudit.choose_text(audited, [*KEY, "variant"]).select(*KEY, "source", "fallback_reason")


# --- evaluation ---------------------------------------------------------------------------------------

@query("score_sets")
def _(b):
    s = evaluation.score_sets(b.found, evaluation.anomalous(b.truth))
    return s.select(LEDGER, "predicted", "actual", "hits", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("false_positive_rate")
def _(b):
    return evaluation.false_positive_rate(b.found, evaluation.innocent(b.truth)).select(LEDGER, F.round("rate", 6).alias("rate"))


@query("precision_at_k")
def _(b):
    return evaluation.precision_at(b.queue, evaluation.anomalous(b.truth)).select(LEDGER, "k", F.round("precision", 6).alias("precision"))


@query("queue_quality")
def _(b):
    return evaluation.queue_quality(b.queue, evaluation.anomalous(b.truth))


@query("ablation")
def _(b):
    return evaluation.ablation(b.frames, evaluation.anomalous(b.truth))


@query("ablation_rules")
def _(b):
    return evaluation.ablation(b.frames, evaluation.anomalous(b.truth), use_model=False)


@query("compare_approaches")
def _(b):
    return evaluation.compare_approaches(evaluation.approach_sets(b.model_marks), b.truth, b.frames.times)


@query("signal_scorecard")
def _(b):
    return evaluation.signal_scorecard(b.hits, b.truth)


@query("mean_by_variant")
def _(b):
    per = b.hits.groupBy(LEDGER, "kind").agg(F.count(F.lit(1)).alias("vouchers"), F.avg("strength").alias("strength"))
    return evaluation.mean_by(per.drop(LEDGER), "kind")


@query("label_lift")
def _(b):
    late = F.datediff(F.col("posted_at").cast("date"), F.col("voucher_date")) > 45
    return evaluation.label_lift(b.truth, b.frames.vouchers, late | F.col("is_post_close"), "post_close_entry")


@query("truth_lookup")
def _(b):
    return evaluation.truth_summary(b.truth, b.frames.times)


@query("heldout_guard")
def _(b):
    seeds = b.spark.read.parquet(f"{b.sf}/events.parquet").select((F.col("user_id") * 7).cast("string").alias(LEDGER))
    tuning = b.spark.createDataFrame([(t,) for t in C.TUNING_LEDGERS], "ledger_id string")
    return evaluation.heldout_violations(seeds, tuning)


@query("result_fingerprint")
def _(b):
    return digest.table_fingerprint(evaluation.mean_by(b.marks.select("kind", "strength"), "kind"))


# --- scalar functions -------------------------------------------------------------------------------------

def orders(b: Book) -> DataFrame:
    return b.spark.read.parquet(f"{b.sf}/orders.parquet")


@query("fiscal_year_period")
def _(b):
    d = F.col("o_orderdate")
    return orders(b).select("o_orderkey", dates.fiscal_year(d).alias("fiscal_year"), dates.fiscal_period(d).alias("period"))


@query("rupee_text_to_paise")
def _(b):
    k = F.col("o_orderkey")
    body = money.format_inr(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    t = F.when(k % 4 == 1, F.concat(F.lit("("), body, F.lit(")"))).when(k % 4 == 2, F.concat(F.lit(" "), body, F.lit(" "))).when(k % 9 == 0, "nil").otherwise(body)
    return orders(b).select("o_orderkey", money.rupee_text_to_paise(t).alias("paise"))


@query("float_rupees_to_paise")
def _(b):
    return orders(b).select("o_orderkey", money.float_rupees_to_paise(F.col("o_totalprice")).alias("paise"))


@query("paise_to_rupees")
def _(b):
    paise = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return orders(b).select("o_orderkey", money.paise_to_rupees(paise).cast("string").alias("rupees"))


@query("rupees_to_paise")
def _(b):
    k = F.col("o_orderkey")
    body = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    t = F.when(k % 5 == 0, F.concat(body, F.lit("1"))).when(k % 7 == 0, "abc").otherwise(body)
    return orders(b).select("o_orderkey", money.exact_rupees_to_paise(t).alias("paise"))


@query("format_inr")
def _(b):
    k = F.col("o_orderkey")
    paise = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.when(k % 5 == 0, -100).when(k % 5 == 1, 0).otherwise(1) + k % 7
    return orders(b).select("o_orderkey", money.format_inr(paise).alias("amount"))


@query("line_props")
def _(b):
    return vouchers.line_properties(b.lines)


@query("uk_date")
def _(b):
    t = F.when(F.col("o_orderkey") % 6 == 0, "not-a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders(b).select("o_orderkey", dates.iso_to_dmy(t).alias("uk"))


@query("redact")
def _(b):
    p = b.spark.read.parquet(f"{b.sf}/pages.parquet")
    d = b.spark.read.parquet(f"{b.sf}/customer.parquet")
    one = p.select(F.concat(F.lit("p"), "page_id").alias("id"), text.redact(F.col("url")).alias("logged"))
    return one.unionByName(d.select(F.concat(F.lit("c"), "c_custkey").alias("id"), text.redact(F.col("c_name")).alias("logged")))


@query("conformity_level")
def _(b):
    x = (F.col("o_orderkey") % 200) / 10000.0
    return orders(b).select("o_orderkey", labels.conformity(x).alias("conformity"))


@query("contribution_level")
def _(b):
    return b.found.select(*KEY, F.explode("contributions").alias("x")).select(
        *KEY, F.col("x.kind").alias("kind"), labels.contribution_level(F.col("x.contribution")).alias("level"),
        labels.is_minor(F.col("x.contribution")).alias("minor"),
    )


@query("readability")
def _(b):
    d = b.spark.read.parquet(f"{b.sf}/documents.parquet")
    rate = textaudit.words_per_sentence(F.translate("text", "\t\n\r\u000b\u000c", "     "))
    return d.select("doc_id", F.round(rate, 6).alias("words_per_sentence"), labels.readability(rate).alias("reading"))


# --- extension points ---------------------------------------------------------------------------------------

@query("signal_registry")
def _(b):
    n = b.hits.groupBy("kind").agg(F.count(F.lit(1)).alias("hits"))
    return signals.registry_table(b.spark).join(n, "kind", "left").na.fill(0, ["hits"])


@query("detector_config")
def _(b):
    return b.frames.times.select(LEDGER, *[c for c in b.frames.times.columns if c.startswith("t_")])
