import pytest

import __spark_entry__ as contract
from checks.compare import duck, rows_of
from ledgerloom.plans import fixtures
from ledgerloom.sources import export
from ledgerloom.streaming.ingest import ingest_stream
from tests.conftest import SMALL

SAMPLE = ["voucher_view", "sig_duplicate_entry", "sig_round_amount", "sig_rare_pair", "sig_unusual_preparer", "sig_amount_outlier",
          "queue_ranked", "account_profile", "similar_entries", "ledger_digest", "adapt_sap_corpus", "parse_dates", "report_frame"]


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert 0 < len(rows) <= 100 and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))


def test_registry_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) >= 152


@pytest.fixture(scope="module")
def sql():
    return duck(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, SMALL)
    cur = sql.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_stream_lands_files_once_and_refuses_what_is_no_ledger(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    book = export.daybook(fixtures.event_lines(spark, SMALL)).toPandas()
    book.head(400).to_csv(drop / "north.csv", index=False)
    (drop / "notes.csv").write_text("a,b\n1,2\n")
    ingest_stream(spark, str(drop), out, fixtures.EVENT_THRESHOLDS, use_model=False).awaitTermination()
    first = spark.read.parquet(f"{out}/lines").count()
    book.iloc[400:600].to_csv(drop / "south.csv", index=False)
    ingest_stream(spark, str(drop), out, fixtures.EVENT_THRESHOLDS, use_model=False).awaitTermination()
    lines = spark.read.parquet(f"{out}/lines")
    assert first == 400 and {r.ledger_id: r["count"] for r in lines.groupBy("ledger_id").count().collect()} == {"north": 400, "south": 200}
    assert {r.ledger_id for r in spark.read.parquet(f"{out}/queue").select("ledger_id").distinct().collect()} == {"north", "south"}
    assert spark.read.parquet(f"{out}/refused").count() == 1


def test_stream_joins_part_files_and_late_files_of_a_ledger(spark, tmp_path):
    """However many files bring a ledger, in however many batches, its lines and queue are the same."""
    book = export.daybook(fixtures.event_lines(spark, SMALL)).toPandas().head(300)
    got = {}
    for name, batches in {"one": [[(0, 300)]], "parts": [[(0, 101), (101, 222)], [(222, 300)]]}.items():
        drop, out = tmp_path / name / "north", str(tmp_path / f"out-{name}")
        drop.mkdir(parents=True)
        for i, batch in enumerate(batches):
            for j, (lo, hi) in enumerate(batch):
                book.iloc[lo:hi].to_csv(drop / f"part-{i}{j}.csv", index=False)
            run = ingest_stream(spark, f"{tmp_path}/{name}/*", out, fixtures.EVENT_THRESHOLDS, use_model=False, by="folder")
            run.awaitTermination()
        lines = spark.read.parquet(f"{out}/lines").drop("source_row").orderBy("line_id").collect()
        queue = spark.read.parquet(f"{out}/queue").select("voucher_id", "priority", "rank", "band").orderBy("rank").collect()
        got[name] = (lines, queue, spark.read.parquet(f"{out}/sources").count())
    assert got["one"][:2] == got["parts"][:2] and (got["one"][2], got["parts"][2]) == (1, 3)
