"""Incremental ingest: every landed file is typed and written exactly once."""

from decimal import Decimal

from spendlens.streaming.ingest import ingest_transactions

HEADER = "id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors\n"


def test_files_are_ingested_once(spark, tmp_path):
    landing, out = tmp_path / "landing", tmp_path / "out"
    landing.mkdir()
    (landing / "a.csv").write_text(HEADER + "1,2010-01-01 00:01:00,10,100,$-77.00,Swipe,500,Beulah,ND,58523.0,5499,\n")
    (landing / "b.csv").write_text(HEADER + '2,2010-01-02 00:00:00,10,100,"$1,234.56",Chip,500,X,IA,123.0,5311,NA\n')
    q = ingest_transactions(spark, str(landing), str(out))
    q.awaitTermination(120)
    rows = {r["id"]: r for r in spark.read.parquet(str(out / "data")).collect()}
    assert rows[1]["amount"] == Decimal("-77.00") and rows[2]["zip"] == "00123" and rows[2]["errors"] is None
    (landing / "c.csv").write_text(HEADER + "3,2010-01-03 00:00:00,11,102,$3.00,Chip,502,Rome,IT,,5812,\n")
    q = ingest_transactions(spark, str(landing), str(out))
    q.awaitTermination(120)
    ids = sorted(r["id"] for r in spark.read.parquet(str(out / "data")).collect())
    assert ids == [1, 2, 3]
