"""Sinks that know whether a write was finished, and malformed CSV rows."""

import os

import pytest
from pyspark.sql import functions as F

from spendlens.plans import stages
from spendlens.sources import files as IO


def failing(spark):
    return spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))


def test_a_failed_write_is_no_table_and_is_done_again(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    with pytest.raises(Exception, match="lost"):
        IO.write_table(failing(spark), path)
    assert not IO.is_committed(spark, path) and not os.path.exists(path)
    assert IO.write_table(spark.range(7), path) and spark.read.parquet(path).count() == 7
    assert not IO.write_table(spark.range(9), path) and spark.read.parquet(path).count() == 7
    assert sorted(os.listdir(tmp_path)) == ["t.parquet"]


def test_a_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    IO.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="lost"):
        IO.write_table(failing(spark), path, force=True)
    assert IO.is_committed(spark, path) and spark.read.parquet(path).count() == 5
    assert IO.write_table(spark.range(6), path, force=True) and spark.read.parquet(path).count() == 6
    assert IO.write_table(spark.read.parquet(path).where("id > 2"), path, force=True)  # a table may be rewritten from itself
    assert spark.read.parquet(path).count() == 3


def test_a_folder_left_by_a_killed_writer_is_written_again(spark, tmp_path):
    path = tmp_path / "t.parquet"
    (path / "_temporary" / "0").mkdir(parents=True)  # what a writer leaves that died before its commit
    assert IO.path_exists(spark, str(path)) and not IO.is_committed(spark, str(path))
    assert IO.write_table(spark.range(3), str(path)) and spark.read.parquet(str(path)).count() == 3
    aside = tmp_path / "_writing-t.parquet"
    aside.mkdir()
    (aside / "part-0").write_text("half")  # killed while writing aside
    assert IO.write_table(spark.range(4), str(path), force=True) and spark.read.parquet(str(path)).count() == 4
    assert not aside.exists()


@pytest.mark.parametrize("moment", ["mark", "swap"])
def test_a_kill_while_publishing_is_made_good(spark, tmp_path, monkeypatch, moment):
    path = str(tmp_path / "t.parquet")
    IO.write_table(spark.range(5), path)
    publish = IO._publish

    def killed(session, written, target):
        if moment == "swap":  # after the old table has been moved away
            os.rename(target, IO._beside(target, "replaced"))
        raise KeyboardInterrupt

    monkeypatch.setattr(IO, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        IO.write_table(spark.range(6), path, force=True)
    monkeypatch.setattr(IO, "_publish", publish)
    assert IO.is_committed(spark, path) == (moment == "mark")
    assert IO.write_table(spark.range(8), path) == (moment == "swap")
    assert spark.read.parquet(path).count() == (8 if moment == "swap" else 5)


def test_every_format_and_reports(spark, tmp_path):
    for fmt in ("parquet", "csv", "json"):
        assert IO.write_table(spark.range(3), str(tmp_path / fmt), fmt=fmt)
        assert IO.is_committed(spark, str(tmp_path / fmt)) and spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt)).count() == 3
    assert IO.is_committed(spark, IO.write_report("r", spark.range(2), str(tmp_path)))


CSV = 'a,b\n1,2\n3,4,5\n6\n"x,y","say ""hi"", twice"\n7,8,\n,\n'


def test_malformed_rows_raise_or_are_set_aside(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text(CSV)
    with pytest.raises(Exception, match="malformed CSV row"):
        IO.read_csv_text(spark, str(f)).collect()
    with pytest.raises(Exception, match="malformed CSV row"):
        IO.read_csv_text(spark, str(f)).select("a").collect()  # pruning columns does not hide them
    kept = [tuple(r) for r in IO.read_csv_text(spark, str(f), malformed="drop").collect()]
    assert kept == [("1", "2"), ("6", None), ("x,y", 'say "hi", twice'), (None, None)]
    bad = IO.malformed_csv(spark, str(f)).collect()
    assert {r.text: r.reason for r in bad} == {"3,4,5": "too many fields", "7,8,": "too many fields"}
    assert all(r.file.endswith("t.csv") for r in bad) and len(kept) + len(bad) == CSV.count("\n") - 1
    assert IO.read_csv_text(spark, str(f), malformed="drop").count() == 4
    with pytest.raises(ValueError):
        IO.read_csv_text(spark, str(f), malformed="ignore")
    f.write_text('a,b\n1,2\n"line\nfeed",10\n')
    for malformed in ("raise", "drop"):  # the second line of the field could pass for a row
        with pytest.raises(Exception, match="quote not closed"):
            IO.read_csv_text(spark, str(f), malformed=malformed).collect()
    assert [(r.reason, r.text) for r in IO.malformed_csv(spark, str(f)).collect()] == [("quote not closed", '"line')]


def test_quoted_line_feeds_with_multi_line(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('a,b\n"line\nfeed",10\n1,2,3\n5\n')
    kept = [tuple(r) for r in IO.read_csv_text(spark, str(f), malformed="drop", multi_line=True).collect()]
    assert kept == [("line\nfeed", "10"), ("5", None)]
    assert [r.reason for r in IO.malformed_csv(spark, str(f), multi_line=True).collect()] == ["too many fields"]


def test_preprocess_quarantines(spark, tmp_path):
    from test_pipeline import CARDS, LABELS, MCC, TXN, USERS

    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    for name, text in (("transactions_data.csv", TXN + "6,2010-03-01 00:00:00,10,100,$1.00,Chip,500,Rome,Italy,,5812,,surplus\n"),
                       ("users_data.csv", USERS), ("cards_data.csv", CARDS), ("mcc_codes.json", MCC), ("train_fraud_labels.json", LABELS)):
        (raw / name).write_text(text)
    with pytest.raises(Exception, match="too many fields"):
        stages.preprocess(spark, str(raw), out)
    assert not IO.is_committed(spark, f"{out}/transactions.parquet")
    assert all(stages.preprocess(spark, str(raw), out, quarantine=True).values())  # the failed stage is done again
    counts = {n: spark.read.parquet(f"{out}/{n}.parquet").count() for n in (
        "transactions", "transactions_malformed", "users", "users_malformed", "cards_malformed")}
    assert counts == {"transactions": 5, "transactions_malformed": 1, "users": 3, "users_malformed": 0, "cards_malformed": 0}
    assert spark.read.parquet(f"{out}/transactions_malformed.parquet").first().text.endswith("surplus")
