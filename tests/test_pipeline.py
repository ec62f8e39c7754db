"""Raw files -> preprocess -> cleanup round trip."""

import datetime as dt
from decimal import Decimal

import pytest

from spendlens.operators import quality as QL
from spendlens.plans import stages
from spendlens.sources import files as IO

TXN = """id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors
1,2010-01-01 00:01:00,10,100,$-77.00,Swipe Transaction,500,Beulah,ND,58523.0,5499,
2,2010-01-01 23:00:00,10,100,"$1,234.56",Chip Transaction,500,Bettendorf,IA,123.0,5311,Bad PIN
3,2010-01-02 01:00:00,10,101,$0.00,Online Transaction,501,ONLINE,,,4829,"Bad PIN,Insufficient Balance"
4,garbage,11,102, $5.10 ,chip transaction,502,Rome,Italy,,5812,
5,2010-02-28 12:00:00,11,102,$3.00,,502,Rome,Italy,,5812,NA
"""
USERS = """id,current_age,retirement_age,birth_year,birth_month,gender,address,latitude,longitude,per_capita_income,yearly_income,total_debt,credit_score,num_credit_cards
11,40,66,1984,3,Male,1 Road,40.1,-80.2,$20000,$0,$100,700,2
10,60,67,1964,12,Female,2 Road,41.1,-81.2,"$30,000","$60,000",$5000,,1
12,30,65,1994,1,Female,3 Road,42.1,-82.2,$10000,$20000,$0,650,3
"""
CARDS = """id,client_id,card_brand,card_type,card_number,expires,cvv,has_chip,num_cards_issued,credit_limit,acct_open_date,year_pin_last_changed,card_on_dark_web
100,10,Visa,Debit,4344,12/2022,623,YES,2,$24295,09/2002,2008,No
101,10,Visa,Credit,4345,2/2022,393, no ,1,$21968,4/2014,2014,Yes
102,11,Amex,Credit,4346,13/2022,111,maybe,1,$100,01/2010,2012,No
"""
MCC = '{"5812": "Eating, Places", "5541": "Service Stations"}'
LABELS = '{"target": {"1": "No", "2": "Yes", "99": "No"}}'


@pytest.fixture()
def raw_dir(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "transactions_data.csv").write_text(TXN)
    (d / "users_data.csv").write_text(USERS)
    (d / "cards_data.csv").write_text(CARDS)
    (d / "mcc_codes.json").write_text(MCC)
    (d / "train_fraud_labels.json").write_text(LABELS)
    return d


def test_preprocess_types_and_values(spark, raw_dir, tmp_path):
    out = str(tmp_path / "pre")
    done = stages.preprocess(spark, str(raw_dir), out)
    assert all(done.values())
    t = {r["id"]: r for r in spark.read.parquet(f"{out}/transactions.parquet").collect()}
    assert [t[i]["amount"] for i in range(1, 6)] == [Decimal("-77.00"), Decimal("1234.56"), Decimal("0.00"),
                                                      Decimal("5.10"), Decimal("3.00")]
    assert (t[1]["zip"], t[2]["zip"], t[3]["zip"]) == ("58523", "00123", None)
    assert t[4]["date"] is None and t[5]["errors"] is None and t[3]["errors"] == "Bad PIN,Insufficient Balance"
    c = {r["id"]: r for r in spark.read.parquet(f"{out}/cards.parquet").collect()}
    assert (c[100]["expires"], c[101]["expires"], c[102]["expires"]) == (dt.date(2022, 12, 1), dt.date(2022, 2, 1),
                                                                          None)
    assert (c[100]["has_chip"], c[101]["has_chip"], c[102]["has_chip"]) == (True, False, None)
    assert c[101]["card_on_dark_web"] is True
    mcc = {r["id"]: r["description"] for r in spark.read.parquet(f"{out}/mcc_codes.parquet").collect()}
    assert mcc == {5812: "Eating, Places", 5541: "Service Stations"}
    lab = {r["id"]: r["fraud"] for r in spark.read.parquet(f"{out}/fraud_labels.parquet").collect()}
    assert lab == {1: False, 2: True, 99: False}
    loss = {(r["table"], r["column"]): r["lost"] for r in stages.coercion_report(spark, str(raw_dir)).collect()}
    assert loss[("transactions", "date")] == 1 and loss[("cards", "expires")] == 1 and loss[("cards", "has_chip")] == 1


def test_losses_are_counted_while_tables_are_written(spark, raw_dir, tmp_path):
    out = str(tmp_path / "pre")
    done = stages.preprocess(spark, str(raw_dir), out)
    report = {(r["table"], r["column"]): r["lost"] for r in stages.coercion_report(spark, str(raw_dir)).collect()}
    assert {k: done.losses[k[0]][k[1]] for k in report} == report and sum(report.values()) >= 3
    others = {(t, c): n for t, lost in done.losses.items() for c, n in lost.items() if (t, c) not in report}
    assert others[("transactions", "amount")] == 0 and not any(others.values())
    assert done.rows == {t: spark.read.parquet(f"{out}/{t}.parquet").count() for t in ("transactions", "users", "cards")}
    assert not any("_raw" in spark.read.parquet(f"{out}/{t}.parquet").columns for t in done.rows)
    again = stages.preprocess(spark, str(raw_dir), out)
    assert again.rows == {} and again.losses == {}  # nothing was written
    (raw_dir / "cards_data.csv").write_text(CARDS.splitlines()[0] + "\n")
    empty = stages.preprocess(spark, str(raw_dir), out, force=True)
    assert empty.rows["cards"] == 0 and set(empty.losses["cards"].values()) == {0}


def test_skip_unless_force(spark, raw_dir, tmp_path):
    out = str(tmp_path / "pre")
    assert all(stages.preprocess(spark, str(raw_dir), out).values())
    assert not any(stages.preprocess(spark, str(raw_dir), out).values())
    assert all(stages.preprocess(spark, str(raw_dir), out, force=True).values())


def test_cleanup_rejects_missing_and_cleans(spark, raw_dir, tmp_path):
    pre, clean = str(tmp_path / "pre"), str(tmp_path / "clean")
    stages.preprocess(spark, str(raw_dir), pre)
    with pytest.raises(ValueError, match="Column 'expires' has 1 missing values"):
        stages.cleanup(spark, pre, clean)
    # cards failed first (D12); transactions would fail on the garbage date as well
    with pytest.raises(ValueError, match="Column 'date' has 1 missing values"):
        QL.assert_no_missing(stages.clean_transactions(spark.read.parquet(f"{pre}/transactions.parquet")),
                             ("merchant_state", "zip", "errors"))
    users = stages.clean_users(spark.read.parquet(f"{pre}/users.parquet"))
    assert users.columns[:3] == ["id", "retirement_age", "birth_date"]
    assert "current_age" not in users.columns and "yearly_income_usd" in users.columns
    with pytest.raises(ValueError, match="credit_score"):
        QL.assert_no_missing(users)


def test_profile_and_missing_report(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "x", float("nan"))], "a int, b string, c double")
    prof = {r["column"]: (r["type"], r["non_null"]) for r in QL.profile(df).collect()}
    assert prof == {"a": ("int", 2), "b": ("string", 1), "c": ("double", 2)}
    miss = {r["column"]: r["missing"] for r in QL.missing_report(df).collect()}
    assert miss == {"a": 0, "b": 1, "c": 1}


def test_csv_to_parquet_and_load_tables(spark, raw_dir, tmp_path):
    p = str(tmp_path / "t.parquet")
    size = IO.csv_to_parquet(spark, str(raw_dir / "transactions_data.csv"), p)
    assert size > 0 and spark.read.parquet(p).count() == 5
    d = tmp_path / "clean"
    IO.write_table(spark.read.parquet(p), str(d / "transactions.parquet"))
    tables = IO.load_tables(spark, str(d))
    assert tables.users is None and tables.cards is None and tables.transactions.count() == 5


def test_run_pipeline_end_to_end(spark, tmp_path):
    """P4 on valid raw files: preprocess -> cleanup -> every report over DECIMAL money columns."""
    d = tmp_path / "raw_ok"
    d.mkdir()
    rows = [TXN.splitlines()[0]]
    for i in range(60):
        client, card = 10 + i % 3, 100 + i % 3
        rows.append(f"{i + 1},2010-0{1 + i % 9}-{10 + i % 18} {i % 24:02d}:15:00,{client},{card},"
                    f'"${(i * 37) % 900 + 1},{i % 100:02d}.{i % 97:02d}",{"Chip" if i % 2 else "Swipe"} Transaction,'
                    f"{500 + i % 4},{['Austin', 'Boston', 'Rome'][i % 3]},{['TX', 'MA', 'Italy'][i % 3]},"
                    f"{(i * 7919) % 99999}.0,{5411 + i % 3},{'Bad PIN' if i % 5 == 0 else ''}")
    (d / "transactions_data.csv").write_text("\n".join(rows) + "\n")
    (d / "users_data.csv").write_text(USERS.replace(",,1\n", ",720,1\n"))
    (d / "cards_data.csv").write_text(CARDS.replace("13/2022,111,maybe", "11/2022,111,YES") + (
        "103,12,Visa,Debit,4347,01/2023,222,NO,1,$500,03/2015,2016,No\n"))
    (d / "mcc_codes.json").write_text(MCC)
    (d / "train_fraud_labels.json").write_text(LABELS)
    out = stages.run_pipeline(spark, str(d), str(tmp_path / "work"), reports_dir=str(tmp_path / "reports"))
    assert all(out["preprocess"].values()) and all(out["cleanup"].values())
    failed = {k: v for k, v in out["reports"].items() if v != "ok"}
    assert not failed, failed
    t = spark.read.parquet(str(tmp_path / "work" / "cleaned" / "transactions.parquet"))
    assert dict(t.dtypes)["amount_usd"] == "decimal(12,2)" and t.count() == 60
    risk = spark.read.parquet(str(tmp_path / "reports" / "risk_metrics"))
    assert {"debt_to_income", "high_error_rate", "avg_credit_limit"} <= set(risk.columns)
