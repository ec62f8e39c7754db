"""The command line keeps the submitter's session; sources report what they cannot read; ages as of a day."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException

from conftest import ROOT
from spendlens.operators import aggregates as A
from spendlens.sources import files as IO


def test_command_line_keeps_master_and_settings():
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --name mine --conf "
                        "spark.sql.shuffle.partitions=777 --conf spark.ui.enabled=false pyspark-shell"}
    code = ("from spendlens.__main__ import _session; s = _session(); "
            "print('GOT', s.sparkContext.master, s.sparkContext.appName, s.conf.get('spark.sql.shuffle.partitions'))")
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240).stdout
    assert "GOT local[2] mine 777" in out


def test_label_map_keeps_nulls_and_raises_on_bad_entries(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"target": {"1":"Yes","2":null, "3" : "No"}}')
    got = {r["id"]: r["fraud"] for r in IO.read_labelled_map(spark, str(tmp_path / "ok.json")).collect()}
    assert got == {1: True, 2: None, 3: False}
    (tmp_path / "bad.json").write_text('{"target": {"1":"Yes","x4":"Yes"}}')
    with pytest.raises(PySparkException):
        IO.read_labelled_map(spark, str(tmp_path / "bad.json")).collect()
    loose = IO.read_labelled_map(spark, str(tmp_path / "bad.json"), strict=False).collect()
    assert sorted(str(r["id"]) for r in loose) == ["1", "None"]
    (tmp_path / "none.json").write_text('{"target": {}}')
    assert IO.read_labelled_map(spark, str(tmp_path / "none.json")).count() == 0


def test_current_age_as_of_a_day(spark):
    users = spark.createDataFrame([(1, dt.date(1980, 2, 1)), (2, None)], "id long, birth_date date")
    got = {r["id"]: r["current_age"] for r in A.with_current_age(users, dt.date(2020, 1, 31)).collect()}
    assert got == {1: 39, 2: None}
    assert A.with_current_age(users, dt.date(2020, 2, 1)).where("id = 1").first()["current_age"] == 40
    aged = users.selectExpr("id", "7 AS current_age", "birth_date")
    assert A.with_current_age(aged, dt.date(2020, 2, 1)).first()["current_age"] == 7


def test_one_dark_web_rule(spark):
    cards = spark.createDataFrame([("YES ",), ("yes",), ("true",), ("No",), (None,), ("maybe",)], "card_on_dark_web string")
    assert [r[0] for r in cards.select(A.dark_web_flag("card_on_dark_web")).collect()] == [1, 1, 1, 0, 0, 0]
