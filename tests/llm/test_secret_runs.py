"""Linked parts of secrets end where their run of characters ends."""

import pytest

from boutline.llm import secrets

ID = "client_id=" + "robot" * 9 + ".apps.googleusercontent.com"
URL = "https://db.example.com/" + "path/" * 45 + "?key=hidden"
BODY = "aB3" * 40


@pytest.mark.parametrize("key", [BODY[:40], BODY[:43] + "=", BODY[:44], BODY[:64], BODY[:86] + "==", BODY[:88]])
def test_whole_runs(spark, key):
    text = f"{ID} and {key} at {URL} end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = secrets.BASE + secrets.ADDED
    (row,) = secrets.scan(df).collect()
    got = [(names[s["kind"]], text[s["start"] : s["end"]]) for s in row["spans"]]
    assert got == [("key_id", ID), ("key_string", key), ("endpoint", URL)]
    assert secrets.redacted(df).first()["text"] == "[SECRET] and [SECRET] at [SECRET] end"


def test_single_class_runs_stay(spark):
    df = spark.createDataFrame([(1, f"client_id=robot42 {'z' * 64} {'A1' * 32}")], "doc_id long, text string")
    assert secrets.scan(df).first()["spans"] == []
