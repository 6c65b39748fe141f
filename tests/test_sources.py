import datetime as dt

from pyspark.sql import functions as F

from boutline.operators import clean, longform
from boutline.sources import files, pages

HEADER = ["Title", "Winner", "Red Fighter", "Blue Fighter", "Red Sig. str.", "Blue Sig. str.", "Red Ctrl", "Date"]


def test_csv_to_clean_bouts(spark, tmp_path):
    rows = [
        ("Lightweight Bout", "A", "A", "B", "12 of 40", "0 of 0", "4:35", "Oct 1, 2023"),
        ("Women's Bout", "C", "C", "D", "1 of 2", "1 of 2", "--", "Oct 1, 2023"),
        ("Open Weight", "E", "E", "F", "1 of 2", "1 of 2", "1:00", "Oct 1, 2023"),
        ("Heavyweight", " ", "G", "H", "1 of 2", "1 of 2", "1:00", "Oct 1, 2023"),
        (None, "I", "I", "J", "3 of 4", "1 of 2", "0:30", "Oct 1, 2023"),
    ]
    path = str(tmp_path / "raw")
    files.append_fixed(spark.createDataFrame(rows, files.text_schema(HEADER)), path, [*HEADER, "Extra"])
    raw = files.read_csv(spark, path, [*HEADER, "Extra"])
    assert raw.count() == 5
    got = {r["Winner"]: r for r in clean.clean_raw(raw, drop=["Extra", "Date"]).collect()}
    assert set(got) == {"A", "I"}
    a = got["A"]
    assert (a["Red Sig. str."], a["Red Sig. str.%"], a["Blue Sig. str.%"]) == (12, 0.3, 0)
    assert round(a["Red Ctrl"], 6) == 4.583333
    assert "Date" not in a.asDict()


def test_column_names():
    assert files.split_prefix(HEADER, "Red", skip=["Fighter"]) == ["Sig. str.", "Ctrl"]
    assert files.columns_without(["id", "a oppdiff", "b"], words=["oppdiff"], names=["id"]) == ["b"]


def test_lines_keep_their_order(spark, tmp_path):
    src = tmp_path / "log.txt"
    src.write_text("\n".join(f"line {i}" for i in range(100)))
    lines = files.read_lines(spark, str(src)).orderBy("file", "block_start", "line_in_block")
    assert [r["line"] for r in lines.collect()] == [f"line {i}" for i in range(100)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"k{i}") for i in (3, 1, 2)], "n int, line string")
    files.write_lines(df, out, ["n"])
    assert [r["value"] for r in spark.read.text(out).collect()] == ["k1", "k2", "k3"]


def test_tables_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020, "x"), (2, 2021, "y")], "id int, year int, v string")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        files.write_table(df.where("id = 1"), path, fmt=fmt)
        files.write_table(df, path, "year", fmt)  # rebuilt
        assert spark.read.option("header", True).format(fmt).load(path).count() == 2
    doc = tmp_path / "best.json"
    doc.write_text('{\n "best_params": {"depth": 3},\n "best_score": 0.66\n}')
    got = files.read_json_document(spark, str(doc), "best_params map<string, double>, best_score double").first()
    assert (got["best_params"]["depth"], got["best_score"]) == (3, 0.66)


def test_documents_are_bounded_and_whole(spark):
    day = dt.date(2024, 1, 1)
    rows = [(i, day, "a", "b", "win", 0.6, 0.6) for i in range(25)]
    df = spark.createDataFrame(rows, "bout_id bigint, d date, red string, blue string, predicted_result string, probability double, p double")
    docs = files.prediction_documents(df, 10)
    assert sorted(r["bouts"] for r in docs.collect()) == [5, 10, 10]
    schema = "predict_data array<struct<bout_id: bigint>>, class_probabilities struct<Win: array<double>, Lose: array<double>>"
    parsed = docs.select(F.from_json("document", schema).alias("j")).select(F.explode("j.predict_data.bout_id").alias("i"))
    assert sorted(r["i"] for r in parsed.collect()) == list(range(25))


PAGE = """<html><div class="b-person"><i class="b-status">
 W </i><h3 class="b-name"><!-- -->Ann Lee</h3></div>
<div class="b-person"><i class="b-status">L</i><h3 class="b-name"> Bea Fox </h3></div>
<i class="b-label">Method:</i> KO/TKO <i class="b-label">Round:</i> 2
<table><thead><tr><th>Fighter</th><th> KD </th></tr></thead><tbody><tr><td><p>Ann Lee</p><p>Bea Fox</p></td><td>
<p> 1 </p><p>0</p></td></tr></tbody></table>
<table><tr><th>KD</th><th>Ctrl</th></tr><tr><td><p>9</p><p>9</p></td><td><p>2:10</p></td></tr></table></html>"""


def test_page_extraction(spark):
    df = spark.createDataFrame([(1, "http://x/b/1", PAGE.replace("<!-- -->", ""))], "page_id int, url string, html string")
    o = pages.outcomes(df).first()
    assert (o["winner"], o["loser"], o["draw"]) == ("Ann Lee", "Bea Fox", False)
    d = pages.labelled_values(df, {"Method": "method", "Round": "round", "Referee": "referee"}).first()
    assert (d["method"], d["round"], d["referee"]) == ("KO/TKO", "2", None)
    t = {(r["side"], r["header"]): r["value"] for r in pages.stat_tables(df).collect()}
    assert t == {
        ("red", "Fighter"): "Ann Lee", ("blue", "Fighter"): "Bea Fox", ("red", "KD"): "1", ("blue", "KD"): "0",
        ("red", "Ctrl"): "2:10", ("blue", "Ctrl"): "",
    }


def test_link_expansion(spark):
    rows = [
        (1, "http://x/index", '<a href="/card/1"><a href="/card/1"><a href="/about">'),
        (2, "http://x/card/1", '<a href="/bout/7"><a href="http://x/bout/8">'),
        (3, "http://x/bout/7", ""),
        (4, "http://x/bout/8", ""),
        (5, "http://x/bout/9", ""),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    found = pages.expand_links(df, df.where("page_id = 1"), ["/card/", "/bout/"])
    assert sorted(r["page_id"] for r in found.collect()) == [3, 4]
    degree = {r["link"]: (r["pages"], r["links"], r["stored"]) for r in pages.link_in_degree(df).collect()}
    assert degree["http://x/card/1"] == (1, 2, True) and degree["http://x/about"] == (1, 1, False)


def test_reached_pages_ends_in_circles(spark):
    rows = [
        (1, "http://x/1", '<a href="/2"><a href="/2"><a href="http://x/3"><a href="/none">'),
        (2, "http://x/2", '<a href="/4"><a href="/1">'),
        (3, "http://x/3", '<a href="/4"><a href="/3">'),
        (4, "http://x/4", '<a href="/5">'),
        (5, "http://x/5", None),
        (6, "http://x/6", '<a href="/1">'),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    reach = lambda *a, **k: {r["page_id"]: r["level"] for r in pages.reached_pages(df, df.where("page_id = 1"), *a, **k).collect()}
    assert reach() == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert reach(levels=1) == {1: 0, 2: 1, 3: 1}
    assert reach("x/") == {1: 0, 3: 1}
    assert pages.reached_pages(df, df.where("false")).count() == 0


def test_history_and_pairs(spark):
    html = "<table><tr><th>h</th></tr><tr><td><a>win</a></td><td><p>2</p><p>1</p></td></tr><tr><td>loss</td><td><p>0</p><p>3</p></td></tr></table>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = [(r["result"], r["kd"], r["kd_opp"]) for r in pages.history_rows(df, ["result", "kd"]).orderBy("row_no").collect()]
    assert got == [("win", "2", "1"), ("loss", "0", "3")]
    lists = spark.createDataFrame([(["a", "b", "c", "d", "e"], [1]), ([], [])], "n array<string>, b array<int>")
    got = [r[0] for r in lists.select(pages.pair_up(F.col("n"), F.col("b"))).collect()]
    assert [tuple(x) for x in got[0]] == [("a", "b", 1)] and got[1] == []


def test_names_and_quarantine(spark):
    names = spark.createDataFrame([(" José ",), ("Old Name",)], "name string")
    alias = spark.createDataFrame([("Old Name", "New Name")], "alias string, canonical string")
    got = sorted(r["normal_name"] for r in clean.normalise_names(names, alias).collect())
    assert got == ["Jose", "New Name"]
    df = spark.createDataFrame([("1", "x"), ("y", "2"), ("3", None)], "a string, b string")
    checks = {c: (F.col(c), F.col(c).try_cast("int")) for c in "ab"}
    assert [r["error"] for r in clean.quarantine(df, checks).collect()] == ["bad b: x", "bad a: y", None]


def test_mirrored_rows_are_dropped(spark):
    rows = [("a", "b", "e1", 1), ("b", "a", "e1", 2), ("a", "b", "e2", 3), ("b", "a", "e2", 4)]
    df = spark.createDataFrame(rows, "entity string, opponent string, event string, n int")
    assert sorted(r["n"] for r in longform.first_perspective(df, "event", ["n"]).collect()) == [1, 3]


def test_nested_markup(spark):
    html = """<div class="x-person"><i class="x-status"> W </i><h3 class="x-name"><a href="/p/1"> Al <b>Bo</b></a></h3></div>
<div class="x-person"><i class="x-status">L</i><h3 class="x-name"><a>Cy</a></h3></div>
<p><i class="text"><i class="x-label"> Method: </i> <i> KO/TKO </i></i><i class="text"><i class="x-label">Referee:</i> <span>D <b>E</b></span></i></p>
<table><tr><th><b>KD</b></th></tr><tr><td><p><a>1</a></p><p> <i>0</i> </p></td></tr></table>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert pages.outcomes(df).first().asDict() == {"page_id": 1, "winner": "Al Bo", "loser": "Cy", "draw": False}
    v = pages.labelled_values(df, pages.BOUT_LABELS).first()
    assert (v["Method"], v["Referee"], v["Round"]) == ("KO/TKO", "D E", None)
    assert {(r["side"], r["header"]): r["value"] for r in pages.stat_tables(df).collect()} == {("red", "KD"): "1", ("blue", "KD"): "0"}


def test_entity_labels(spark):
    html = """<ul><li><i class="x-item-title x">Height:</i> 5' 11" </li><li><i class="x-item-title">STANCE:</i>
 <b>Southpaw</b></li></ul>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    v = pages.labelled_values(df, pages.ENTITY_LABELS).first()
    assert (v["Height"], v["Stance"], v["Reach"]) == ("5' 11\"", "Southpaw", None)
