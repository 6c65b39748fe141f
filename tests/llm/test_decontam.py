"""Contamination against plain windows, on the small tables, planted texts and awkward tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from boutline.llm import decontam
from boutline.llm.queries import QUERIES
from boutline.llm.shared import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_rows(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w = words(text)
        hit, held = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                ids = windows.get(tuple(w[p : p + k]))
                if ids is not None:
                    hit.update(range(p, p + k))
                    held |= ids
        named = sorted(str(i) for i in held if i is not None)
        sha = hashlib.sha256(",".join(named).encode()).hexdigest()
        yield {"doc_id": doc_id, "n_words": len(w), "n_hit": len(hit), "n_items": len(named), "items_sha256": sha, "contaminated": bool(hit)}


def check(rows, want):
    key = lambda r: str(sorted(r.items()))
    assert sorted((r.asDict() for r in rows), key=key) == sorted(want, key=key)


def write(folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_small_tables(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    items = table(spark, sf, "benchmark").select("item_id", "text").collect()
    want = list(plain_rows(docs, items))
    check(QUERIES["op11_decontam"](spark, sf).collect(), want)
    assert any(r["contaminated"] for r in want)


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, tmp_path, seed):
    """Few words, so that grams repeat; shared passages of 1 to 25 words; items of every length, some twice."""
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "é", "D"] if seed == 0 else [f"w{i}" for i in range(60)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([0, 1, 3, 5, 7, 9, 10, 11, 14, 25, 60]) if seed != 2 else r.randint(10, 40)))) for i in range(40)]
    items += [(i, t) for i, t in items[:4]] + [(90 + i, t.upper()) for i, t in items[:6]] + [(None, items[7][1]), (80, None)]
    docs = []
    for i in range(60):
        text = some(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, len(w))
            text += w[a : a + r.randint(1, 25)] + some(r.randint(0, 4))
        docs.append((i // 2, r.choice([" ", ", ", "\n"]).join(text)))
    folder = write(tmp_path / "t", spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    check(QUERIES["op11_decontam"](spark, folder).collect(), plain_rows(docs, items))


def test_awkward_and_empty(spark, awkward, empty, tmp_path):
    items = spark.createDataFrame([(1, "the QUICK brown fox jumps over the lazy dog the quick brown"), (2, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (3, ""), (4, None), (5, "same")], "item_id long, text string")
    items = items.withColumns({"h": F.lit(1), "spot": F.lit(2), "row": F.lit(3), "words": F.lit(4)})
    none = items.where("false")
    for i, (docs, marks) in enumerate([(awkward, items), (awkward, none), (empty, items), (empty, none)]):
        docs = docs.withColumns({"row": F.lit(1), "n_hit": F.lit(1), "places": F.lit(1), "words": F.lit(1)})
        folder = write(tmp_path / str(i), docs, marks)
        want = list(plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in marks.collect()]))
        check(QUERIES["op11_decontam"](spark, folder).collect(), want)


def test_spans(spark):
    docs = spark.createDataFrame([(1, "x " * 5 + "one two three four five six seven eight nine ten eleven y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "zero one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    (row,) = decontam.contamination(docs, items).collect()
    assert row["n_hit"] == 11 and row["item_ids"] == ["7"]
    assert min(s["start"] for s in row["spans"]) == 5 and max(s["end"] for s in row["spans"]) == 16


def test_native(spark, sf):
    text = QUERIES["op11_decontam"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
