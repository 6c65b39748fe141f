"""Periodic runs against a loop over all lags, on random words, planted rows and awkward tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boutline.llm import periods
from boutline.llm.queries import QUERIES
from boutline.llm.shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every maximal stretch per lag; a lag counts if no smaller one is a period of the stretch."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            if length >= max(24, 3 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2], "runs_sha256": sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
        "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def found(words):
    return [tuple(r) for r in periods.runs_of(np.array(words, np.int64)).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 30), st.lists(st.integers(0, 2), max_size=40), st.integers(1, 9))
def test_runs_equal_loop(block, times, tail, again):
    words = (block * times + tail) * again
    assert found(words[:700]) == plain_runs(words[:700])


@pytest.mark.parametrize("seed", range(40))
def test_long_periods_and_overlaps(seed):
    r = np.random.default_rng(seed)
    words = []
    while len(words) < 900:
        block = r.integers(0, r.integers(1, 6), r.integers(1, 130)).tolist()
        size = int(len(block) * r.uniform(0.5, 5))
        words += (block * 6)[:size]
        words += r.integers(0, 50, r.integers(0, 6)).tolist()
    assert found(words) == plain_runs(words)


def test_bounds():
    assert found([7] * 23) == [] and found([7] * 24) == [(0, 24, 1)]
    assert found(list(range(8)) * 3) == [(0, 24, 8)] and found(list(range(9)) * 3)[:1] == [(0, 27, 9)]
    assert found((list(range(9)) * 3)[:-1]) == []
    assert found([]) == [] and found([1]) == []
    many = found([1] * 100_000)
    assert many == [(0, 100_000, 1)]


def check(rows, docs):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted((key(r.asDict()) for r in rows)) == sorted(key(plain_row(*d)) for d in docs)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = QUERIES["op13_runs"](spark, sf).collect()
    check(rows, docs)
    assert any(r["n_runs"] for r in rows)


def test_awkward_and_empty(spark, awkward, empty, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in awkward.where("doc_id IS NULL OR doc_id <> 5").collect()]
    extra = [(i, t, "en", "s", 0) for i in range(60) for t in ("a b c d " * 12, "x " * 30 + "\x0b\x85 é " * 24)]
    some = spark.createDataFrame(extra, empty.schema)
    for name, df, want in (("a", awkward.select(*empty.columns).where("doc_id IS NULL OR doc_id <> 5").unionByName(some), docs + [r[:2] for r in extra]), ("e", empty, [])):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        check(QUERIES["op13_runs"](spark, f"{tmp_path}/{name}").collect(), want)
    out = periods.with_runs(awkward)
    assert out.columns[:-1] == awkward.columns and out.count() == awkward.count()
    clash = periods.with_runs(awkward.withColumnRenamed("lang", "periodic"))
    assert clash.columns[-1] == "_periodic"
    long = [r for r in out.collect() if r["doc_id"] == 5][0]["periodic"]
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 997)] and len(long["collapsed"].split()) == 997
