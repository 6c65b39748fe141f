"""Token alignment against whole texts encoded at once and plain loops over byte ends."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from boutline.llm import align
from boutline.llm.queries import QUERIES
from boutline.llm.shared import table


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


LETTER = align.byte_of_letter()


def plain_groups(tools, text):
    """[(a ids, b ids)] or [] when the text has no tokens."""
    if not text:
        return []
    a, b = tools
    raw = (" " + text).encode()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_bytes = [bytes(LETTER[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return []
    groups, i, j, x, y = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a_ids) or j < len(b_ids):
        if x <= y and i < len(a_ids) and (x < y or not left):
            x += len(a_bytes[i])
            left.append(a_ids[i])
            i += 1
        else:
            y += len(b_bytes[j])
            right.append(b_ids[j])
            j += 1
        if x == y and left and right:
            groups.append((left, right))
            left, right = [], []
    return groups


def plain_rows(tools, docs):
    held, per_doc = Counter(), []
    for doc_id, text in docs:
        groups = plain_groups(tools, text)
        links = Counter((a, b) for left, right in groups for a in left for b in right)
        held.update(links.keys())
        per_doc.append((doc_id, groups, links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for doc_id, groups, links in per_doc:
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield {
            "doc_id": doc_id, "n_a": sum(len(a) for a, _ in groups), "n_b": sum(len(b) for _, b in groups), "n_groups": len(groups),
            "n_links": sum(links.values()), "n_best": sum(n for p, n in links.items() if held[p] == most[p[0]]),
            "count_sum": sum(n * held[p] for p, n in links.items()),
            "groups_sha256": hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        }


def check(rows, want):
    key = lambda r: str(sorted(r.items()))
    assert sorted((r.asDict() for r in rows), key=key) == sorted(want, key=key)


PARTS = [
    "the", "The", "don't", "x.", "a,b", "..", "é", "é", "漢字", "😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " ", "  ", "\n", "\n\n", "\t",
    " ", "\x01", "\x1c", "\x85", "'s", "12", "ΑΣ", ",", "　", "İ", "ﬁ", "unbelievable", "ración", "\x00", "हिन्दी",
]


@pytest.mark.parametrize("long_group", [64, 1])
def test_texts_equal_whole_encoding(tools, monkeypatch, long_group):
    monkeypatch.setattr(align, "LONG_GROUP", long_group)
    r = random.Random(5)
    texts = ["", " ", "\n", " a", "a\n", "a \n b", "▁", "a ▁b c", "<0x0A>", "a▁ b", *("".join(r.choice(PARTS) + r.choice(["", " "]) for _ in range(r.randint(1, 14))) for _ in range(3000))]
    tool = align.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert tool.cuts
    for _ in range(2):  # the second time from memory
        for text, (counts, spelled, pair, times) in zip(texts, tool.align(texts), strict=True):
            groups = plain_groups(tools, text)
            links = Counter((a, b) for left, right in groups for a in left for b in right)
            assert spelled == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups), text
            assert counts == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()))
            assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(pair.tolist(), times.tolist(), strict=True)} == links


def test_groups_by_common_ends():
    assert [x.tolist() for x in align.groups_of([1, 3, 4], [2, 3, 4])] == [[3, 4], [2, 3], [2, 3]]
    assert [x.tolist() for x in align.groups_of([], [])] == [[], [], []]


def test_small_memory(monkeypatch):
    monkeypatch.setattr(align, "PIECES_KEPT", 1)
    tool = align.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    first = [list(map(str, r)) for r in tool.align(["the cat sat", "the hat"])]
    tool.align(["on and on"])
    assert [list(map(str, r)) for r in tool.align(["the cat sat", "the hat"])] == first


def invented(r, n):
    return [" ".join("".join(r.choices("abdeghilmnorstu", k=r.randint(6, 11))) for _ in range(200)) for _ in range(n // 200)]


def test_memory_is_small_with_many_rare_words():
    """A worker keeps what it has after its last text, beside the engine."""
    tool, texts = align.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model"), invented(random.Random(3), 60_000)
    tracemalloc.start()
    try:
        for i in range(0, len(texts), 300):
            assert all(row[0][0] for row in tool.align(texts[i : i + 300]))
        now, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 70e6, (now, peak)


def test_frequent_pieces_are_remembered(monkeypatch):
    monkeypatch.setattr(align, "PIECES_KEPT", 8)
    tool, plain = (align.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model") for _ in range(2))
    r = random.Random(4)
    for k, text in enumerate(invented(r, 1000)):
        texts = ["the cat\nthe dog the cat", f"the {text} the cat", "\nthe \t the"]
        got = [list(map(str, row)) for row in tool.align(texts)]
        if k:
            assert list(tool.known)[:2] == ["the", "cat"] and len(tool.known) < 8 + 210
        plain._reset()
        assert got == [list(map(str, row)) for row in plain.align(texts)]


@pytest.mark.parametrize("plain", [r"(?s).+", r"\n?\S+", "$^"])
def test_joined_pieces_equal_single_ones(tools, monkeypatch, plain):
    """Also where the bytes of a line differ, so that each of its pieces becomes a line."""
    r = random.Random(6)
    texts = ["".join(r.choice(PARTS) + r.choice(["", " "]) for _ in range(r.randint(1, 14))) for _ in range(300)]
    texts += ["a ▁b c", "▁", " a", "a\n", "a\nb", "\na"]
    monkeypatch.setattr(align, "_PLAIN", re.compile(plain))
    tool = align.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    for text, (_, spelled, _, _) in zip(texts, tool.align(texts), strict=True):
        assert spelled == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(tools, text)), text


@pytest.mark.parametrize("frequent", [50_000, 3])
def test_query(spark, sf, tools, monkeypatch, frequent):
    """Also with so few pairs sent to all tasks that most are joined by their ids."""
    monkeypatch.setattr(align, "MOST_FREQUENT", frequent)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    check(QUERIES["op12_align"](spark, sf).collect(), plain_rows(tools, docs))


def test_awkward_and_empty(spark, awkward, empty, tools, tmp_path):
    extra = [(100 + i, t, "en", "s", 0) for i, t in enumerate(["a ▁ b", "ab" * 400, "नि" * 50, " x", "x ", "<|endoftext|>"] * 2)]
    both = awkward.select(*empty.columns).unionByName(spark.createDataFrame(extra, empty.schema))
    for name, df in (("a", both), ("e", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = list(plain_rows(tools, [(r["doc_id"], r["text"]) for r in df.collect()]))
        check(QUERIES["op12_align"](spark, f"{tmp_path}/{name}").collect(), want)
    clash = awkward.withColumns({"alignment": awkward.doc_id, "n_best": awkward.doc_id, "row": awkward.doc_id})
    out = align.aligned(clash)
    assert out.columns == [*clash.columns, "_alignment"]
    more = align.with_support(out.drop("text"), "_alignment")
    assert more.columns[-2:] == ["_n_best", "count_sum"] and more.count() == awkward.count()
    spelled = {r["doc_id"]: r["_alignment"]["groups"] for r in out.collect() if r["doc_id"] in (6, 3)}
    assert spelled[3] == "" and spelled[6].count(";") == len(plain_groups(tools, "Same text with id six.")) - 1
