import pyarrow as pa
import pytest

from boutline.llm import minhash, packing, shared, simhash, tokens


@pytest.fixture
def stored(spark, monkeypatch):
    """Partitions of every stored step, where small partitions of a shuffle are not merged."""
    sizes = []

    def recorded(df, partition_by=None):
        sizes.append(df.rdd.getNumPartitions())
        return shared.stage(df, partition_by)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    monkeypatch.setattr(simhash, "stage", recorded)
    monkeypatch.setattr(minhash, "stage", recorded)
    yield sizes
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_steps_of_components_have_few_files(spark, stored):
    chain = spark.range(40).selectExpr("id AS u", "id + 1 AS v")
    found = simhash.components(chain, 40).collect()
    assert {r["node"]: r["root"] for r in found} == {i: 0 for i in range(41)}
    assert len(stored) > 2 and max(stored) <= spark.sparkContext.defaultParallelism


def test_few_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "FILE_ROWS", 10)
    wide = spark.range(1000).repartition(64, "id")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    assert [shared.few(wide, n).rdd.getNumPartitions() for n in (0, 10 * (cores + 1), 10**9)] == [min(most, x) for x in (cores, cores + 1, 10**9)]
    assert sorted(r[0] for r in shared.few(wide, 0).collect()) == list(range(1000))


def test_near_copies_store_few_files(spark, stored):
    rows = [(i, " ".join(f"w{(i // 2) * 100 + k}" for k in range(60)) + (" end" if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == {i: i - i % 2 for i in range(40)}
    assert sum(n >= 64 for n in stored) * 3 <= len(stored)


def test_texts_are_encoded_in_groups(monkeypatch):
    coder = tokens.Encoder("byte_bpe_50k.json", True)
    texts = pa.array([f"word{i} and  two blanks {i * 7919}" for i in range(50)])
    whole = [x.tolist() for x in coder.encode(texts)]
    monkeypatch.setattr(tokens, "ENCODED", 3)
    seen, run = [], coder.tokenizer.encode_batch

    class Counted:
        encode_batch = None

        def encode_batch_fast(self, group, **how):
            seen.append(len(group))
            return run(group, **how)

    again = tokens.Encoder("byte_bpe_50k.json", True)
    again.tokenizer = Counted()
    assert [x.tolist() for x in again.encode(texts)] == whole
    assert max(seen) <= 3


def test_words_go_to_the_library_many_at_a_time(monkeypatch):
    monkeypatch.setattr(tokens, "JOINED", 7)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    odd = ["don't", "l'homme", "naïve", "İstanbul", "İ.", "ŉ", "Ĳssel,", "straße!", "деньги$$$", "Ѐ,Ѡ", "漢字", "x9", "ǅ", "a.b,c", "end###", "é", "é", "a<|endoftext|>b", "A.<|startoftext|>", ""]
    texts = [" ".join(words), "\n".join(odd), " ".join(o + w for o, w in zip(odd, words)), "  ".join(w + o for o, w in zip(odd, words)), "plain"]
    plain = tokens.Encoder("word_bpe_49k.json", False)
    library = [plain.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    coder, seen = tokens.Encoder("word_bpe_49k.json", False), []
    run = coder.tokenizer.encode_batch_fast

    class Counted:
        encode_batch = None

        def encode_batch_fast(self, group, **how):
            seen.extend(group)
            return run(group, **how)

    coder.tokenizer = Counted()
    ids, lengths = coder.encode(pa.array(texts))
    ends = lengths.cumsum()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths)] == library
    assert len(seen) < len(words) // 2


def test_words_that_do_not_come_out_singly_are_encoded_one_by_one():
    coder = tokens.Encoder("word_bpe_49k.json", False)
    texts = pa.array(["some words of letters alone", "and more of them"])
    whole = [x.tolist() for x in coder.encode(texts)]
    again = tokens.Encoder("word_bpe_49k.json", False)
    again.closes[:] = False  # as of a vocabulary that drops what it does not know
    assert [x.tolist() for x in again.encode(texts)] == whole


def test_a_batch_leaves_no_unused_memory(monkeypatch):
    batch = pa.record_batch({"text": pa.array(["x" * 1000] * 10)})
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(len(seen))

    monkeypatch.setattr(tokens.pa, "default_memory_pool", Pool)
    seen = []
    for part in tokens.slices(batch, "text", 3000):
        seen.append(part.num_rows)
    assert sum(seen) == 10 and len(seen) >= 3
    assert freed == [len(seen)]


def test_packing_encodes_smaller_parts():
    assert packing.PART_BYTES <= tokens.BATCH_BYTES // 2
    long = pa.record_batch({"text": pa.array(["x" * (1 << 20)] * 16)})
    assert all(part.num_rows <= 5 for part in tokens.slices(long, "text", packing.PART_BYTES))
