"""Token-id files: blocks under an adaptive context-mixing range coder.

A block holds up to 2**20 ids, starts from an empty model and carries check sums, so it is read without its neighbours.
Its ids are cut into equal lanes that are coded step by step together: every step codes one id of each lane with the
block's model, then the model learns them. The model predicts an id in three ways: the id last seen after the same two
ids (order 2), the one last seen after the same id (order 1), and adaptive frequencies of all ids (order 0). The
predictions are mixed with weights learned from how often they were right at the same confidence, and the mixture
drives a carry-less range coder. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.shared import shared_folder, stage
from boutline.llm.tokens import encode_documents, encoder, slices

MAGIC = b"TKM1"
BLOCK = 1 << 20
LANES, LANE_IDS = 8192, 64  # most lanes of a block, fewest ids of a lane
HEAD = struct.Struct("<4sIIIIIII")  # magic, ids, lanes, vocabulary, documents' bytes, payload bytes, crc of ids, crc of what follows
TOTAL_BITS = 27
TOTAL = 1 << TOTAL_BITS
LEAST_ORDER0 = 1 << 23  # of TOTAL; above the sum of order-0 counts, so that no id has width 0
MOST_COUNT = 1 << 22
GAIN = 32
EVERY = 4  # after the first steps, order-0 frequencies are renewed once in so many
SLOTS_BITS = 18  # order-2 contexts
# confidence after a wrong guess (first row) and a right one, by the confidence before
NEXT = np.array([[0, 0, 1, 1, 2, 2, 3, 3], [1, 2, 3, 4, 5, 6, 7, 7]], np.int32).ravel()
LOW32 = np.uint64(0xFFFFFFFF)
B32 = np.uint64(32)


class Model:
    """What encoder and decoder share: predictions of the next id of every lane, and learning."""

    def __init__(self, lanes: int, vocabulary: int):
        self.size = vocabulary
        self.counts = np.ones(vocabulary, np.int64)
        self.one = np.zeros(vocabulary + 1, np.int32)  # id and confidence 0-7 in one number
        self.two = np.zeros(1 << SLOTS_BITS, np.int32)
        self.right = np.tile(np.array([1, 1, 6], np.int64), (128, 1))
        self.before = np.full(lanes, vocabulary, np.int64)
        self.earlier = np.full(lanes, vocabulary, np.int64)
        self.seen: list[np.ndarray] = []
        self.step = 0
        self._frequencies()
        self._weights()

    def _frequencies(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.size) * GAIN
            self.seen = []
        if int(self.counts.sum()) > MOST_COUNT:
            self.counts = (self.counts + 1) >> 1
        self.below = np.zeros(self.size + 1, np.int32)
        np.cumsum(self.counts, out=self.below[1:])
        self.all = int(self.below[-1])

    def _weights(self) -> None:
        big = self.right.sum(axis=1) > 1 << 16
        if big.any():
            self.right[big] = (self.right[big] + 1) >> 1
        room = TOTAL - LEAST_ORDER0
        sums = self.right.sum(axis=1)
        self.weight2, self.weight1 = room * self.right[:, 0] // sums, room * self.right[:, 1] // sums

    def predict(self) -> None:
        self.slot = ((self.earlier * 0x9E3779B1 + self.before * 0x85EBCA6B) >> 9) & ((1 << SLOTS_BITS) - 1)
        self.entry1, self.entry2 = e1, e2 = self.one[self.before], self.two[self.slot]
        self.guess1, self.guess2 = (e1 >> 3).astype(np.int64), (e2 >> 3).astype(np.int64)
        self.sure1, self.sure2 = e1 & 7, e2 & 7
        self.kind = ((self.sure2 << 3) | self.sure1) + 64 * (self.guess1 == self.guess2)
        self.w1, self.w2 = self.weight1[self.kind], self.weight2[self.kind]
        self.w0 = TOTAL - self.w1 - self.w2

    def order0(self, ids: np.ndarray) -> np.ndarray:
        """Start of the ids' share of order 0."""
        return self.w0 * self.below[ids] // self.all

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.order0(ids), self.order0(ids + 1)
        at = start + self.w1 * (self.guess1 < ids) + self.w2 * (self.guess2 < ids)
        return at, end - start + self.w1 * (self.guess1 == ids) + self.w2 * (self.guess2 == ids)

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the given points, and those intervals."""
        start1, share1 = self.interval(self.guess1)
        start2, share2 = self.interval(self.guess2)
        past1, past2 = at >= start1 + share1, at >= start2 + share2  # the guess is smaller than the id
        is1, is2 = (at >= start1) & ~past1, (at >= start2) & ~past2
        ids = np.where(is1, self.guess1, self.guess2)
        start, share = np.where(is1, start1, start2), np.where(is1, share1, share2)
        rest = np.flatnonzero(~(is1 | is2))
        if len(rest):
            before = self.w1[rest] * past1[rest] + self.w2[rest] * past2[rest]
            point = ((at[rest] - before + 1) * self.all - 1) // self.w0[rest]
            order = np.argsort(point)  # points in order are found faster
            found = np.empty(len(rest), np.int64)
            found[order] = np.searchsorted(self.below, point[order].astype(np.int32), side="right") - 1
            w0 = self.w0[rest]
            low = w0 * self.below[found] // self.all
            ids[rest], start[rest] = found, low + before
            share[rest] = w0 * self.below[found + 1] // self.all - low
        return ids, start, share

    def learn(self, ids: np.ndarray) -> None:
        hit1, hit2 = self.guess1 == ids, self.guess2 == ids
        what = np.where(hit2, 0, 2 - hit1.view(np.int8))
        self.right += np.bincount(self.kind * 3 + what, minlength=384).reshape(128, 3)
        fresh = ids.astype(np.int32) << 3
        for table, place, entry, sure, hit in ((self.one, self.before, self.entry1, self.sure1, hit1), (self.two, self.slot, self.entry2, self.sure2, hit2)):
            case = sure + (hit.astype(np.int32) << 3)
            table[place] = np.where(case > 0, entry & -8, fresh) | NEXT[case]  # of lanes with the same place the last one counts
        self.earlier, self.before = self.before, ids
        self.seen.append(ids)
        self.step += 1
        if self.step < EVERY or self.step % EVERY == 0:
            self._frequencies()
        self._weights()


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // LANE_IDS))


def encode_ids(ids: np.ndarray) -> tuple[int, int, bytes]:
    """(lanes, vocabulary, payload) of a block's ids."""
    n = len(ids)
    lanes, size = _lanes(n), int(ids.max(initial=0)) + 1
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(lanes, size)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words, used = np.zeros((lanes, steps + 1), np.uint32), np.zeros(lanes, np.int64)
    for row in grid:
        model.predict()
        at, share = model.interval(row)
        unit = width >> np.uint64(TOTAL_BITS)
        low += unit * at.view(np.uint64)
        width = unit * share.view(np.uint64)
        short = np.flatnonzero(width >> B32 == 0)
        if len(short):
            x = low[short]
            rest = x & LOW32
            words[short, used[short]] = x >> B32
            used[short] += 1
            low[short] = rest << B32
            width[short] = np.minimum(width[short], LOW32 + np.uint64(1) - rest) << B32  # stay below the next upper half
        model.learn(row)
    words[np.arange(lanes), used] = (low + LOW32) >> B32
    used += 1
    flat = words[np.arange(words.shape[1])[None, :] < used[:, None]]
    return lanes, size, used.astype("<u2" if steps < 65535 else "<u4").tobytes() + flat.astype("<u4").tobytes()


def decode_ids(n: int, lanes: int, size: int, payload: bytes) -> np.ndarray:
    steps = -(-n // lanes) if n else 0
    kind = "<u2" if steps < 65535 else "<u4"
    used = np.frombuffer(payload, kind, lanes).astype(np.int64)
    flat = np.frombuffer(payload, "<u4", offset=lanes * np.dtype(kind).itemsize)
    words = np.zeros((lanes, int(used.max(initial=0)) + 3), np.uint64)
    words[np.arange(words.shape[1])[None, :] < used[:, None]] = flat
    model = Model(lanes, size)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    ahead = (words[:, 0] << B32) | words[:, 1]  # the code's distance from low
    place = np.full(lanes, 2, np.int64)
    grid = np.empty((steps, lanes), np.int64)
    most = np.uint64(TOTAL - 1)
    for step in range(steps):
        model.predict()
        unit = width >> np.uint64(TOTAL_BITS)
        ids, at, share = model.find(np.minimum(ahead // unit, most).view(np.int64))
        passed = unit * at.view(np.uint64)
        ahead -= passed
        low += passed
        width = unit * share.view(np.uint64)
        short = np.flatnonzero(width >> B32 == 0)
        if len(short):
            rest = low[short] & LOW32
            width[short] = np.minimum(width[short], LOW32 + np.uint64(1) - rest) << B32
            low[short] = rest << B32
            ahead[short] = (ahead[short] << B32) | words[short, place[short]]
            place[short] += 1
        grid[step] = ids
        model.learn(ids)
    return grid.T.reshape(-1)[:n].astype(np.uint32)


def block_bytes(ids: np.ndarray, docs: list[tuple[int | None, int, bool]]) -> bytes:
    """One block: its ids, and per document in it the id, the count of ids here, and whether the document goes on after it."""
    lanes, size, payload = encode_ids(ids)
    doc = np.array([d[0] or 0 for d in docs], "<i8").tobytes() + np.array([d[1] for d in docs], "<i8").tobytes()
    doc += bytes((d[0] is None) + 2 * d[2] for d in docs)
    doc = zlib.compress(doc)
    head = HEAD.pack(MAGIC, len(ids), lanes, size, len(doc), len(payload), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload, zlib.crc32(doc)))
    return head + doc + payload


def read_blocks(source) -> Iterator[tuple[np.ndarray, list[tuple[int | None, int, bool]]]]:
    """Blocks of an open file; raises ValueError for a damaged one."""
    while head := source.read(HEAD.size):
        magic, n, lanes, size, doc_len, len_, crc_ids, crc = HEAD.unpack(head)
        doc, payload = source.read(doc_len), source.read(len_)
        if magic != MAGIC or zlib.crc32(payload, zlib.crc32(doc)) != crc:
            raise ValueError("damaged block")
        ids = decode_ids(n, lanes, size, payload)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
            raise ValueError("a block's ids differ from their check sum")
        doc = zlib.decompress(doc)
        m = len(doc) // 17
        keys, counts, flags = np.frombuffer(doc, "<i8", m), np.frombuffer(doc, "<i8", m, 8 * m), doc[16 * m :]
        yield ids, [(None if f & 1 else k, c, bool(f & 2)) for k, c, f in zip(keys.tolist(), counts.tolist(), flags, strict=True)]


def write_files(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", leading: bool = False, folder: str | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into files in ascending order of doc_id; returns the stored list of files.

    Null texts are empty, null ids come first, rows of equal id are ordered by hash of text and text. Files have names of
    their own, so a repeated task does no harm; the list has path, first id and hash, documents, ids and bytes.
    """
    target = folder or shared_folder(docs.sparkSession, "tokens")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, leading)
        store, base = fs.FileSystem.from_uri(target)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.tok"
        held: list[np.ndarray] = []
        pending: list[tuple[int | None, int]] = []
        n_docs = n_ids = size = 0
        first = None
        out = None

        def flush(last: bool) -> None:
            nonlocal held, pending, size
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            while len(ids) >= BLOCK or (last and len(ids)):
                room, inside, rest = min(BLOCK, len(ids)), [], []
                left = room
                for doc, n in pending:
                    take = min(n, left)
                    left -= take
                    if take:
                        inside.append((doc, take, take < n))
                    if take < n:
                        rest.append((doc, n - take))
                pending = rest
                data = block_bytes(ids[:room], inside)
                out.write(data)
                size += len(data)
                ids = ids[room:]
            held = [ids]

        for batch in batches:
            for part in slices(batch, "text"):
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                ids, counts = encode_documents(part, coder)
                keys = part.column("doc_id").to_pylist()
                first = first or (keys[0], part.column("h")[0].as_py())
                held.append(ids)
                pending += list(zip(keys, counts.tolist(), strict=True))
                n_docs, n_ids = n_docs + len(keys), n_ids + len(ids)
                flush(False)
        if out is not None:
            flush(True)
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{target}/{name}"], "first_id": pa.array([first[0]], pa.int64()), "first_h": pa.array([first[1]], pa.int64()), "docs": [n_docs], "ids": [n_ids], "bytes": [size]}
            )

    return stage(rows.mapInArrow(write, "path string, first_id long, first_h long, docs long, ids long, bytes long"))


def read_files(files: DataFrame) -> DataFrame:
    """Per document: its id, ``start`` (ids of all documents before it), count and unsigned crc32 of its ids as 32-bit numbers."""
    before = Window.orderBy(F.asc_nulls_first("first_id"), "first_h").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))).select("path", "base")  # a row per file
    form = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(f["path"])
                at, n, crc = f["base"], 0, 0
                with store.open_input_stream(path, compression=None) as source:
                    for ids, docs in read_blocks(source):
                        data, pos, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                        for doc, count, goes_on in docs:
                            crc = zlib.crc32(data[4 * pos : 4 * (pos + count)], crc)
                            pos, n = pos + count, n + count
                            if not goes_on:
                                rows.append((doc, at, n, crc))
                                at, n, crc = at + n, 0, 0
                        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=form)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
