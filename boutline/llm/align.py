"""Alignment of the tokens of two tokenizers over the same bytes.

Every token ends at some byte. The byte ends of both tokenizers go into dictionaries from end to token index; the ends
that both have, in order, slice both id lists into groups, and all pairs of a group are linked. Prose repeats its words,
so a text is first cut where both tokenizers always cut (before a single space or line end inside other characters), a
worker remembers the pieces it meets most, and a text's groups are those of its pieces one after another. New pieces are
joined again to lines for the tokenizers. A worker lives on beside the engine after its last text, so what it remembers
and the text it works on at once are kept small.

How many documents hold a pair is counted over all documents. Frequent pairs are few by arithmetic (fewer than
``MOST_FREQUENT`` pairs can each have more than that share of all rows), so they go to every task; the others are joined
by their ids, and none of them is hot.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutline.llm.shared import fresh, stage
from boutline.llm.tokens import slices

SPACE_MARK = "▁"
MOST_FREQUENT = 50_000
PIECES_KEPT = 150_000  # distinct pieces that a worker remembers before it forgets rare ones
LINKS_KEPT = 5  # times as many links
PIECES_AT_ONCE = 8192
JOINED = 256  # pieces given to the tokenizers as one line
TEXT_AT_ONCE = 1 << 20  # bytes of texts that a worker aligns at once
LONG_GROUP = 64  # links of a group that are listed one by one
_BLANK = r"\s\x1c-\x1f\x85"
_CUT = re.compile(rf"(?<=[^{_BLANK}])(?=[ \n][^{_BLANK}])")
_TWO = re.compile(rf"[{_BLANK}]{{2}}")
_PLAIN = re.compile(rf"\n?[^{_BLANK}{SPACE_MARK}]+")  # names of pieces that are cut again where they are joined
_aligners: dict[tuple[str, str], Aligner] = {}

LINK = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])
ALIGNED = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups", T.StringType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
    ]
)


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as one letter: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the bytes spelled as themselves
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces_of(text: str) -> list[str]:
    """Names of the pieces of the space and ``text``: without the space before a word; other pieces keep it."""
    if text[0] not in " \n" and text[-1] not in " \n" and not _TWO.search(text):
        return text.replace("\n", " \n").split(" ")
    return [p[1:] if p[0] == " " and p[1:2].strip() else p for p in _CUT.split(" " + text)]


def groups_of(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends that both lists have, in order, and how many a and b tokens lie up to each; the lists end at the same byte."""
    a_index = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))
    b_index = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    upto = [np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in (a_index, b_index)]
    return np.array(common, np.int64), *upto


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of spans one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class Pieces:
    """Alignments of some texts: counts (n_a, n_b, n_groups, n_links; zeros if the bytes differ), spelled groups, and links."""

    counts: np.ndarray
    spelled: list[str]
    pairs: np.ndarray  # a << 32 | b
    times: np.ndarray  # how often each is linked
    start: np.ndarray  # of each text's links, and the end


class Aligner:
    """Aligns texts for one pair of vocabularies and remembers the pieces it has seen."""

    def __init__(self, a_vocabulary: str, b_vocabulary: str):
        import sentencepiece
        from tokenizers import Tokenizer

        def place(name: str) -> str:
            if os.path.sep in name:
                return name
            import public_tokenizers

            return public_tokenizers.path(name)

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.a = Tokenizer.from_file(place(a_vocabulary))
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(b_vocabulary))
        spell = byte_of_letter()
        tokens = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(spell.get(c, 0) for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.words = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.words += [f"{i}{end}" for i in range(len(pieces)) for end in (",", ";", "")]
        # cuts are safe if no piece goes on after a space and none holds a line end
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in pieces)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.spelled: list[str] = []
        self.counts = np.empty((4, 1 << 12), np.int64)
        self.met = np.zeros(1 << 12, np.int64)
        self.pairs = np.empty(1 << 14, np.int64)
        self.times = np.empty(1 << 14, np.int64)
        self.start = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces that were met again, the most frequent ones up to half of the room; their counts are halved."""
        known, spelled, counts, met, pairs, times = list(self.known), self.spelled, self.counts, self.met, self.pairs, self.times
        size, start = np.diff(self.start), self.start
        often = np.argsort(-met[: len(known)], kind="stable")
        often = often[met[often] > 1][: PIECES_KEPT // 2]
        at = np.sort(often[np.cumsum(size[often]) <= LINKS_KEPT * PIECES_KEPT // 2])
        self._reset()
        place = _spans(start[at], size[at])
        kept = Pieces(counts[:, at], [spelled[i] for i in at.tolist()], pairs[place], times[place], _offsets(size[at]))
        self._remember([known[i] for i in at.tolist()], kept)
        self.met[: len(at)] = met[at] // 2

    def _b_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space (which the model adds by itself) or a line end."""
        coded = self.b.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        return [ids if t[:1] == " " else ids[1:] for t, ids in zip(texts, coded, strict=True)]

    def _aligned(self, texts: list[str], joined: int = 1) -> Pieces:
        """Alignments of texts that begin with a space or a line end and are not empty, as one stream of bytes.

        So many texts are ``joined`` to a line if both tokenizers cut between them. If that does not show, each is a line.
        """
        run = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        lines = ["".join(texts[i : i + joined]) for i in range(0, len(texts), joined)]
        raw = [t.encode() for t in lines]
        a, b = [e.ids for e in run(lines, add_special_tokens=False)], self._b_ids(lines)
        back = lambda ids, spelled: b"".join(map(spelled.__getitem__, ids))
        good = np.ones(len(lines), bool)
        for ids, spelled in ((a, self.a_bytes), (b, self.b_bytes)):
            good &= np.fromiter((back(x, spelled) == r for x, r in zip(ids, raw, strict=True)), bool, len(lines))
        if not good.all():
            if joined > 1:
                return self._aligned(texts)
            a, b, raw = ([x for x, g in zip(rows, good.tolist(), strict=True) if g] for rows in (a, b, raw))
        of_a, of_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, of_a), (b, of_b)))
        if joined > 1:
            raw, good = [t.encode() for t in texts], np.ones(len(texts), bool)
        text_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        a_ends, b_ends = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        if joined > 1:
            upto = [np.searchsorted(ends, text_ends, "right") for ends in (a_ends, b_ends)]
            if any((ends[n - 1] != text_ends).any() for ends, n in zip((a_ends, b_ends), upto, strict=True)):
                return self._aligned(texts)
            of_a, of_b = (np.diff(n, prepend=0) for n in upto)
        ends, a_to, b_to = groups_of(a_ends.tolist(), b_ends.tolist())
        a_in, b_in = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        a_from, b_from = a_to - a_in, b_to - b_in
        owner = np.searchsorted(text_ends, ends)

        n_groups = np.bincount(owner, minlength=len(raw))
        n_links = np.bincount(owner, a_in * b_in, minlength=len(raw)).astype(np.int64)  # whole below 2^53
        counts = np.zeros((4, len(texts)), np.int64)
        counts[:, good] = of_a, of_b, n_groups, n_links

        code = np.empty(len(ids_a) + len(ids_b), np.int64)  # every token with the mark behind it, groups in order
        last = np.zeros(len(ids_a), np.int64)
        last[a_to - 1] = 1
        code[np.arange(len(ids_a)) + np.repeat(b_from, a_in)] = 2 * ids_a + last
        last = np.zeros(len(ids_b), np.int64)
        last[b_to - 1] = 1
        last[np.cumsum(of_b) - 1] = 2
        code[np.arange(len(ids_b)) + np.repeat(a_to, b_in)] = 2 * len(self.a_bytes) + 3 * ids_b + last
        words, bounds = list(map(self.words.__getitem__, code.tolist())), _offsets(of_a + of_b).tolist()
        rows = iter(["".join(words[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)])
        spelled = [next(rows) if g else "" for g in good.tolist()]

        pairs, times, whose = self._links(ids_a, ids_b, a_from, a_in, b_from, b_in, owner)
        sizes = np.zeros(len(texts), np.int64)
        sizes[good] = np.bincount(whose, minlength=len(raw))
        return Pieces(counts, spelled, pairs, times, _offsets(sizes))

    @staticmethod
    def _links(ids_a, ids_b, a_from, a_in, b_from, b_in, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of each group, by owner; in long groups equal pairs are counted instead of listed."""
        many = a_in * b_in
        listed = np.where(many <= LONG_GROUP, many, 0)
        group = np.repeat(np.arange(len(many)), listed)
        at = np.arange(len(group)) - np.repeat(np.cumsum(listed) - listed, listed)
        pairs = [ids_a[a_from[group] + at // b_in[group]] << 32 | ids_b[b_from[group] + at % b_in[group]]]
        times, whose = [np.ones(len(group), np.int64)], [owner[group]]
        for g in np.flatnonzero(many > LONG_GROUP).tolist():
            a, n = np.unique(ids_a[a_from[g] : a_from[g] + a_in[g]], return_counts=True)
            b, m = np.unique(ids_b[b_from[g] : b_from[g] + b_in[g]], return_counts=True)
            pairs.append((a[:, None] << 32 | b[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
            whose.append(np.full(len(a) * len(b), owner[g]))
        pairs, times, whose = map(np.concatenate, (pairs, times, whose))
        if len(many) and (many > LONG_GROUP).any():
            order = np.argsort(whose, kind="stable")
            pairs, times, whose = pairs[order], times[order], whose[order]
        return pairs, times, whose

    def _remember(self, pieces: list[str], found: Pieces) -> None:
        first, begin, end = len(self.spelled), int(self.start[-1]), int(self.start[-1] + found.start[-1])
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.spelled += found.spelled
        while len(self.spelled) > len(self.met):
            self.counts = np.concatenate([self.counts, np.empty_like(self.counts)], axis=1)
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        while end > len(self.pairs):
            self.pairs, self.times = (np.concatenate([x, np.empty_like(x)]) for x in (self.pairs, self.times))
        self.counts[:, first : len(self.spelled)] = found.counts
        self.pairs[begin:end], self.times[begin:end] = found.pairs, found.times
        self.start = np.concatenate([self.start, begin + found.start[1:]])

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces of these names; new ones are aligned first."""
        place = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(place < 0)
        missed = [pieces[i] for i in at.tolist()]
        plain: dict[bool, list[str]] = {True: [], False: []}
        for p in dict.fromkeys(missed):
            plain[_PLAIN.fullmatch(p) is not None].append(p)
        for is_plain, new in plain.items():
            for i in range(0, len(new), PIECES_AT_ONCE):
                some = new[i : i + PIECES_AT_ONCE]
                spelled = [p if p[0] in " \n" else " " + p for p in some]
                self._remember(some, self._aligned(spelled, JOINED if is_plain and self.cuts else 1))
        place[at] = np.fromiter(map(self.known.__getitem__, missed), np.int64, len(missed))
        self.met[: len(self.spelled)] += np.bincount(place, minlength=len(self.spelled))
        return place

    def align(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """Per text: counts, spelled groups, distinct pairs (a << 32 | b) and how often each is linked."""
        none = ((0, 0, 0, 0), "", np.empty(0, np.int64), np.empty(0, np.int64))
        if len(self.known) > PIECES_KEPT or self.start[-1] > LINKS_KEPT * PIECES_KEPT:
            self._forget()
        cut = [(pieces_of(t) if self.cuts else [" " + t]) if t else [] for t in texts]
        bounds = _offsets(np.fromiter(map(len, cut), np.int64, len(cut))).tolist()
        place = self._learn(list(chain.from_iterable(cut)))
        del cut
        for text, x, y in zip(texts, bounds, bounds[1:], strict=False):
            if x == y:
                yield none
                continue
            at = place[x:y]
            own = self.counts[:, at]
            if (own[0] == 0).any():  # the bytes of a piece differ: compare the whole text
                whole = self._aligned([" " + text])
                own, spelled, pairs, times = whole.counts, whole.spelled[0], whole.pairs, whole.times
            else:
                spelled = ";".join(map(self.spelled.__getitem__, at.tolist()))
                where = _spans(self.start[at], self.start[at + 1] - self.start[at])
                pairs, times = self.pairs[where], self.times[where]
            distinct, where = np.unique(pairs, return_inverse=True)
            yield tuple(own.sum(axis=1).tolist()), spelled, distinct, np.bincount(where, times, len(distinct)).astype(np.int64)


def aligner(a_vocabulary: str, b_vocabulary: str) -> Aligner:
    """One aligner per worker process, so that its memory of pieces serves many tasks."""
    key = (a_vocabulary, b_vocabulary)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _column(rows: list[tuple], spell: bool) -> pa.Array:
    counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 4)
    bounds = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
    pair = np.concatenate([np.empty(0, np.int64), *(r[2] for r in rows)])
    times = np.concatenate([np.empty(0, np.int64), *(r[3] for r in rows)])
    link = pa.StructArray.from_arrays(
        [pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(times)], ["a", "b", "n"]
    )
    digests = [hashlib.sha256(r[1].encode()).hexdigest() if r[1] else "" for r in rows]
    spelled = pa.array([r[1] for r in rows], pa.string()) if spell else pa.nulls(len(rows), pa.string())
    fields = [*[pa.array(counts[:, i]) for i in range(4)], spelled, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(bounds), link)]
    return pa.StructArray.from_arrays(fields, ALIGNED.names)


def aligned(
    docs: DataFrame, column: str = "text", a_vocabulary: str = "byte_bpe_50k.json", b_vocabulary: str = "piece_bpe_32k.model", spell: bool = True
) -> DataFrame:
    """``docs`` with one more column at the end: a struct of the text's alignment.

    It holds the numbers of tokens, groups and links, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of both tokenizers in order;
    left null unless ``spell``), its SHA-256 and ``links``: each linked id pair with its number of occurrence pairs.
    Texts that are null or empty, or whose token bytes do not give the space and text back, have no tokens: zeros, and
    empty strings and lists. Rows are handled one by one: repeated rows, null ids and extra columns of any name come
    back as they are, an empty table gives an empty table, and a very long text is worked on alone.
    """
    (name,) = fresh(docs, "alignment")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_vocabulary, b_vocabulary)
        for batch in batches:
            for part in slices(batch, column, TEXT_AT_ONCE):
                rows = list(tool.align(pc.fill_null(part.column(column), "").to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, _column(rows, spell)], [*part.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, ALIGNED)]))


def pair_documents(rows: DataFrame, alignment: str) -> DataFrame:
    """How many documents hold each linked pair: a, b, documents, and whether that is the most of its a (ties included)."""
    pairs = rows.select(F.explode(F.col(alignment)["links"]).alias("link")).select("link.a", "link.b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("documents"))
    most = Window.partitionBy("a")  # at most as many rows as the other vocabulary has ids
    return counted.withColumn("is_best", F.col("documents") == F.max("documents").over(most))


def with_support(rows: DataFrame, alignment: str) -> DataFrame:
    """Rows of ``aligned`` with two more columns: links whose pair is the best of its a, and the documents of all links.

    ``rows`` is stored once and read several times, so drop texts that are not needed before. The new columns are the
    last two. Rows without links get zeros; every row counts as a document of its own, also with a repeated or null id.
    """
    row, n_best, count_sum = fresh(rows, "row", "n_best", "count_sum")
    kept = stage(rows.withColumn(row, F.monotonically_increasing_id()))  # numbers are fixed once they are stored
    counts = stage(pair_documents(kept, alignment))
    total = counts.agg(F.sum("documents").alias("n")).first()["n"] or 0
    frequent = F.col("documents") > F.lit(total // MOST_FREQUENT)
    links = kept.select(F.col(row).alias("row"), F.explode(F.col(alignment)["links"]).alias("link")).select("row", "link.*")

    def sums(known: DataFrame) -> DataFrame:
        best: Column = F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0))
        return known.groupBy("row").agg(best.alias(n_best), F.sum(F.col("n") * F.col("documents")).alias(count_sum))

    hot = F.broadcast(counts.where(frequent))  # fewer than MOST_FREQUENT rows: their documents add up to ``total`` at most
    some = sums(links.join(hot, ["a", "b"]))
    rest = sums(links.join(hot, ["a", "b"], "left_anti").join(counts.where(~frequent), ["a", "b"]))
    both = some.unionByName(rest).groupBy("row").agg(F.sum(n_best).alias(n_best), F.sum(count_sum).alias(count_sum))
    zero = F.lit(0).cast("long")
    out = kept.join(both.withColumnRenamed("row", row), row, "left").drop(row)
    return out.withColumns({n_best: F.coalesce(n_best, zero), count_sum: F.coalesce(count_sum, zero)})
