"""Whole texts to token ids with public vocabularies.

Prose repeats its words, so a batch is cut at single spaces and line ends, distinct pieces are encoded once by the
tokenizers library, and the ids of the texts are gathered from them. Cuts lie only where the tokenizer's own rules cut
as well; texts with other runs of white space go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 2
PIECES_KEPT = 1_000_000  # distinct pieces a worker remembers before it starts anew
BATCH_BYTES = 8 << 20
ENCODED = 4096  # texts given to the library at once: its results are much larger than their ids
JOINED = 256  # words given to it as one text
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTER = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}\x{400}-\x{481}"  # not U+0130
_MARKS = ".,!?:;#$%&*+()/@~"  # none that a name of a special token holds
_WORD = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), _LETTER) + "]+")
_WHOLE = _BLANK + "{2}|\\x01"
_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """``leading``: a space belongs to the word after it (byte-level vocabularies); else white space is dropped."""

    def __init__(self, vocabulary: str, leading: bool):
        from tokenizers import Tokenizer

        if os.path.sep not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.leading = leading
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cut = f"([{_LETTER}])([{''.join(m for m in _MARKS if m not in special)}])"
        suffix = None if leading else getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = None  # by id: whether the token ends a word
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.start = np.zeros(1, np.int64)

    def _encode(self, texts: list[str], most: int | None = None) -> list[list[int]]:
        most = most or ENCODED
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for i in range(0, len(texts), most) for e in run(texts[i : i + most], add_special_tokens=False)]

    def _spell(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the texts, their ids in this order, and how many each has.

        Where tokens tell that they end a word, texts of letters alone, which are a word each, go to the library many at a
        time with blanks between them. A group whose words do not come out as many as went in is encoded text by text.
        """
        order: list[int] = []
        found, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        odd = list(range(len(texts)))
        if self.closes is not None:
            words = [_WORD.fullmatch(t) is not None for t in texts]
            plain, odd = list(compress(odd, words)), [i for i, w in enumerate(words) if not w]
            groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
            joined = [" ".join([texts[i] for i in g]) for g in groups]
            for group, ids in zip(groups, self._encode(joined, max(1, ENCODED // JOINED)), strict=True):
                ids = np.array(ids, np.int32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(group) or ends[-1] != len(ids):
                    odd += group
                    continue
                order += group
                found.append(ids)
                sizes.append(np.diff(ends, prepend=0))
        coded = self._encode([texts[i] for i in odd])
        sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
        found.append(np.fromiter(chain.from_iterable(coded), np.int32, int(sizes[-1].sum())))
        return order + odd, np.concatenate(found), np.concatenate(sizes)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > PIECES_KEPT:
            self._reset()
        place = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(place < 0)
        if len(at):
            new = [pieces[i] for i in at.tolist()]
            if self.leading:
                spelled = [p[1:] if p[:1] == "\x01" else p if p[:1] == "\n" else " " + p for p in new]
            else:
                spelled = new
            order, coded, lengths = self._spell(spelled)
            ends = self.start[-1] + np.cumsum(lengths)
            while ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[self.start[-1] : ends[-1]] = coded
            numbers = len(self.start) - 1 + np.arange(len(at))
            place[at[order]] = numbers
            self.start = np.concatenate([self.start, ends])
            self.known.update(zip([new[i] for i in order], numbers.tolist(), strict=True))
        return place

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.leading:
            texts = pc.binary_join_element_wise("\x01", pc.replace_substring(texts, "\n", " \n"), "")
        else:
            # a letter and the mark after it are never one token here, if the letter's lower-case form ends with a letter
            if self.lowers:  # fewer distinct pieces; names of special tokens count only as they are written
                texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
            texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), self.cut, r"\1 \2")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        place = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        begin = self.start[place]
        lengths = self.start[place + 1] - begin
        at = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(begin - at[:-1], lengths) + np.arange(at[-1])]
        bounds = at[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
        return ids, np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many of them each text has (texts must not be null)."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if not self.leading:
            return self._pieces(texts)
        whole = pc.match_substring_regex(texts, _WHOLE)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(odd):
            return self._pieces(texts)
        ids, lengths = self._pieces(pc.if_else(whole, "", texts))
        coded = self._encode(pc.filter(texts, whole).to_pylist())
        at = np.cumsum(lengths)[odd]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.insert(ids, np.repeat(at, sizes), np.fromiter((x for c in coded for x in c), np.int32, int(sizes.sum())))
        lengths[odd] = sizes
        return ids, lengths


def encoder(vocabulary: str, leading: bool) -> Encoder:
    """One encoder per worker process, so that its memory of pieces serves many tasks."""
    key = (vocabulary, leading)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES):
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own.

    After a batch what Arrow holds without using it goes back: a worker lives on, with other work, beside others and the JVM.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def encode_documents(part: pa.RecordBatch, coder: Encoder, column: str = "text", end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a part's documents, each closed by ``end``, and their counts; a null text is empty."""
    texts = pc.fill_null(part.column(column), "")
    ids, lengths = coder.encode(pa.concat_arrays([texts]))
    return np.insert(ids, np.cumsum(lengths), end).astype(np.uint32), lengths + 1
