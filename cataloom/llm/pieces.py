"""Batch encoding for token counts and token ids.

Where a tokenizer drops white space before it makes tokens, ASCII white space is a safe place to split a text: the tokens of the
text are those of its pieces, one after the other. Whether that holds is asked of the tokenizer itself when it is loaded; if not, and
for SentencePiece models, whole texts are encoded. A worker encodes each distinct piece once, in batches of about equal bytes, and
keeps the results in a bounded table; it never truncates, pads or adds special tokens.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterator

import numpy as np

from .common import word_spans

#: Bytes of text that are split into pieces at a time.
SEGMENT_BYTES = 1 << 20
#: Bytes of distinct pieces that one call of the tokenizer gets.
ENCODE_BYTES = 1 << 18
#: Pieces, and ids of them, that a worker keeps; the table starts anew beyond that.
KEPT_PIECES, KEPT_IDS = 1_500_000, 12_000_000
#: Words that a worker keeps, likewise.
KEPT_WORDS = 400_000

_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_MARKS = "".join(c for c in string.punctuation if c not in "'<>|")
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
#: A word of Latin letters and the marks behind it, which tokenizers with separate_words split there.
_WORD = re.compile(f"([{_LETTERS}]+)([{re.escape(_MARKS)}]*)")


class Encoder:
    """A tokenizer file of the tokenizers library (.json) or of SentencePiece (.model).

    drops_space tells that ASCII white space never becomes part of a token and ends each, separate_words that letters and marks
    are split from each other and letters lower-cased; both were found by asking the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.drops_space = self.separate_words = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.vocab_size()
            self.encode: Callable[[list[str]], list[list[int]]] = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.size = max(tokenizer.get_vocab(True).values(), default=-1) + 1
        self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if tokenizer.pre_tokenizer is None or any(c in _SPACES for t in tokenizer.get_added_tokens_decoder().values() for c in t.content):
            return
        normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        split = lambda text: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal(text))]
        alone = {x: split(x) for x in ("ab", "é", "7", "!?", "'s", "日", "́")}
        self.drops_space = all(split(f"{a}{c}{b}") == alone[a] + alone[b] for c in _SPACES for a in alone for b in alone) and not any(map(split, _SPACES))
        few = ["".join(p) for p in zip(_MARKS, _MARKS[1:] + _MARKS[0], strict=True)]
        lower = all(split(x) == split(x.lower()) and len(split(x)) == 1 for x in (*_LETTERS, _LETTERS))
        self.separate_words = self.drops_space and lower and all(split(f"ab{m}") == alone["ab"] + split(m) for m in few)


def grouped(texts: list[bytes], limit: int = SEGMENT_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Segments of the texts in groups of about limit bytes, with the place of the text of each."""
    owners: list[int] = []
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for part in segments(text, limit):
            owners.append(i)
            group.append(part)
            size += len(part)
            if size >= limit:
                yield owners, group
                owners, group, size = [], [], 0
    if group:
        yield owners, group


def segments(text: bytes, limit: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Parts of the text that end before white space and hold limit bytes each, or more where there is no white space."""
    at = 0
    while len(text) - at > limit:
        found = _SPACE.search(text, at + limit)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def _balanced(texts: list[str], limit: int) -> Iterator[list[str]]:
    batch: list[str] = []
    size = 0
    for t in texts:
        batch.append(t)
        size += len(t.encode())
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Pieces:
    """The worker's table of ids by piece, for one tokenizer. Pieces are told apart by 64-bit hashes."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.words: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.start, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        for batch in _balanced(sorted(texts, key=len), ENCODE_BYTES):
            for text, ids in zip(batch, self.encoder.encode(batch), strict=True):
                yield text, array("I", ids).tobytes()

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of new pieces: of the word and of its marks where a piece is such, else of the whole piece."""
        words, match = self.words, _WORD.fullmatch
        if len(words) > KEPT_WORDS:
            words.clear()
        texts = [p.decode("utf-8", "replace") for p in new]
        if self.encoder.separate_words:
            parts = [(m[1].lower(), m[2]) if (m := match(t)) else (t, "") for t in texts]
        else:
            parts = [(t, "") for t in texts]
        wanted = {x for pair in parts for x in pair}.difference(words)
        words.update(self._encode(list(wanted)))
        return [words[a] + words[b] if b else words[a] for a, b in parts]

    def _places(self, group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The table's place of each piece of the texts, and each text's first piece (one more at the end)."""
        joined, at, size, hashes, first = word_spans(group)
        distinct, where, piece = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        if not known.all():
            if len(self.hashes) > KEPT_PIECES or len(self.flat) > KEPT_IDS:
                self._clear()
                place, known[:] = np.zeros(len(distinct), np.int64), False
            of = where[~known]
            ids = self._learn([joined[a : a + n] for a, n in zip(at[of].tolist(), size[of].tolist(), strict=True)])
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            start = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), np.uint32)))
            put = place[~known]
            self.hashes, self.start, self.n = (np.insert(have, put, more) for have, more in ((self.hashes, distinct[~known]), (self.start, start), (self.n, n)))
            place = np.searchsorted(self.hashes, distinct)
        return place[piece], first

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The number of ids of each text."""
        return self._all(texts, False)[1]

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the number of ids of each."""
        return self._all(texts, True)

    def _all(self, texts: list[bytes], want: bool) -> tuple[np.ndarray, np.ndarray]:
        total, out = np.zeros(len(texts), np.int64), [np.empty(0, np.uint32)]
        if not self.encoder.drops_space:
            decoded = [t.decode("utf-8", "replace") for t in texts]
            found = dict(self._encode(list({*decoded})))
            parts = [found[t] for t in decoded]
            return np.frombuffer(b"".join(parts) if want else b"", np.uint32), np.array([len(p) // 4 for p in parts], np.int64)
        for owners, group in grouped(texts):
            place, first = self._places(group)
            n = self.n[place]
            ends = np.concatenate(([0], np.cumsum(n)))
            np.add.at(total, owners, np.diff(ends[first]))
            if want:
                out.append(self.flat[np.repeat(self.start[place] - ends[:-1], n) + np.arange(ends[-1])])
        return np.concatenate(out), total


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's table for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]
