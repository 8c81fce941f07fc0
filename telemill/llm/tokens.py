"""Token ids of many texts by the tokenizers library, each distinct chunk of text encoded once per worker.

White space always ends a token of the word vocabulary and case is dropped, so a text's ids are the ids of its
lower-case, blank-separated chunks in turn.  Chunks of plain letters and punctuation go to the library's model
word by word; every other chunk goes through the library's whole path.  A text in which Python and the library
might see different white space or lower case is encoded whole.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np

VOCABULARY = "word_bpe_49k.json"

_PLAIN = re.compile(r"([.,;:!?|%$&*#()]*)([a-zß-öø-ÿ]*)([.,;:!?|%$&*#()]*)")
_MARKS = frozenset(".,;:!?|%$&*#()")
#: White space to one of the two sides only, the start of a special token, letters with two lower-case forms.
_DOUBTFUL = (*map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B, 0xFEFF)), "<|", "Σ", "İ")
#: The byte-level alphabet: bytes that are no printable character of Latin-1 are shown as those from 256 on, in order.
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b < 33 or 126 < b < 161 or b == 173)}
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, room: int = 800_000) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if (path, room) not in _ENCODERS:
        _ENCODERS[path, room] = Encoder(path, room)
    return _ENCODERS[path, room]


class Encoder:
    """Encodes lists of texts.  ``room`` bounds the chunks remembered; a full memory starts anew."""

    def __init__(self, path: str, room: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary_size = self.library.get_vocab_size()
        self.room = room
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _piece(self, text: str) -> tuple[int, ...]:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(_SHOWN)
        ids = tuple(t.id for t in self.library.model.tokenize(shown))
        if len(self.pieces) >= self.room:
            self.pieces.clear()
        self.pieces[text] = ids
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a lower-case chunk that is more than an ASCII word."""
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            return tuple(self.library.encode(chunk, add_special_tokens=False).ids)
        ids: tuple[int, ...] = ()
        for part in plain.groups():
            if part:
                ids += self.pieces.get(part) or self._piece(part)
        return ids

    def _learn(self, chunks: list[str]) -> None:
        known, piece = self.pieces.get, self._piece
        found = []
        for chunk in chunks:
            if chunk.isascii():
                if chunk.isalpha():
                    found.append(known(chunk) or piece(chunk))
                    continue
                word, mark = chunk[:-1], chunk[-1]
                if word.isalpha() and mark in _MARKS:
                    found.append((known(word) or piece(word)) + (known(mark) or piece(mark)))
                    continue
            found.append(self._chunk(chunk))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        base = len(self.flat)
        self.rows.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(found))))
        self.starts = np.concatenate([self.starts, base + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit, without special tokens."""
        out: list[np.ndarray] = []
        group: list[tuple[int, list[str]]] = []
        size = 0
        for text in texts:
            if any(mark in text for mark in _DOUBTFUL):
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            out.append(np.zeros(0, np.uint32))
            words = text.lower().split()
            group.append((len(out) - 1, words))
            size += len(words)
            if size >= 1 << 18:
                self._flush(group, out)
                group, size = [], 0
        self._flush(group, out)
        return out

    def _flush(self, group: list[tuple[int, list[str]]], out: list[np.ndarray]) -> None:
        counts = np.array([len(w) for _, w in group], np.int64)
        total = int(counts.sum()) if group else 0
        if not total:
            return
        if len(self.rows) > self.room:
            self._forget()
        words = list(chain.from_iterable(w for _, w in group))
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, total)
        missing = np.nonzero(rows < 0)[0]
        if len(missing):
            self._learn(list({words[i] for i in missing}))
            get = self.rows.__getitem__
            rows[missing] = [get(words[i]) for i in missing]
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        ids = self.flat[at]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        for (k, _), a, b in zip(group, cuts[:-1], cuts[1:]):
            out[k] = ids[a:b]
