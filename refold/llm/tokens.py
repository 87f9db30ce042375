"""Token ids of whole texts by the tokenizers library, piece by piece.

Both kinds of vocabulary split a text before any merge, and no split part runs across the places
where a text is cut here, so the ids of a text are the ids of its pieces in order. Arrow cuts a
batch of texts and finds the distinct pieces; the library encodes those that the memo lacks; numpy
lays the ids out. The tests hold this against the library on whole texts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces held in a memo; it starts afresh beyond that, which costs time and changes nothing.
MEMO = 300_000
#: Bytes of text worked on at a time.
SLICE = 8 << 20
#: Two characters in a row that any engine may take for white space.
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"


#: The visible character that byte-level vocabularies write for each byte.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_KEPT))}
#: Words that must come out alike before the model is asked directly.
_PROBES = ("a", "Hello", "THE", "été", "Straße", "ÜBUNG", "naïve", "internationalization", "ð", "Ĳ", "ǅ")


class _Memo(dict):
    """Piece -> its ids as little-endian uint32 bytes. lead: the blank that goes before each piece."""

    def __init__(self, tok, lead: str):
        self.tok, self.model, self.lead, self.folds = tok, tok.model, lead, tok.normalizer is not None
        self.mark = lead.translate(_SHOWN)
        self.stops = {c: self._one(c) for c in ".,"}
        self.direct = True
        self.direct = all(self._word(w) == self._one(lead + w) for w in _PROBES)

    def of(self, pieces: list[str]) -> list[bytes]:
        if len(self) >= MEMO:
            self.clear()
        for p in pieces:
            if p in self:
                continue
            s = p[:-1]
            if p[-1:] in self.stops and s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha()):
                # letters and what follows them are split before any merge
                if s not in self:
                    self[s] = self._word(s)
                self[p] = self[s] + self.stops[p[-1]]
            else:
                self[p] = self._word(p) if p.isalpha() else self._one(self.lead + p)
        return list(map(self.__getitem__, pieces))

    def _one(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word of letters is one part of the split: the model merges it without the steps before."""
        plain = word
        if self.folds:
            plain = word.lower() if word.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", word))
        if not self.direct or not word.isascii() and (max(plain) > "ɏ" or not plain.isalpha()):
            return self._one(self.lead + word)
        if not plain.isascii():
            plain = plain.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(self.mark + plain)]).tobytes()


class Encoder:
    """keeps_blanks: the vocabulary encodes white space (byte-level); else it drops it, and every
    blank is a place to cut. No special tokens are added; a text that holds the string of one goes to
    the library whole, which gives it that token's id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.added = "|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values())
        self.top = tok.get_vocab_size() - 1
        self.keeps_blanks = bool(tok.encode(" ", add_special_tokens=False).ids)
        self.plain, self.spaced = _Memo(tok, ""), _Memo(tok, " ")
        self.newline = self.plain._one("\n")

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets: text k has ids[offsets[k]:offsets[k + 1]]). Nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        # a blank belongs to the piece after it where blanks count: runs of white space can't be cut there
        whole = "|".join(x for x in (self.added, _RUN if self.keeps_blanks else "") if x)
        alone = pc.match_substring_regex(texts, whole).to_numpy(zero_copy_only=False) if whole else np.zeros(len(texts), bool)
        cut = pc.replace_substring(pc.if_else(pa.array(alone), "", texts), "\n", " \n" if self.keeps_blanks else " ")
        pieces = pc.split_pattern(cut, " ")
        first = pieces.offsets.to_numpy().astype(np.int64)
        first, last = first[:-1] - first[0], int(first[-1] - first[0])
        coded = pieces.flatten().dictionary_encode()
        place, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.to_pylist()
        if self.keeps_blanks:
            # with no runs of white space, a line feed is a part of its own before a visible character
            lines = iter(self.plain.of([w[1:] for w in words if w[:1] == "\n"]))
            spaced = iter(self.spaced.of([w for w in words if w[:1] != "\n"]))
            known = [self.newline + next(lines) if w[:1] == "\n" else next(spaced) for w in words]
            heads = coded.dictionary.take(pa.array(place[first])).to_pylist()
            place[first] = len(known) + np.arange(len(first))
            known += self.plain.of(heads)
        else:
            known = self.plain.of(words)
        for k in np.flatnonzero(alone).tolist():  # its one piece is the empty one at first[k]
            place[first[k]] = len(known)
            known.append(self.plain._one(texts[k].as_py()))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table, start = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        n = size[place]
        upto = np.cumsum(n)
        take = np.repeat((start[place] - (upto - n)).astype(np.int32), n)  # a text has under 2**31 ids
        take += np.arange(len(take), dtype=np.int32)
        return table[take], np.concatenate([[0], upto[np.append(first[1:], last) - 1]])


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    return Encoder(path)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about SLICE bytes of the column, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
