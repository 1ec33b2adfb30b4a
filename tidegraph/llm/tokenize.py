"""Bulk encoding with the ``tokenizers`` library.

A text is cut at single spaces, each distinct piece of a chunk of texts is encoded once, and the ids
are put together again by index arithmetic. Both vocabularies that are used here split texts before
merging in a way that never reaches over such a cut; a text where it could (white space on both sides
of a cut) is encoded whole instead. The ids equal those of ``Tokenizer.encode`` on the whole text.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20
#: Pieces whose ids a worker remembers (about 150 bytes each); further ones are encoded anew in each chunk.
REMEMBERED = 600_000


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each; one longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield at, to
        at = to
    release()


def release() -> None:
    """Gives memory that is not in use back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


#: Words that NFC and lower-casing leave as they are: ASCII without capitals, and small letters of Latin-1.
SETTLED = re.compile(r"[!-@\[-`{-~\xdf-\xf6\xf8-\xff]*").fullmatch

_encoders: dict[str, "BulkEncoder"] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> "BulkEncoder":
    """The encoder of this process for a vocabulary file."""
    if path not in _encoders or _encoders[path].remembered != remembered:
        _encoders[path] = BulkEncoder(path, remembered)
    return _encoders[path]


class BulkEncoder:
    """Encodes arrays of texts, remembering the ids of the first ``REMEMBERED`` distinct pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A byte-level vocabulary without word ends: a piece takes the space before it.
        self.keeps_space = not getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: For white space dropped, NFC and lower case: the same without these, for words that they leave as they are.
        self.plain = None
        if not self.keeps_space and re.fullmatch(r".*NFC\(\).*Replace\(.*Lowercase\(\).*", str(self.tokenizer.normalizer), re.S):
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.lens = np.empty(0, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.plain:
            settled = [bool(SETTLED(w)) for w in words]
            if not all(settled) and any(settled):
                order = np.argsort(~np.array(settled), kind="stable")
                n = sum(settled)
                parts = [self._encode_words([words[i] for i in own]) for own in (order[:n], order[n:])]
                flat, lens = (np.concatenate(x) for x in zip(*parts))
                begin, back = np.cumsum(lens) - lens, np.argsort(order)
                per = lens[back]
                return flat[np.repeat(begin[back] - (np.cumsum(per) - per), per) + np.arange(len(flat))], per
        tokenizer = self.plain if self.plain and settled[0] else self.tokenizer
        got = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        which = got.word_ids
        if None in which:  # the string of a special token: its word is not told
            each = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(x) for x in each], np.int64)
        return np.array(got.ids, np.uint32), np.bincount(np.array(which, np.int64), minlength=len(words))

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids; begin and number of ids of each piece."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        words = [pieces[i] for i in new]
        flat, lens = self._encode_words(words)
        all_flat, all_lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
        at[new] = len(self.lens) + np.arange(len(new))
        room = self.remembered - len(self.known)
        if room > 0 and len(words):
            self.known.update(zip(words[:room], range(len(self.lens), len(self.lens) + min(room, len(words)))))
            self.lens = all_lens[: len(self.known)]
            self.flat = all_flat[: int(self.lens.sum())]
        begin = np.cumsum(all_lens) - all_lens
        return all_flat, begin[at], all_lens[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts, and the offsets of each text in them (one more than texts). Null: empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        if self.plain and not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))  # fewer distinct pieces; the same ids
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = coded.dictionary.to_pylist()
        n, bad = len(values), []
        if self.keeps_space:
            starts = first[:-1]
            heads, head_codes = np.unique(codes[starts], return_inverse=True)
            starts_blank = np.fromiter((not v or v[0].isspace() for v in values), bool, n)
            ends_blank = np.fromiter((not v or v[-1].isspace() for v in values), bool, n)
            unsafe = np.zeros(len(codes), bool)
            unsafe[1:] = starts_blank[codes[1:]] & ends_blank[codes[:-1]]
            unsafe[starts] = False
            bad = np.flatnonzero(np.add.reduceat(unsafe, starts))
            codes[starts] = n + head_codes
            values = [" " + v for v in values] + [values[h] for h in heads]
        flat, begin, lens = self._pieces(values)
        per = lens[codes]
        ends = np.concatenate([[0], np.cumsum(per)])
        gather = np.repeat((begin[codes] - ends[:-1]).astype(np.int32), per)  # a chunk has far fewer than 2^31 ids
        gather += np.arange(len(gather), dtype=np.int32)
        ids, offsets = flat[gather], ends[first]
        return self._whole(texts, ids, offsets, bad) if len(bad) else (ids, offsets)

    def _whole(self, texts, ids, offsets, rows) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for r in rows:
            parts[r] = np.array(self.tokenizer.encode(texts[int(r)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
