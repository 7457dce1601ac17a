"""Byte-level BPE ids of whole texts, with a cache of words that recur.

A byte-level tokenizer cuts a text into pieces and encodes every piece by itself, so
the ids of a piece can be kept. Texts are cut and their distinct words looked up by the
batch, as Arrow columns. Each Python worker keeps one cache for its lifetime.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids leave the encoder in this form.
ID_TYPE = np.dtype("<u4")
#: Bytes of words and ids that a worker keeps; a full cache starts anew with the words at hand.
CACHE_BYTES = 16 << 20
#: Bytes of text that are cut into words at once (a longer text is cut alone).
CHUNK_BYTES = 4 << 20
#: New words that are Python objects at once.
LOT_WORDS = 20_000
#: Pieces that a worker keeps besides words, and characters of a kept word or piece at most.
PIECE_ENTRIES, KEPT_CHARS = 20_000, 64
_PACK = [struct.Struct(f"<{n}I").pack for n in range(17)]


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class PieceEncoder:
    """Maps texts to their ids, as little-endian unsigned 32-bit integers.

    A word is what follows a space, up to the next space. A
    space that a non-space follows always starts a new piece, so that words
    are encoded independently; a word that doesn't begin with a non-space sends the
    whole text through the splitting pattern. Texts that hold a string of the added
    tokens go to the tokenizer itself, which knows how such strings are cut out, and so do all
    texts if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        import regex
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec["model"]["type"] == "BPE"
            and spec.get("normalizer") is None
            and spec.get("post_processor") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.forget()

    def forget(self) -> None:
        """Start with empty caches."""
        self.pieces: dict[str, bytes] = {}
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by the tokenizer's model, in one translation to its letters (no text has the byte 255)."""
        shown = b"\xff".join([x.encode() for x in pieces]).decode("latin-1").translate(self.letters).split(self.letters[0xFF])
        tokenize, pack = self.model.tokenize, _PACK
        found = ([t.id for t in tokenize(x)] for x in shown)
        return [pack[len(x)](*x) if len(x) < len(pack) else np.array(x, dtype=ID_TYPE).tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= PIECE_ENTRIES:
                self.pieces.clear()
            (ids,) = self._encoded([piece])
            if len(piece) <= KEPT_CHARS:
                self.pieces[piece] = ids
        return ids

    def _pieces(self, word: str) -> list[str]:
        """Pieces of a space and the word behind it."""
        if word.isalpha():
            return [" " + word]
        if word[-1] in ".,;:" and word[:-1].isalpha():
            return [" " + word[:-1], word[-1]]
        return self.split(" " + word)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a non-space; a piece that several have is encoded once."""
        pieces, ends = [], []
        for x in words:
            pieces += self._pieces(x)
            ends.append(len(pieces))
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self._encoded(distinct), strict=True)) if distinct else {}
        found = list(map(ids.__getitem__, pieces))
        return [found[s] if e == s + 1 else b"".join(found[s:e]) for s, e in zip([0, *ends], ends, strict=False)]

    def _whole(self, text: str) -> bytes:
        """Ids of a text that isn't cut into words."""
        if not self.by_piece or any(x in text for x in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype=ID_TYPE).tobytes()
        return b"".join(map(self._piece, self.split(text)))

    def _looked_up(self, words: pa.Array, used: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(table of ids, the place in it of every word, which words can't be encoded alone); other words than the used ones have any place."""
        found = pc.index_in(words, value_set=self.words)
        leads = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
        hard = np.array([not x or x.isspace() for x in leads.dictionary.to_pylist()], dtype=bool)[leads.indices.to_numpy()] & used
        kept = used & ~hard & (pc.utf8_length(words).to_numpy() <= KEPT_CHARS)
        there = found.is_valid().to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(~there & used & ~hard)
        places = np.maximum(np.cumsum(there) - 1, 0)
        places[missing] = there.sum() + np.arange(len(missing))
        new = words.take(pa.array(missing))
        lots = (new.slice(k, LOT_WORDS).to_pylist() for k in range(0, len(new), LOT_WORDS))
        ids = pa.concat_arrays([pa.array([], pa.large_binary()), *(pa.array(self._words(x), pa.large_binary()) for x in lots)])
        table = pa.concat_arrays([self.ids.take(found.drop_null()), ids])
        if self.words.nbytes + self.ids.nbytes > CACHE_BYTES:
            here = pa.array(kept)
            self.words, self.ids = words.filter(here), table.take(pa.array(places).filter(here))
        else:
            short = pa.array(kept[missing])
            self.words, self.ids = pa.concat_arrays([self.words, new.filter(short)]), pa.concat_arrays([self.ids, ids.filter(short)])
        return table, places, hard

    def _chunk(self, texts: pa.Array) -> Iterator[bytes]:
        hard = np.zeros(len(texts), dtype=bool)
        for x in self.added:
            hard |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        index = coded.indices.to_numpy()
        follows = np.ones(len(index), dtype=bool)  # a space; a text's first part is no word
        follows[bounds[:-1]] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[index[follows]] = True
        table, places, alone = self._looked_up(coded.dictionary, used)
        hard[np.searchsorted(bounds, np.flatnonzero(alone[index] & follows), "right") - 1] = True
        firsts = [b"" if y else b"".join(map(self._piece, self.split(x))) for x, y in zip(parts.values.take(pa.array(bounds[:-1])).to_pylist(), hard, strict=True)]
        at = places[index]
        at[bounds[:-1]] = len(table) + np.arange(len(texts))
        taken = pa.concat_arrays([table, pa.array(firsts, pa.large_binary())]).take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)[bounds]
        data = memoryview(taken.buffers()[2] or b"")
        for k, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            yield self._whole(texts[k].as_py()) if hard[k] else bytes(data[s:e])

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of every whole text; a null text is an empty one."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_piece:
            yield from (self._whole(x.as_py()) for x in texts)
            return
        chunk = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield from self._chunk(texts.slice(s, e - s))

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text."""
        return next(self.encode_all(pa.array([text], pa.string())))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
