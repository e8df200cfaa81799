"""Token ids of whole texts from a ``tokenizers`` vocabulary file.

Byte-pair vocabularies split a text into pieces and encode each piece by itself. For
byte-level vocabularies a batch of texts is cut into just these pieces, for others at
white space; Arrow dictionary-encodes the cuts, and the library encodes the distinct ones
that a worker does not remember. Texts with characters that ``NOT_SIMPLE`` finds (where
normalisation or character classes could make cuts matter) are encoded whole, and so are
texts that hold an added token of the vocabulary, which the library finds and gives its
one id. Vocabulary files are read where tasks run, from the path that is a parameter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

#: Any character for which texts are encoded whole.
NOT_SIMPLE = re.compile("[^\t\n\r -~\xa1-įı-ɏ]")
MAX_CHUNKS, MAX_CHARS = 500_000, 32
PUNCTUATION = ".,;:!?%&$*#|"
#: Byte-level vocabularies name the printable Latin-1 characters by themselves and the
#: other bytes, in order, from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Of a memory of pieces: bytes of texts for each piece that may stay, and times the pieces
#: of a batch (Arrow hashes the memory for each batch).
PIECE_BYTES, MEMORY_TIMES = 32, 16
LETTER, DIGIT, OTHER, SPACE, WHITE = range(5)


def _kind(c: str) -> int:
    return SPACE if c == " " else WHITE if c in "\t\n\r" else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER)


#: Of all characters that simple texts hold.
KINDS = np.array([_kind(chr(i)) for i in range(0x250)], np.uint8)


def piece_starts(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte (UTF-8) of simple texts that begin at ``starts``.
    Pieces are those of the byte-level pre-tokenizer:
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    kind, head = KINDS[text], np.zeros(len(text) + 3, bool)
    lead = np.flatnonzero(text >= 0xC0)
    kind[lead] = kind[lead + 1] = KINDS[(text[lead] & 31).astype(np.int64) << 6 | text[lead + 1] & 63]
    head[starts], head[len(text) :] = True, True
    white = kind >= SPACE
    cut = head.copy()
    cut[1 : len(text)] |= np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
    # The last of a run of white space goes to what follows, or stands alone.
    cut[: len(text) - 1] |= white[:-1] & ~white[1:] & ~head[1 : len(text)]
    at = np.flatnonzero((text == ord("'")) & cut[: len(text)])
    if len(at):
        a, b = (np.append(text, [0, 0, 0])[at + i] for i in (1, 2))
        one = at[np.isin(a, list(b"stmd")) & ~head[at + 1]]
        two = at[((np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & ~head[at + 1] & ~head[at + 2]]
        cut[one + 1] = cut[two + 1] = False
        cut[one + 2] = cut[two + 3] = True
    return cut[: len(text)]


class Pieces:
    """Pieces that a worker has met and their ids, in flat arrays that Arrow looks up:
    a tenth of the memory of a dictionary of strings."""

    def __init__(self):
        self.texts, self.sizes, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def ids(self, pieces: pa.StringArray, encode, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and numbers of ids of distinct pieces, and the ids that they are of.
        ``encode`` gives the ids of new pieces; up to about ``limit`` pieces stay."""
        at = pc.index_in(pieces, value_set=self.texts)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        new = pieces.filter(pa.array(missing))
        sizes, flat = encode(new.to_pylist())
        sizes, flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[missing] = len(self.texts) + np.arange(len(new))
        if len(self.texts) < MEMORY_TIMES * len(pieces):
            self.texts, self.sizes, self.flat = pa.concat_arrays([self.texts, new]), sizes, flat
        if len(self.texts) > limit or self.texts.nbytes + self.flat.nbytes > 2 * PIECE_BYTES * limit:
            self.__init__()
        return (np.cumsum(sizes) - sizes)[place], sizes[place], flat

_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """``added_as_text``: an added token's string in a text is text like any other."""

    def __init__(self, path: str, added_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before, normal = config["pre_tokenizer"] or {}, config["normalizer"]
        self.tokenizer.encode_special_tokens = added_as_text
        self.added = [] if added_as_text else [x["content"] for x in config.get("added_tokens") or []]
        self.config = config
        #: Cut into the vocabulary's own pieces; or at any white space, which is dropped.
        self.by_space = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None
        self.by_white = before.get("type") == "Sequence" and bool(config["model"].get("end_of_word_suffix")) and [x["type"] for x in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.model = self.tokenizer.model
        self.limit = MAX_CHUNKS
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.pieces = Pieces()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, many words a call (much cheaper than a call's result each)."""
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            e = self.tokenizer.encode(words[at : at + 1000], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            cut = 4 * np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=min(1000, len(words) - at)))
            out += [ids[a:z] for a, z in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
        return out

    def _remembered(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        known[""] = b""
        ids = list(map(known.get, chunks))
        # A letter or digit ends a piece where punctuation follows: both parts are pieces of many chunks.
        parts = {}
        for x, i in zip(chunks, ids, strict=True):
            if i is None:
                core = x.rstrip(PUNCTUATION)
                parts[x] = (core, x[len(core) :]) if len(core) < len(x) and core and core[-1].isalnum() else (x, "")
        new = [x for x in dict.fromkeys(y for pair in parts.values() for y in pair) if x and x not in known]
        long = [x for x in new if len(x) > MAX_CHARS]
        known.update(zip(new, self._words(new), strict=True))
        for x, (core, rest) in parts.items():
            if rest:
                known[x] = known[core] + known[rest]
        out = [known[x] if i is None else i for x, i in zip(chunks, ids, strict=True)] if parts else ids
        for x in {*long, *(x for x in parts if len(x) > MAX_CHARS)}:
            known.pop(x, None)
        return out

    def _new_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each piece, and all ids. A piece is what the library's
        pre-tokenizer would hand to its model, so the model is asked directly."""
        tokens, ids, ends = self.model.tokenize, array("I"), []
        for x in pieces:
            ids.extend([t.id for t in tokens(x.encode().decode("latin-1").translate(ALPHABET))])
            ends.append(len(ids))
        return np.diff(np.array(ends, np.int64), prepend=0), np.array(ids, "<u4")

    @staticmethod
    def _joined(start: np.ndarray, size: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of texts of which each has the parts before its end that no earlier one has."""
        end = np.cumsum(size)
        place = np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)
        raw = flat[place].tobytes()
        cut = (4 * np.append(0, end)[ends]).tolist()
        return [raw[a:z] for a, z in zip([0, *cut[:-1]], cut, strict=True)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of simple texts, cut as a byte-level vocabulary cuts them."""
        whole = pa.array(texts, pa.string())
        ends = np.frombuffer(whole.buffers()[1], np.int32, len(texts) + 1)
        text = np.frombuffer(whole.buffers()[2], np.uint8, ends[-1])
        cut = np.flatnonzero(piece_starts(text, ends[:-1])).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cut), pa.py_buffer(np.append(cut, ends[-1:])), whole.buffers()[2]).dictionary_encode()
        start, size, flat = self.pieces.ids(coded.dictionary, self._new_pieces, 2 * self.limit)
        code = coded.indices.to_numpy()
        return self._joined(start[code], size[code], flat, np.append(np.searchsorted(cut, ends[1:-1]), len(cut)))

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of simple texts, cut at white space."""
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = lists.values.dictionary_encode()
        code = coded.indices.to_numpy()
        ids = self._remembered(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return self._joined((np.cumsum(size) - size)[code], size[code], np.frombuffer(b"".join(ids), "<u4"), lists.offsets.to_numpy()[1:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole, cut = [], []
        for i, t in enumerate(texts):
            simple = (self.by_space or self.by_white) and not NOT_SIMPLE.search(t) and not any(x in (t.lower() if self.by_white else t) for x in self.added)
            if t:
                (cut if simple else whole).append(i)
        for own, way in ((whole, self._library), (cut, self._by_pieces if self.by_space else self._by_chunks)):
            chosen = [texts[i].lower() if self.by_white and own is cut else texts[i] for i in own]
            for a, z in slices(chosen, max(2_000_000, 10 * self.limit)):
                for i, ids in zip(own[a:z], way(chosen[a:z]), strict=True):
                    out[i] = ids
        return out


    def token_bytes(self) -> list[bytes]:
        """The bytes of each id of a byte-level vocabulary."""
        back = {chr(ALPHABET.get(b, b)): b for b in range(256)}
        known = self.config["model"]["vocab"]
        out = [b""] * (max([*known.values(), *(x["id"] for x in self.config.get("added_tokens") or [])]) + 1)
        for token, i in known.items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for x in self.config.get("added_tokens") or []:
            out[x["id"]] = x["content"].encode()
        return out


def encoder(path: str, added_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if (path, added_as_text) not in _encoders:
        _encoders[path, added_as_text] = Encoder(path, added_as_text)
    return _encoders[path, added_as_text]


def vocabulary(name: str) -> str:
    """Path of one of the installed public vocabulary files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
