"""Token ids of whole texts, with a bounded cache of words and word pieces.

The vocabulary lower-cases, drops white space and splits into runs of letters, single digits and
runs of other signs before it merges, so a text's ids are the ids of those pieces one after another.
A worker keeps what it has seen, up to a limit in bytes, and asks the library's model only for new pieces. Many texts at
once are cut into pieces as one array of bytes, and each distinct piece is looked up once. Texts with characters at or above U+0300, with characters that lower() takes there, or with the strings of
special tokens take the library's whole path.

Defined cases: null and empty texts and texts of white space have no ids; a text may be of any length.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters below this are their own NFC form, and lower() maps them as the vocabulary's normaliser does.
_PLAIN = 0x300
#: And those that lower() takes out of that range.
_MOVED = "".join(chr(i) for i in range(_PLAIN) if max(chr(i).lower()) >= chr(_PLAIN))
_RARE = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]|[{_MOVED}]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(_PLAIN) if unicodedata.category(chr(i))[0] == kind)


_LETTER, _NUMBER, _SPACE = _class("L"), _class("N"), " \t-\r\x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The class of each character below ``_PLAIN``: 0 is white space, which is dropped; 1 letters, 2 numbers, 3 other signs.
_CLASSES = np.full(_PLAIN, 3, dtype=np.uint8)
for _k, _members in enumerate((_SPACE, _LETTER, _NUMBER)):
    _CLASSES[[i for i in range(_PLAIN) if re.match(f"[{_members}]", chr(i))]] = _k


def _pieces(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """What ``_PIECE`` finds in lower-cased UTF-8 of plain characters that ends in two blanks: where each piece starts, and the pieces."""
    kind = _CLASSES[data]
    # Characters of two bytes: both have the character's class.
    two = np.flatnonzero(data >= 0xC0)
    kind[two] = kind[two + 1] = _CLASSES[(data[two].astype(np.int32) & 31) << 6 | (data[two + 1] & 63)]
    first = np.empty(len(data), dtype=bool)
    first[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == 2
    first[two + 1] = False
    first &= kind != 0
    # An apostrophe that starts a piece takes an ending after it, and what follows that is another piece.
    at = np.flatnonzero(data == ord("'"))
    at = at[first[at]]
    a, b = data[at + 1], data[at + 2]
    short = np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    first[at[short | long] + 1] = False
    for after in (at[short] + 2, at[long] + 3):
        first[after] = kind[after] != 0
    kept = kind != 0
    ends = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept)).astype(np.int32)
    return np.flatnonzero(first), pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[kept])])


def _two_bytes(utf8: bytes) -> bool:
    """Whether no character is at or above ``_PLAIN``."""
    return int(np.frombuffer(utf8, dtype=np.uint8).max()) < chr(_PLAIN).encode()[0]


def _strings(pieces: pa.Array) -> list[str]:
    """As to_pylist, but quicker; pieces hold no blanks and aren't empty."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(pieces)], pa.int64()), pieces), " ")[0].as_py()
    return joined.split(" ") if joined else []


def _byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


_LETTERS = _byte_letters()
_ENCODERS: dict[tuple, Encoder] = {}


class Cache:
    """Bytes by string, ``most`` bytes at most. Strings seen once have a quarter of it, and are forgotten together when that is full; so they don't
    take the place of those seen again, of which what was used since their young half was last full stays when it is full again.
    """

    #: What an entry takes besides its characters and ids, about.
    ENTRY = 200

    def __init__(self, most: int):
        self.once, self.half = most // 4, most * 3 // 8
        self.forget()

    @property
    def size(self) -> int:
        return self.held_new + self.held + self.held_old

    def find(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None:
            got = self.new.pop(key, None)
            if got is not None:
                self.held_new -= self.ENTRY + len(key) + len(got)
            else:
                got = self.old.get(key)
                if got is None:
                    return None
            size = self.ENTRY + len(key) + len(got)
            if self.held + size > self.half:
                self.old, self.held_old, self.young, self.held = self.young, self.held, {}, 0
            if size <= self.half:
                self.young[key] = got
                self.held += size
        return got

    def keep(self, key: str, value: bytes) -> None:
        """Remember what :meth:`find` didn't find."""
        size = self.ENTRY + len(key) + len(value)
        if self.held_new + size > self.once:
            self.new, self.held_new = {}, 0
        if size <= self.once:
            self.new[key] = value
            self.held_new += size

    def forget(self) -> None:
        self.new: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held_new = self.held = self.held_old = 0


class Encoder:
    """The ``tokenizers`` file at ``path``; remembers at most so many bytes of words and of pieces."""

    def __init__(self, path: str, words: int = 140_000_000, pieces: int = 40_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = Cache(words), Cache(pieces)
        added = sorted({x.content[:2] for x in self.tokenizer.get_added_tokens_decoder().values() if x.content})
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One encoder for each worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def forget(self) -> None:
        """Free what was remembered."""
        self.words.forget()
        self.pieces.forget()

    def _piece(self, piece: str) -> bytes:
        # Most pieces stand alone elsewhere.
        got = self.words.find(piece) or self.pieces.find(piece)
        if got is None:
            got = self._merged(piece)
            self.pieces.keep(piece, got)
        return got

    def _merged(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        letters = piece if plain else "".join([_LETTERS[b] for b in piece.encode()])
        ids = [x.id for x in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        got = self.words.find(word)
        if got is None:
            pieces = _PIECE.findall(word)
            # A word that is one piece is kept as a word only.
            if pieces == [word]:
                got = self.pieces.find(word) or self._merged(word)
            else:
                known = map(self.words.young.get, pieces)
                got = b"".join([self._piece(x) if k is None else k for x, k in zip(pieces, known)])
            self.words.keep(word, got)
        return got

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        if _RARE.search(text) or (self.special and self.special.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = list(map(self.words.young.get, words))
        if None in out:
            out = [self._word(w) if x is None else x for w, x in zip(words, out)]
        return b"".join(out)

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as :meth:`ids` gives them."""
        out, plain, rows = [np.empty(0, dtype="<u4")] * len(texts), [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            low = text.lower().encode()
            if (text.isascii() or _two_bytes(text.encode()) and _two_bytes(low)) and not (self.special and self.special.search(text)):
                plain.append(low)
                rows.append(k)
            else:
                out[k] = np.frombuffer(self.ids(text), dtype="<u4")
        if not plain:
            return out
        starts, pieces = _pieces(np.frombuffer(b" ".join([*plain, b" "]), dtype=np.uint8))
        coded = pieces.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), _strings(coded.dictionary)
        known = list(map(self.words.young.get, distinct))
        if None in known:
            known = [self._lone(p) if x is None else x for p, x in zip(distinct, known)]
        # The ids of the distinct pieces stand one after another; each piece takes its own.
        n = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        own = n[which]
        ends = np.cumsum(own, dtype=np.int64)
        take = np.repeat((np.cumsum(n) - n)[which] - (ends - own), own)
        take += np.arange(len(take))
        ids = np.frombuffer(b"".join(known), dtype="<u4")[take]
        # The last piece before each text's end.
        last = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in plain]))
        cut = np.append(0, ends)[last].tolist()
        for k, a, b in zip(rows, [0, *cut], cut):
            out[k] = ids[a:b]
        return out

    def _lone(self, piece: str) -> bytes:
        """A piece is a word of one piece."""
        got = self.words.find(piece)
        if got is None:
            got = self.pieces.find(piece) or self._merged(piece)
            self.words.keep(piece, got)
        return got


def crc32(ids: bytes) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids)
