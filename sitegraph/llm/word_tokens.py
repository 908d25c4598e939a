"""Ids of a lower-casing word BPE (`tokenizers` JSON), looked up by chunk of text between white space.

White space ends every match of the tokenizer's split pattern and takes part in no composition, so
the ids of a text are those of its chunks in a row. Chunks of printable ASCII and Latin-1 letters are
cut into the pattern's matches here, and the library's BPE model gives the ids of each; the library
encodes other chunks whole. Matches and chunks repeat far more often than texts, hence their ids are
remembered. Texts that may hold one of the special strings, which the library looks for before it
splits, go to it whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array

from sitegraph.llm.common import ENTRY_BYTES, TABLE_BYTES

#: Matches and chunks a worker keeps, in two tables: a full one becomes the older one, whose entries are
#: kept again when they are met again. Longer ones are not kept.
MAX_CHUNKS = 500_000
MAX_CHUNK_BYTES = 64

_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: White space, printable ASCII and Latin-1 letters (composed already), and the split pattern as it meets these.
_PLAIN = re.compile(r"[ \t\n\r\x0b\x0c!-~À-ÖØ-öø-ÿ]*")
_MATCH = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9ß-öø-ÿ]+")
#: Signs that are one match with those before and after them; an apostrophe may begin a contraction.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins for bytes: printable Latin-1 as itself, the others from code point 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class WordTokens:
    def __init__(self, path: str, limit: int = MAX_CHUNKS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def encode(self, data: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if b"<|" in data:
            return self._pack(self._library(data.decode("utf-8", "replace")))
        if b"\xcc" not in data and b"\xcd" not in data:  # no combining marks: lower case first makes no difference
            data = data.lower()
        text = data.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            chunks, ids_of = text.lower().split(), self._plain
        else:
            chunks, ids_of = _CHUNK.findall(text), self._chunk
        found = list(map(self.known.get, chunks))
        if None in found:
            found = [ids_of(c) if f is None else f for c, f in zip(chunks, found)]
        return b"".join(found)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return self._plain(chunk.lower())
        ids = self._kept(chunk)
        return self._keep(chunk, self._pack(self._library(chunk))) if ids is None else ids

    def _plain(self, chunk: str) -> bytes:
        """Ids of a lower-case chunk of plain characters, by its matches."""
        word = chunk.rstrip(_SIGNS)
        if word.isalpha():  # by far the most frequent form: not kept itself, as its two matches are
            signs = chunk[len(word) :]
            return self._match(word) + self._match(signs) if signs else self._match(word)
        ids = self._kept(chunk)
        return self._keep(chunk, b"".join(map(self._match, _MATCH.findall(chunk)))) if ids is None else ids

    def _match(self, match: str) -> bytes:
        ids = self._kept(match)
        if ids is None:
            letters = match
            if not match.isascii():  # printable ASCII stands for itself
                letters = "".join(map(self.letters.__getitem__, match.encode()))
            ids = self._keep(match, self._pack([t.id for t in self.library.model.tokenize(letters)]))
        return ids

    def _kept(self, part: str) -> bytes | None:
        ids = self.known.get(part)
        if ids is None:
            ids = self.older.get(part)
            if ids is not None:
                self._keep(part, ids)
        return ids

    def _keep(self, part: str, ids: bytes) -> bytes:
        size = len(part.encode())
        if size <= MAX_CHUNK_BYTES:
            cost = ENTRY_BYTES + size + len(ids)
            if 2 * len(self.known) >= self.limit or 2 * (self.size + cost) > TABLE_BYTES:
                self.older, self.known, self.size = self.known, {}, 0
            self.known[part] = ids
            self.size += cost
        return ids

    def _library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array("I", ids)
        return packed.tobytes()


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def version_of(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()
