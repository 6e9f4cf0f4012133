"""Token ids of whole texts by a byte-level BPE file; loaded once per Python worker."""

from __future__ import annotations

import functools
import os
import re
import struct

#: Beyond these characters (ASCII and Latin letters, whose classes are the same in every Unicode
#: version) a text takes the library whole.
_OTHER = re.compile(r"[^\n\t\x20-\x7e¡-¬®-ɏ]")
#: The public splitting pattern over those characters: letters, digits, the rest, white space.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
_CACHE_WORDS = 400_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of the pieces met so far; asks the tokenizer once per piece."""

    def __init__(self, ids):
        self.ids = ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) > _CACHE_WORDS:
            self.clear()
        found = self[piece] = self.ids(piece)
        return found


class Encoder:
    """Little-endian unsigned 32-bit ids of a text.

    BPE merges never cross the pieces that the splitting pattern makes, so the ids of a piece are
    remembered; the tokenizer itself is asked once per distinct piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known = _Known(self._ids)

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or (self.special and self.special.search(text)):
            return self._ids(text)
        return b"".join(map(self.known.__getitem__, _SPLIT.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
