"""Token ids of whole texts by the tokenizers library, with a bounded memory of chunks seen before."""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

#: Chunks whose ids a worker remembers; beyond it, ids are computed anew each time.
REMEMBERED = 400_000
#: Marks that a pre-tokenizer parts from the letters before them, whatever follows. No apostrophe: it begins contractions.
_MARKS = ".,;:!?()[]{}<>*&%$#@=+/|~^-\""
#: Letters below this, and all that lower case makes of them, are letters for the tokenizers' patterns too; but for one.
_LATIN, _DOTTED = "\u0250", "\u0130"
#: Byte-level tokenizers write each byte as a character: printable ones as they are, others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [c for c in range(256) if c not in _PLAIN]
_BYTE_SIGNS = {c: c if c in _PLAIN else 256 + _OTHERS.index(c) for c in range(256)}
#: Longer chunks are not remembered.
CHUNK_CHARS = 64
#: White space for Python but not for the tokenizers' patterns.
_ODD = "\x1c\x1d\x1e\x1f"
#: Where a text may be cut without changing any id of a byte-level tokenizer: before a blank that a visible character follows.
_CUT = re.compile(r"(?= \S)")
#: A blank before white space: such texts are cut by _CUT, others at every blank.
_ROUGH = [" " + c for c in map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


class Ids:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Both vocabularies treat the chunks of a text on their own (the patterns of their pre-tokenizers
    never reach across these cuts), so the library encodes each distinct chunk once and a text's ids
    are its chunks' ids in order.
    """

    def __init__(self, path: str, spaced: bool):
        """spaced: whether a blank belongs to the id of the word after it (byte-level) or is dropped (word-level)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # The library finds these before all else, exactly as they are written, and treats what stands between on its own.
        self.added = {t.content: array("I", [i]).tobytes() for i, t in self.library.get_added_tokens_decoder().items()}
        self.at_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are little-endian unsigned 32-bit")
        self.spaced = spaced
        self.memory: dict[str, bytes] = {}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _word(self, chunk: str) -> bytes | None:
        """The ids of a chunk of Latin letters with marks behind them, which have ids of their own; None for any other.

        The letters are one pre-token, so the library's model takes them without the steps before it, which cost more.
        """
        head = chunk.rstrip(_MARKS)
        letters = head[1:] if self.spaced and head[:1] == " " else head
        if not letters.isalpha() or max(letters) >= _LATIN or _DOTTED in letters:
            return None
        marks = chunk[len(head) :]
        ids = self.memory.get(head) if marks else None
        if ids is None:
            signs = (head if self.spaced else letters.lower()).encode().decode("latin-1").translate(_BYTE_SIGNS)
            ids = array("I", [t.id for t in self.library.model.tokenize(signs)]).tobytes()
        if not marks:
            return ids
        if marks not in self.memory:
            self.memory[marks] = self._encode([marks])[0]
        return ids + self.memory[marks]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of the chunks that are not in memory, and room made for them there."""
        memory, out, others = self.memory, {}, []
        for c in chunks:
            if c not in memory and c not in out:
                if (ids := self._word(c)) is None:
                    others.append(c)
                else:
                    out[c] = ids
        others = list(dict.fromkeys(others))
        for i in range(0, len(others), 512):
            out.update(zip(others[i : i + 512], self._encode(others[i : i + 512])))
        room = REMEMBERED - len(memory)
        if room > 0:
            memory.update((c, ids) for c, ids in islice(out.items(), room) if len(c) <= CHUNK_CHARS)
        return out

    def _chunks(self, text: str) -> list[str]:
        if not self.spaced:
            return text.split()
        if text.startswith(" ") or any(c in text for c in _ROUGH):
            return [c for c in _CUT.split(text) if c]
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]] if first else []

    def encode(self, text: str | None) -> bytes:
        if text and any(t in text for t in self.added):
            return b"".join([self.added[x] if x in self.added else self._plain(x) for x in self.at_added.split(text)])
        return self._plain(text)

    def _plain(self, text: str | None) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if any(c in text for c in _ODD) or (self.spaced and text.endswith(" ")):
            return self._encode([text])[0]
        chunks = self._chunks(text)
        try:
            return b"".join(map(self.memory.__getitem__, chunks))
        except KeyError:
            new = self._learn(chunks)
            memory = self.memory
            return b"".join([memory[c] if c in memory else new[c] for c in chunks])


@lru_cache(None)
def ids_of(path: str, spaced: bool) -> Ids:
    """One encoder a worker process, kept from task to task."""
    return Ids(path, spaced)
