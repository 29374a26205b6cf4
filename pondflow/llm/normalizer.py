"""SentencePiece normalisation with alignment to the source's bytes.

The model's compiled character map is a double-array trie (the public Darts-clone layout) over UTF-8
bytes, followed by the replacement strings. At each place the longest prefix found
in the trie is replaced; a character that starts none stays. Every byte of the
normalised text records where its source begins and ends, so pieces of the
normalised text project to byte spans of the original.
"""

from __future__ import annotations

import struct

import numpy as np

SPACE = "▁".encode()


class CharMap:
    """Longest-prefix replacement through a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(source bytes, place of the replacement) of the longest entry that starts at ``at``."""
        if not self.units:
            return None

        def child(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node, best = child(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= child(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return best

    def replacement(self, place: int) -> bytes:
        return self.strings[place:self.strings.index(b"\0", place)]


class Normalizer:
    """The normalisation a model's specification asks for.

    ``__call__`` returns the normalised bytes and, for each of them, the begin and the end of
    its source in the text's UTF-8 bytes (the dummy prefix has an empty source).
    """

    def __init__(self, charmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.map = CharMap(charmap)
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else b" "

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Without a map and without squeezing only spaces change, so whole arrays can be used."""
        source = np.frombuffer(raw, np.uint8)
        width = np.where(source == 32, len(self.space), 1)
        place = np.repeat(np.arange(len(source)), width)
        out, begin, end = raw.replace(b" ", self.space), place, place + 1
        if self.dummy_prefix and raw:
            nothing = np.zeros(len(self.space), place.dtype)
            return self.space + out, np.concatenate((nothing, begin)), np.concatenate((nothing, end))
        return out, begin, end

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        raw = text.encode()
        if not self.map.units and not self.squeeze:
            return self._plain(raw)
        parts = []  # (replacement, source begin, source end)
        at = 0
        while at < len(raw):
            found = self.map.longest(raw, at)
            if found:
                used, new = found[0], self.map.replacement(found[1])
            else:
                lead = raw[at]
                used = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at:at + used]
            parts.append((new, at, at + used))
            at += used
        out, begin, end = bytearray(), [], []

        def put(data: bytes, a: int, b: int) -> None:
            out.extend(data)
            begin.extend([a] * len(data))
            end.extend([b] * len(data))

        spaced = True  # leading spaces go when squeezing
        for new, a, b in parts:
            for char in new.decode("utf-8", "surrogateescape"):
                if char == " ":
                    if not (self.squeeze and spaced):
                        put(self.space, a, b)
                    spaced = True
                else:
                    put(char.encode("utf-8", "surrogateescape"), a, b)
                    spaced = False
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space):], begin[-len(self.space):], end[-len(self.space):]
        if self.dummy_prefix and out:
            first = begin[0]
            return (self.space + bytes(out), np.array([first] * len(self.space) + begin), np.array([first] * len(self.space) + end))
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)
