"""Token ids of whole texts by a tokenizer file, with every word encoded about once per worker."""

from __future__ import annotations

import array
import json
import os
import re

#: Bytes of Latin-1 in texts for which the quick way is exact: printable ASCII, tab, newline, and the Latin-1 letters from A-grave to y-diaeresis.
PLAIN = bytes([9, 10, *range(32, 127), *(b for b in range(0xC0, 0x100) if b not in (0xD7, 0xF7))])
#: Lower case within those bytes.
LOWER = bytes(bytes([b]).decode("latin-1").lower().encode("latin-1")[0] if b in PLAIN else b for b in range(256))
#: The word pattern of the tokenizer file, within those bytes.
PIECE = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z\xdf-\xf6\xf8-\xff0-9]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class PieceIds(dict):
    """Maps a lower-case Latin-1 piece of the word pattern to its ids as 16-bit bytes; emptied at `most` pieces."""

    def __init__(self, model, most: int = 400_000):
        super().__init__()
        self.model, self.most, self.letters = model, most, _byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        # printable ASCII bytes are their own letters
        spelled = piece.decode("ascii") if piece.isascii() else "".join(map(self.letters.__getitem__, piece.decode("latin-1").encode()))
        ids = array.array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


#: The normaliser and the word pattern that the quick way was written for.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def is_plain(own) -> bool:
    """Whether a tokenizer splits and lower-cases as the quick way does: its file says so."""
    spec = json.loads(own.to_str())
    words, levels = [*((spec["pre_tokenizer"] or {}).get("pretokenizers") or []), {}, {}][:2]
    return (
        (spec["normalizer"] or {}).get("normalizers") == NORMAL
        and (words.get("pattern"), words.get("behavior"), words.get("invert")) == ({"Regex": PATTERN}, "Removed", True)
        and (levels.get("type"), levels.get("add_prefix_space"), levels.get("use_regex")) == ("ByteLevel", False, False)
        and spec["model"]["type"] == "BPE"
        and not spec["model"]["dropout"]
        and all(t["content"].startswith("<|") for t in spec["added_tokens"])
    )


_LOADED: dict[str, tuple] = {}


def encoder(path: str):
    """A function from text to ids as little-endian 16-bit bytes, equal to the tokenizer's encode without special tokens.

    Texts of plain characters take the table of pieces, if the tokenizer splits as its pattern does; all others go through the
    tokenizer whole. Ids of 65,536 or more raise OverflowError.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        _LOADED[path] = (own, PieceIds(own.model) if is_plain(own) else None)
    own, pieces = _LOADED[path]

    def encode(text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"\0"
        if pieces is None or b"<|" in raw or raw.translate(None, PLAIN):
            return array.array("H", own.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(pieces.__getitem__, PIECE.findall(raw.translate(LOWER))))

    return encode
