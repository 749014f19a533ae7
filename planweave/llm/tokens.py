"""Token ids of whole texts by the public tokenizers, with each distinct piece between spaces encoded once per worker.

The ids come from the tokenizers library alone: its normalizer, pre-tokenizer and model. They are those of ``Tokenizer.encode`` (tests
compare them), but a piece that was seen before costs one look-up.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

from tokenizers import Tokenizer

#: Pieces that a worker remembers: the latest and those before them, each at most so many. This bounds its memory at about 170 MB.
REMEMBERED = 1 << 19
#: Longer pieces are not remembered.
LONGEST = 48

_OTHER_SPACE = re.compile(r"[^\S \n]")
_RUNS = ("  ", " \n", "\n ", "\n\n")
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĴ-ķŌ-ž"
#: A word of common letters, and ASCII marks behind it that are a word of their own (an apostrophe is not among them).
_WORD_AND_MARKS = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")
#: The parts of a tokenizer file under which a text may be cut at its spaces.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_LEVEL = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True},
        _BYTE_LEVEL | {"use_regex": False},
    ],
}
_WORD_NORMAL = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of public tokenizers: printable Latin-1 bytes stand for themselves, the others come from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers. When it is full it becomes the older half, from which pieces that are still in use return."""

    def __init__(self, encode, most: int = REMEMBERED):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(piece) > LONGEST:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class TextEncoder:
    """Encodes texts with a tokenizer file, add_special_tokens=False.

    A text is cut at single spaces only where the tokenizer cuts too. That is known for two kinds of files, told by their normalizer and
    pre-tokenizer: a byte-level one begins a piece at a space before a word, a word-level one drops white space. Texts with other white
    space, runs of it, or markup of added tokens are encoded as a whole, and so is every text with a file of another kind. With
    ``plain``, the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, most: int = REMEMBERED, plain: bool = False):
        self.tok = tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = plain
        self.model, self.normal, self.pre = tok.model, tok.normalizer, tok.pre_tokenizer
        parts = json.loads(tok.to_str())
        kind = parts["normalizer"], parts["pre_tokenizer"]
        pure = parts["model"]["type"] == "BPE" and not (parts["model"]["dropout"] or parts["truncation"] or parts["padding"])
        self.keeps_space = kind == (None, _BYTE_LEVEL)
        self.cuts = pure and (self.keeps_space or kind == (_WORD_NORMAL, _WORD_LEVEL))
        self.added = [t.content for t in tok.get_added_tokens_decoder().values() if not (plain and t.special)]
        letters = _byte_letters()
        self.letter = [letters[b] for b in range(256)]
        self.inner, self.first = _Pieces(self._inner, most), _Pieces(self._piece, most)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, mapped: str) -> list[int]:
        return [t.id for t in self.model.tokenize(mapped)]

    def _piece(self, piece: str) -> bytes:
        """A piece without inner spaces, or one space and such a piece."""
        if self.normal is not None:
            piece = self.normal.normalize_str(piece)
        return self._pack([i for word, _ in self.pre.pre_tokenize_str(piece) for i in self._word(word)])

    def _letters(self, piece: str) -> bytes:
        """A piece of common letters is one word."""
        data = piece.encode() if self.keeps_space else piece.lower().encode()
        word = data.decode() if len(data) == len(piece) else "".join(map(self.letter.__getitem__, data))
        return self._pack([t.id for t in self.model.tokenize("Ġ" + word if self.keeps_space else word)])

    def _inner(self, piece: str) -> bytes:
        m = _WORD_AND_MARKS.fullmatch(piece)
        if m is None:
            return self._piece(" " + piece if self.keeps_space else piece)
        return self.inner[m[1]] + self.first[m[2]] if m[2] else self._letters(piece)

    def encode(self, text: str | None, spaced: bool = False) -> bytes:
        """Ids of a text, with ``spaced`` of a space and the text, as little-endian 32-bit integers; a null or empty text has none."""
        if not text:
            return b""
        odd = not self.cuts or any(a in text for a in self.added) or _OTHER_SPACE.search(text)
        if odd or self.keeps_space and (text[0].isspace() or text[-1].isspace() or any(r in text for r in _RUNS)):
            return self._pack(self.tok.encode(" " + text if spaced else text, add_special_tokens=False).ids)
        inner, first, out = self.inner, self.first, []
        for i, line in enumerate(text.split("\n")):
            head, *rest = line.split(" ")
            out += [(inner if spaced and i == 0 else first)[head], *map(inner.__getitem__, rest)]
            if self.keeps_space:
                out.append(first["\n"])
        return b"".join(out[:-1] if self.keeps_space else out)


    def token_bytes(self) -> list[bytes]:
        """The bytes that each id of a byte-level vocabulary stands for."""
        back = {c: b for b, c in enumerate(self.letter)}
        known = {i: word for word, i in self.tok.get_vocab().items()}
        return [bytes(back.get(c, 0) for c in known.get(i, "")) for i in range(max(known) + 1)]


class PieceEncoder:
    """Encodes a text with a sentencepiece model, which adds a space; nothing in a text is special."""

    SPACE = "\u2581"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers; a null or empty text has none."""
        ids = self.model.encode(text) if text else []
        return struct.pack(f"<{len(ids)}I", *ids)

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for: a byte piece is its byte, others are their text with spaces for U+2581."""
        pieces = enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        return [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in pieces]


@lru_cache(maxsize=1)
def encoder(path: str, most: int = REMEMBERED) -> TextEncoder:
    """One encoder per worker, of the file and size that were asked for last."""
    return TextEncoder(path, most)
