"""Whole-text tokenisation with a word memo, for the token operators.

A byte-level BPE never merges across pre-tokens.  A single space or line feed between
two non-space characters starts a pre-token, and so does a mark such as a full stop
behind a letter or digit.  A text may therefore be cut there, each piece encoded alone
by the tokenizers library and the ids concatenated.  Pieces repeat, so each worker
keeps their encodings in a bounded memo.  ``tests/llm/test_tokens.py`` compares with
encoding whole texts at once.
"""

from __future__ import annotations

import re

#: Entries that a memo holds. Pieces met later are encoded each time; after so many of those the memo starts anew.
MEMO_ENTRIES, STALE = 700_000, 3_000_000
#: Pieces longer than this are encoded but not remembered.
MEMO_PIECE = 48

#: White space that doesn't stand alone between two other characters.
_RUN = re.compile(r"\s\s").search
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: For texts without such white space: a word before a mark, or all up to the next space or line feed.
_PIECES = re.compile(r"[ \n]?[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?=[ \n.,;:!?|#$%&*()\"]|\Z)|[ \n]?[^ \n]+").findall


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceWise(dict):
    """Concatenates ``make(piece)`` over the independent pieces of a text; remembers pieces."""

    def __init__(self, make):
        super().__init__()
        self.make, self.passed = make, 0

    def __missing__(self, piece: str) -> bytes:
        value = self.make(piece)
        if len(piece) <= MEMO_PIECE:
            if len(self) < MEMO_ENTRIES:
                self[piece] = value
            elif (passed := self.passed + 1) < STALE:
                self.passed = passed
            else:
                self.clear()
                self.passed = 0
        return value

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        odd = text[0].isspace() or text[-1].isspace() or _RUN(text)
        return b"".join(map(self.__getitem__, _CUT.split(text) if odd else _PIECES(text)))


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_encoders: dict = {}


def id_encoder(path: str) -> PieceWise:
    """Encoder from text to its ids as little-endian unsigned 32-bit integers; one per worker and vocabulary."""
    if path not in _encoders:
        import struct

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode, bpe, shown = tokenizer.encode, tokenizer.model.tokenize, dict(enumerate(byte_alphabet()))

        def make(piece: str) -> bytes:
            if piece.removeprefix(" ").isalpha():  # one pre-token: letters are what the vocabulary's pattern keeps together
                ids = [t.id for t in bpe(piece.encode().decode("latin-1").translate(shown))]
            else:
                ids = encode(piece, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)

        _encoders[path] = PieceWise(make)
    return _encoders[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
