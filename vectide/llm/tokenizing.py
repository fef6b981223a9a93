"""Encoders that Python workers build from the public vocabulary files.

The files' place is a parameter of the operators; nothing of them is kept in the repository.
"""

from __future__ import annotations

import base64
import os
import re
import struct

#: Pieces that a worker remembers: at half of them a new generation begins, and the older is kept beside it.
CACHED_PIECES = 600_000

#: The letters, numbers and white space of Latin-1: there the piece pattern needs no Unicode tables.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library, as little-endian uint32 bytes.

    Such a tokenizer encodes each match of its pattern by itself.  So texts within Latin-1 are cut
    with that pattern, and the library's model encodes each distinct piece once; other texts, and
    those that hold an added token such as ``<|endoftext|>``, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        n, s, t = _LETTERS, _NUMBERS, _SPACES
        self.pieces = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{n}]+| ?[{s}]+| ?[^{n}{s}{t}]+|[{t}]+(?![^{t}])|[{t}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        hidden = iter(range(256, 512))
        names = {b: chr(b if b in shown else next(hidden)) for b in range(256)}
        self.spelled = {i: "".join(names[b] for b in chr(i).encode()) for i in range(256)}
        self.merge = self.library.model.tokenize
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids := e.ids)}I", *ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.merge(piece.translate(self.spelled))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole([text])[0]
        if any(t in text for t in self.added):
            return self._whole([text])[0]
        pieces = self.pieces(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            lacking = {p for p, ids in zip(pieces, found) if ids is None}
            ids = {p: self.older.get(p) or self._piece(p) for p in lacking}
            found = [ids[p] if f is None else f for p, f in zip(pieces, found)]
            if len(self.known) + len(ids) > CACHED_PIECES // 2:
                self.older, self.known = self.known, {}
            if len(ids) <= CACHED_PIECES // 2:
                self.known |= ids
        return b"".join(found)


#: Encoders outlive a task, as Python workers do, with the pieces they know.
_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def rank_encoder(path: str):
    """A ``tiktoken`` encoding of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
