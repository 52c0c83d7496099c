"""Token ids of whole texts with a public tokenizer file, words being remembered."""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np

from barlight.llm.common import Remembered


def default_tokenizer() -> str:
    """The file used by the queries; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed values of the tokenizer file: its split pattern, written out for Latin-1 in lower case.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
LATIN = re.compile(r"[!-~\xa1-\xff]*")
SIGNS = frozenset(",.;:!?")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian 32-bit ids, with an end id after each text.

    The tokenizer drops white space and never merges across it, so the ids of a text are those
    of its parts between blanks and line ends, which are remembered. A new part of Latin-1
    letters and signs is lowered and split by the file's own pattern and its pieces go straight
    to the file's BPE model; any other part goes through the whole tokenizer. What is remembered
    takes some `most_bytes`, and `forget` drops it.
    """

    def __init__(self, path: str, end_id: int = 1, most_bytes: int = 144 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.end = np.array([end_id], "<u4").tobytes()
        self.parts = Remembered(self._part, most_bytes // 2, 240)
        self.pieces = Remembered(self._piece, most_bytes // 2, 240)
        self.vocabulary = self.tokenizer.get_vocab_size()

    def plain(self, text: str) -> bytes:
        """By the whole tokenizer, nothing remembered."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        found = self.model.tokenize(shown)
        return pack(f"<{len(found)}I", *[t.id for t in found])

    def _part(self, part: str) -> bytes:
        # most parts: a word of letters, with a sign after it or without
        word = part[:-1] if part[-1:] in SIGNS else part
        if word.isalpha() and (word.isascii() or LATIN.fullmatch(word)):
            return self.pieces[word.lower()] + (self.pieces[part[-1]] if word is not part else b"")
        if LATIN.fullmatch(part) and not ("<" in part and any(s in part for s in self.special)):
            return b"".join(map(self.pieces.__getitem__, SPLIT.findall(part.lower())))
        return self.plain(part)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        get = self.parts.__getitem__
        out = []
        for t in texts:
            self.parts.trimmed()
            self.pieces.trimmed()
            out.append(b"".join(map(get, (t or "").replace("\n", " ").split(" "))) + self.end)
        return out

    def forget(self) -> None:
        self.parts.clear()
        self.pieces.clear()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = 1) -> Encoder:
    """The process's encoder for this file; Python workers keep it, without what it remembers, from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
