"""Token ids of whole texts for a BPE vocabulary that never joins words, with word-level caches."""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

#: Characters for which lower-casing, composition and splitting are known to agree with the vocabulary's rules.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
#: Entries of the two caches; a full cache is emptied, which changes speed only.
CACHE = 400_000


def _byte_letters() -> dict[int, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable bytes stay, others follow from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in keep]
    return {b: b for b in keep} | {b: 256 + k for k, b in enumerate(other)}


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


class _Pieces(dict):
    """Lower-case piece -> its ids as little-endian 32-bit words."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenize, self.letters = tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = self[piece] = _packed([t.id for t in self.tokenize(shown)])
        return ids


class WordIds(dict):
    """White-space-separated word (UTF-8) -> its ids. Words with unusual characters go through the library's own path."""

    def __init__(self, vocabulary: str, special: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = not special
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.pieces = _Pieces(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode()
        if len(text) < 200 and _PLAIN(text) and not (self.marks and any(m in text.lower() for m in self.marks)):
            ids = b"".join(map(self.pieces.__getitem__, _SPLIT(text.lower())))
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: bytes | None) -> bytes:
        """All ids of a text, four bytes each. The vocabulary drops white space, so words can be taken one by one."""
        return b"".join(map(self.__getitem__, (text or b"").split()))


_LOADED: dict[tuple[int, bool], WordIds] = {}


def word_ids(vocabulary: str, special: bool = False) -> WordIds:
    """One tokenizer for each worker process and vocabulary; with ``special``, special tokens written in a text are those, as by the library's default."""
    key = hash(vocabulary), special
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordIds(vocabulary, special)
    return _LOADED[key]


def forget() -> None:
    """Drop what ``word_ids`` has loaded; a later call loads it again."""
    _LOADED.clear()


def default_vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()
