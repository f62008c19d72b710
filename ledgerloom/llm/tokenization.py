"""Token ids by the tokenizers library, each distinct unit of text encoded once per worker.

Both tokenizers here split a text into pieces before merging, and no piece ever reaches over a single blank or line
break between visible characters. So a text is cut there, each distinct unit goes through the library once, and the
results are strung together; they equal those of the whole text. Texts with runs of white space, where a piece can
hold several white-space characters, and texts that hold a special token's string go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Units kept before the memo starts anew, and the longest unit that is kept.
MEMO_UNITS, MEMO_CHARS = 600_000, 48
_OTHER_SPACE = re.compile(r"[^\S \n]")


def odd_space(t: str) -> bool:
    """Whether white space other than single blanks and line breaks between visible characters occurs."""
    return "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0].isspace() or t[-1].isspace() or _OTHER_SPACE.search(t) is not None



def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write bytes that print as themselves, and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


BYTE_ALPHABET = _byte_alphabet()

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once per process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", [])]


class Encoder:
    """ids(texts) as little-endian unsigned 32-bit bytes, without added special tokens."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.special = re.compile("|".join(map(re.escape, special_strings(path))) or r"(?!)")
        self.model = self.tok.model
        self.mark = {m: array("I", self.tok.encode(m, add_special_tokens=False).ids).tobytes() for m in ",."}
        self.memo: dict[str, bytes] = {}

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        memo = self.memo
        new = [u for u in units if u not in memo]
        if len(memo) + len(new) > MEMO_UNITS:
            memo.clear()
            new = list(units)
        out = {}
        for u in new:
            if len(u) > MEMO_CHARS:
                out[u] = self.whole(u)
            elif u[-1:] in (",", ".") and "A" <= u[-2:-1] < "\u0250" and u[-2].isalpha():
                # a letter and the mark after it are always in different pieces
                word = memo.get(u[:-1])
                if word is None:
                    word = memo[u[:-1]] = self.unit(u[:-1])
                memo[u] = word + self.mark[u[-1]]
            else:
                memo[u] = self.unit(u)
        return out

    def unit(self, u: str) -> bytes:
        """A short unit: if it is one piece, straight by the tokenizer's model, in the alphabet that stands for bytes."""
        if u.isalpha() or u[:1] == " " and u[1:].isalpha():
            return array("I", [x.id for x in self.model.tokenize(u.encode("utf-8").decode("latin-1").translate(BYTE_ALPHABET))]).tobytes()
        return self.whole(u)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list = []
        units: set[str] = set()
        for t in texts:
            if not t:
                out.append(b"")
            elif odd_space(t) or self.special.search(t):
                out.append(self.whole(t))
            else:
                # " word" keeps its blank; a line break is a unit of its own
                cut = t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in t else None
                if cut is None:
                    out.append(self.whole(t))
                    continue
                units.update(cut)
                out.append(cut)
        long = self._learn(units)
        get = self.memo.__getitem__ if not long else lambda u: self.memo.get(u) or long[u]
        return [x if isinstance(x, bytes) else b"".join(map(get, x)) for x in out]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Counter:
    """n_tokens(texts) for a tokenizer that drops white space: units lie between blanks and line breaks."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.special = re.compile("|".join(map(re.escape, special_strings(path))) or r"(?!)")
        self.model = self.tok.model
        self.normalize = self.tok.normalizer.normalize_str if self.tok.normalizer is not None else str
        self.memo: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def unit(self, u: str) -> int:
        """A short unit: if it is one piece, straight by the tokenizer's model, normalised and in the alphabet that stands for bytes.

        Normalising can make a mark of a letter, and a piece of letters ends before a mark.
        """
        if u.isalpha() and (n := self.normalize(u)).isalpha():
            return len(self.model.tokenize(n.encode("utf-8").decode("latin-1").translate(BYTE_ALPHABET)))
        return self.whole(u)

    def count(self, texts: list[str]) -> list[int]:
        cut = [None if self.special.search(t) else t.replace("\n", " ").split(" ") for t in texts]
        units: set[str] = set()
        for x in cut:
            units.update(x or ())
        memo = self.memo
        new = [u for u in units if u not in memo]
        if len(memo) + len(new) > MEMO_UNITS:
            memo.clear()
            new = list(units)
        long = {}
        for u in new:
            if len(u) > MEMO_CHARS:
                long[u] = self.whole(u)
            elif u[-1:] in (",", ".") and "A" <= u[-2:-1] < "\u0250" and u[-2].isalpha() and (u[-2].isascii() or self.normalize(u[-2]).isalpha()):
                # a letter and the mark after it are always in different pieces
                word = memo.get(u[:-1])
                if word is None:
                    word = memo[u[:-1]] = self.unit(u[:-1])
                memo[u] = word + 1
            else:
                memo[u] = self.unit(u)
        get = self.memo.__getitem__ if not long else lambda u: self.memo[u] if u in self.memo else long[u]
        return [self.whole(t) if x is None else sum(map(get, x)) for t, x in zip(texts, cut, strict=True)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]
