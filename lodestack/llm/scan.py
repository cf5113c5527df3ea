"""Characters and tokens of many texts at once, as arrays: what the recognisers of personal information look at."""

from __future__ import annotations

import unicodedata

import numpy as np

from lodestack.llm import lexicon

OTHER, SPACE, LINE, DIGIT, LOWER, UPPER, HAN, CASELESS = range(8)
_BMP = 1 << 16
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: Categories of words, each a bit of a token's flags.
CATEGORIES = {
    "phone": lexicon.PHONE, "identity": lexicon.IDENTITY, "address": lexicon.ADDRESS, "before_name": lexicon.BEFORE_NAME,
    "after_name": lexicon.AFTER_NAME, "title": lexicon.TITLE, "organisation": lexicon.ORGANISATION, "common": lexicon.COMMON,
    "counted": lexicon.COUNTED, "particle": lexicon.PARTICLE, "file_type": lexicon.FILE_TYPE, "family": lexicon.FAMILY,
    "given": " ".join(v for k, v in vars(lexicon).items() if k.startswith("GIVEN_") and k != "GIVEN_HAN"),
    "street": " ".join([lexicon.STREET_AFTER, lexicon.STREET_BEFORE_FR, lexicon.STREET_ENDINGS, lexicon.STREET_AFTER_RU.replace("|", " ")]),
}
BIT = {name: 1 << i for i, name in enumerate(CATEGORIES)}
HAN_CATEGORIES = {
    "phone": lexicon.HAN_PHONE, "identity": lexicon.HAN_IDENTITY, "address": lexicon.HAN_ADDRESS, "before_name": lexicon.HAN_BEFORE_NAME,
    "after_name": lexicon.HAN_AFTER_NAME, "counted": lexicon.HAN_COUNTED, "word": lexicon.HAN_WORDS, "compound": lexicon.COMPOUND,
}
HAN_BIT = {name: 1 << i for i, name in enumerate(HAN_CATEGORIES)}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By character: its class, and the character it counts as in words (lower-case, without accents)."""
    classes, folded = np.zeros(_BMP, np.uint8), np.arange(_BMP, dtype=np.uint32)
    for code in range(_BMP):
        char = chr(code)
        kind = unicodedata.category(char)
        if char in "\n\r\x00\x0b\x0c  \x85":
            classes[code] = LINE
        elif kind in ("Zs", "Cc"):
            classes[code] = SPACE
        elif kind == "Nd":
            classes[code] = DIGIT
        elif 0x4E00 <= code <= 0x9FFF:
            classes[code] = HAN
        elif kind in ("Lu", "Lt"):
            classes[code] = UPPER
        elif kind == "Ll" or kind == "Mn":
            classes[code] = LOWER
        elif kind[0] == "L":
            classes[code] = CASELESS
        if kind[0] == "L" and code < 0x1F00:
            base = unicodedata.normalize("NFD", char)[0].lower()
            folded[code] = ord(base[0])
    return classes, folded


CLASS, FOLD = _tables()
#: Full-width forms count as the ASCII characters they stand for.
_WIDE = np.arange(_BMP, dtype=np.uint32)
_WIDE[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _FACTOR, np.uint64)]))
        _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INVERSE, np.uint64)]))
    return _POWERS, _INVERSES


def fold(word: str) -> str:
    return "".join(chr(FOLD[ord(c)]) if ord(c) < _BMP else c for c in word)


def word_hash(word: str) -> int:
    out, power = 0, 1
    for c in fold(word):
        out = (out + ord(c) * power) & (2**64 - 1)
        power = power * _FACTOR & (2**64 - 1)
    return out


class Words:
    """Words of several categories by hash."""

    def __init__(self, categories: dict[str, str], bits: dict[str, int]):
        flags: dict[int, int] = {}
        for name, words in categories.items():
            for word in words.split():
                for part in ([word] if HAN == CLASS[ord(word[0])] else [w for w in _parts(word)]):
                    h = word_hash(part)
                    flags[h] = flags.get(h, 0) | bits[name]
        self.keys = np.array(sorted(flags), dtype=np.uint64)
        self.flags = np.array([flags[int(k)] for k in self.keys], dtype=np.uint32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.flags[at], np.uint32(0))


def _parts(word: str) -> list[str]:
    out, part = [], ""
    for c in word:
        if CLASS[ord(c)] in (LOWER, UPPER, CASELESS, DIGIT):
            part += c
        else:
            out.append(part)
            part = ""
    return [p for p in [*out, part] if p]


WORDS = Words(CATEGORIES, BIT)
HAN_PHRASES = Words(HAN_CATEGORIES, HAN_BIT)
SURNAME, GIVEN_HAN = np.zeros(_BMP, bool), np.zeros(_BMP, bool)
SURNAME[[ord(c) for c in lexicon.SURNAMES]] = True
GIVEN_HAN[[ord(c) for c in lexicon.GIVEN_HAN]] = True


class Scan:
    """Texts joined by NUL. text: the joined characters, full-width forms as ASCII; starts: where each text begins."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(t.replace("\0", "\x01") for t in texts)
        raw = np.frombuffer((joined + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.codes = np.where(raw < _BMP, _WIDE[np.minimum(raw, _BMP - 1)], raw).astype(np.uint32)
        self.text = self.codes.tobytes().decode("utf-32-le", "surrogatepass")
        small = np.minimum(self.codes, _BMP - 1)
        self.small, self.cls = small, CLASS[small]
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.starts = np.cumsum(lengths) - lengths
        power, self.inverse = _powers(len(small) + 1)
        self.sums = np.zeros(len(small) + 1, np.uint64)
        np.cumsum(FOLD[small].astype(np.uint64) * power[: len(small)], out=self.sums[1:])
        group = np.array([0, 0, 0, 2, 1, 1, 3, 1], np.uint8)[self.cls]
        change = np.ones(len(group) + 1, bool)
        change[1:-1] = (group[1:] != group[:-1]) | (group[1:] == 3)
        edges = np.flatnonzero(change)
        inside = group[edges[:-1]] > 0
        self.first, self.last = edges[:-1][inside], edges[1:][inside]  # of each token
        self.kind = group[self.first]
        self.flags = WORDS.of(self.hashes(self.first, self.last))
        self._inflected()
        self.lines = np.cumsum(self.cls == LINE, dtype=np.int32)
        digits = self.kind == 2
        self.digit_first, self.digit_last = self.first[digits], self.last[digits]
        self._sums: dict[str, np.ndarray] = {}

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the characters from each a up to b; places outside are cut."""
        a, b = np.clip(a, 0, len(self.codes)), np.clip(b, 0, len(self.codes))
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def _inflected(self) -> None:
        """Given names and cues in Cyrillic also with up to two letters of ending."""
        long = np.flatnonzero((self.kind == 1) & (self.small[self.first] >= 0x400) & (self.small[self.first] < 0x500) & (self.last - self.first > 4) & (self.flags == 0))
        keep = np.uint32(BIT["given"] | BIT["family"])
        for cut in (1, 2):
            base = WORDS.of(self.hashes(self.first[long], self.last[long] - cut)) & keep
            for ending in "аяйь":  # the nominative may end in a vowel that the ending replaced
                tail = np.uint64(ord(ending)) * _powers(len(self.codes) + 1)[0][np.minimum(self.last[long] - cut - self.first[long], len(self.codes))]
                base |= WORDS.of(self.hashes(self.first[long], self.last[long] - cut) + tail) & keep
            self.flags[long] |= base

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def class_at(self, at: np.ndarray) -> np.ndarray:
        """Classes of characters; the border outside."""
        ok = (at >= 0) & (at < len(self.cls))
        return np.where(ok, self.cls[np.clip(at, 0, len(self.cls) - 1)], LINE)

    def code_at(self, at: np.ndarray) -> np.ndarray:
        ok = (at >= 0) & (at < len(self.small))
        return np.where(ok, self.small[np.clip(at, 0, len(self.small) - 1)], 0)

    _KINDS = {"digit": (DIGIT,), "letter": (LOWER, UPPER, CASELESS, HAN), "upper": (UPPER,)}

    def count(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Characters of a kind, or equal to a sign, from each a up to b."""
        if name not in self._sums:
            hit = np.isin(self.cls, self._KINDS[name]) if name in self._KINDS else self.small == ord(name)
            self._sums[name] = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        sums = self._sums[name]
        return sums[b] - sums[a]

    def flagged(self, name: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Tokens of a category from token i up to token j."""
        key = "flag " + name
        if key not in self._sums:
            self._sums[key] = np.concatenate([[0], np.cumsum(self.flags & BIT[name] > 0, dtype=np.int32)])
        sums, n = self._sums[key], len(self.flags)
        return sums[np.clip(j, 0, n)] - sums[np.clip(i, 0, n)]

    def number(self, at: np.ndarray, size: int) -> np.ndarray:
        """The number of `size` digits at each place; -1 where there are other characters."""
        out, ok = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(size):
            code = self.code_at(at + k).astype(np.int64) - 48
            ok &= (code >= 0) & (code <= 9)
            out = out * 10 + code
        return np.where(ok, out, -1)
