"""Text read with a wrong character encoding: finding it, and restoring the original where possible.

A swap of code pages is a substitution cipher: bytes written in one code page were shown in another. Which swaps
a source suffered is unknown, so they are the hidden states of a mixture, learned by expectation-maximization
against the bigrams of the languages in the corpus itself:

* the language model is the count of all character bigrams of all texts, in tables of fixed size. Units that look
  less strange in a strict reading weigh next to nothing as they stand, however often they occur: a garbled text in
  many copies must not become the language;
* E step: every unit of text (letters around non-ASCII characters) gets the posterior of being clean, or of being the
  image of a clean text under each cipher, from the bigram probability of its original and of what it deciphers to;
* M step: the share of each cipher in each source, the byte-to-letter mapping of each cipher (expected counts of each
  substitution), and the bigram counts, now of all readings by their posteriors;
* units that no known swap explains, but that look like letters shown by wrong characters, are deciphered without knowing a
  page: substitution.py learns the letter of each character for each source, from its neighbours alone.

Ciphers of one byte per letter are applied with translate() by their mapping. Most swaps here involve UTF-8 or GBK,
where a letter is several bytes, which no translate() can restore; those are deciphered by encoding and decoding.

The corpus is scanned once per round and once at the end; nothing but the fixed-size tables is shuffled or collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import substitution
from lodestack.session import Scratch, ship_package

#: Sizes of the hashed bigram and character tables.
BIGRAMS, CHARS = 1 << 20, 1 << 16
#: Letters around at least one non-ASCII character.
UNIT = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
LOST = "�"
#: Code pages whose text is one byte per letter, and those with several.
SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866")
MULTI = ("utf-8", "gbk", "big5")
#: Prior of a unit being garbled, before anything is learned, shared by all ciphers.
GARBLED = 0.02
#: Weight of the classes' estimate of a bigram against its own count, as a share of all characters: characters much
#: rarer than that tell nothing about their successors.
SMOOTH = 2e-5
#: Successors with less than this share of a character count as unseen (a tenth of it at the start of a unit): what
#: garbled text is left in the counts.
DISCOUNT = 0.005
#: Weight of a suspect unit in the counts as it stands.
SUSPECT = 0.001
CLASSES = 16
#: Readings with lower log odds take no part in the sums.
NEGLIGIBLE = -4.5
#: Sources share so many sets of ciphers' shares, by a hash.
SLOTS = 1024
#: Sets of sources among which a pair of characters must be spread to belong to the language.
SPREAD = 64
#: Control characters that no text contains, but the upper half of code pages does (U+0085 is a line end).
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
MOST_REMEMBERED = 50_000
#: Bytes of text handled at once in a Python worker.
PIECE = 1 << 19


def code_page(name: str) -> dict[int, str]:
    """The upper half of a one-byte code page; bytes without a character show as control characters."""
    out = {}
    for byte in range(0x80, 0x100):
        try:
            out[byte] = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            out[byte] = chr(byte)
    return out


@dataclass(frozen=True)
class Cipher:
    """Bytes of `written` shown as `shown`; `times` over."""

    shown: str
    written: str
    times: int = 1
    table: dict = field(default=None, compare=False, repr=False)

    @property
    def name(self) -> str:
        return f"{self.written}>{self.shown}" + (f"*{self.times}" if self.times > 1 else "")


def ciphers() -> list[Cipher]:
    """All swaps of the code pages, and repeated ones of UTF-8."""
    out = []
    for shown in (*SINGLE, *MULTI):
        for written in (*SINGLE, *MULTI):
            if shown == written or {shown, written} == {"cp1252", "latin-1"} or (shown in MULTI and written in SINGLE and written not in ("cp1252", "cp1251", "cp866", "koi8_r")):
                continue
            table = None
            if shown in SINGLE:
                shown_as = code_page(shown)
                target = code_page(written) if written in SINGLE else {b: chr(b) for b in range(0x80, 0x100)}
                table = {ord(c): target[b] for b, c in shown_as.items() if len(c) == 1 and ord(c) > 0x7F}
            out.append(Cipher(shown, written, 1, table))
            if written == "utf-8" and shown in SINGLE:
                out.append(Cipher(shown, written, 2, table))
    return out


CIPHERS = ciphers()


def _classes() -> np.ndarray:
    """The class of each character up to U+FFFF: kinds of letters that languages keep apart."""
    out = np.full(CHARS, 14, np.int64)
    for code in range(1, CHARS):
        kind = unicodedata.category(chr(code))
        if code < 0x80:
            out[code] = 2 if kind == "Lu" else 1
        elif code < 0xA0:
            out[code] = 9
        elif kind[0] == "L" and code < 0x250:
            out[code] = 4 if kind == "Lu" else 3
        elif 0x410 <= code < 0x450 or code in (0x401, 0x451):
            out[code] = 6 if kind == "Lu" else 5
        elif 0x400 <= code < 0x530:
            out[code] = 15
        elif 0x4E00 <= code < 0xA000:
            out[code] = 7
        elif 0x2000 <= code < 0x2070 or 0x3000 <= code < 0x3020 or 0xFF00 <= code < 0xFF60:
            out[code] = 10
        elif code < 0x100:
            out[code] = 11
        elif 0x2070 <= code < 0x2E80:
            out[code] = 12
        elif 0x3020 <= code < 0x4E00:
            out[code] = 8
        elif kind[0] == "L":
            out[code] = 13
    out[0] = 0
    return out


CLASS = _classes()


class Bigrams:
    """Hashed counts of characters and of pairs of neighbours; 0 stands for the border of a unit. Pairs seldom seen
    are estimated by the counts of pairs of classes and of the second character within its class."""

    def __init__(self, pairs: np.ndarray | None = None, chars: np.ndarray | None = None, classes: np.ndarray | None = None):
        self.pairs = np.zeros(BIGRAMS) if pairs is None else pairs
        self.chars = np.zeros(CHARS) if chars is None else chars
        self.classes = np.zeros((CLASSES, CLASSES)) if classes is None else classes
        size = np.bincount(CLASS, minlength=CLASSES)
        inside = (self.chars + 0.1) / (np.bincount(CLASS, self.chars, CLASSES) + 0.1 * size)[CLASS]
        follows = (self.classes + 0.1) / (self.classes.sum(axis=1, keepdims=True) + 0.1 * CLASSES)
        self.inside, self.follows = inside, follows
        self.smooth = max(5.0, SMOOTH * self.chars.sum())

    @staticmethod
    def codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of all units with a border before, between and after, and the position of each unit."""
        joined = "\0" + "\0".join(units) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        return codes, np.concatenate([[0], np.flatnonzero(codes == 0)[1:-1]]) if len(units) else np.zeros(0, np.int64)

    @staticmethod
    def cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = codes[:-1], codes[1:]
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        return (h & np.uint64(BIGRAMS - 1)).astype(np.int64), (a % CHARS).astype(np.int64), (b % CHARS).astype(np.int64)

    def add(self, units: list[str], counts: np.ndarray) -> None:
        if not units:
            return
        codes, at = self.codes(units)
        pair, a, b = self.cells(codes)
        weight = np.repeat(counts, np.diff(np.append(at, len(codes) - 1))).astype(float)
        self.pairs += np.bincount(pair, weight, BIGRAMS)
        self.chars += np.bincount(a, weight, CHARS)
        self.classes += np.bincount(CLASS[a] * CLASSES + CLASS[b], weight, CLASSES**2).reshape(CLASSES, CLASSES)

    def probability(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of character b after character a, by code."""
        pair, a, b = self.cells(np.stack([a, b], axis=1).astype(np.uint64).ravel())
        pair, a, b = pair[::2], a[::2], b[::2]
        return self._smoothed(pair, a, b)

    def _smoothed(self, pair: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rough = self.follows[CLASS[a], CLASS[b]] * self.inside[b]
        kept = np.maximum(self.pairs[pair] - np.where(a == 0, DISCOUNT / 10, DISCOUNT) * self.chars[a], 0.0)
        return (kept + self.smooth * rough) / (self.chars[a] + self.smooth)

    def logs(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of all neighbours of the units, the codes, and where each unit begins."""
        codes, at = self.codes(units)
        return np.log(self._smoothed(*self.cells(codes))), codes, at

    def score(self, units: list[str]) -> np.ndarray:
        """Log probability of each unit."""
        if not units:
            return np.zeros(0)
        logs, _, at = self.logs(units)
        return np.add.reduceat(logs, at)

    def page(self, name: str) -> np.ndarray:
        """Log probabilities of neighbouring bytes of a one-byte code page, flat; byte 0 is the border."""
        codes = np.arange(256)
        codes[0x80:] = [ord(c) for _, c in sorted(code_page(name).items())]
        a, b = np.meshgrid(codes, codes, indexing="ij")
        return np.log(self.probability(a.ravel(), b.ravel()))


@dataclass(frozen=True)
class Reading:
    """The best cipher of a unit (-1: it is clean), its log odds against the unit as it stands, what it deciphers to, and all
    readings (cipher, posterior, text) that aren't negligible; `clean` is the posterior of the unit as it stands."""

    cipher: int
    odds: float
    text: str
    options: tuple[tuple[int, float, str], ...]
    clean: float


CLEAN = Reading(-1, 0.0, "", (), 1.0)
#: Log likelihood ratio of a reading that needs no comparison.
SURE = 1e6


class Decipherer:
    """The E step: the posterior of each cipher for each unit. One-byte readings are scored by tables of the bytes."""

    def __init__(self, model: Bigrams, shares: dict[str, dict[str, float]]):
        self.model = model
        self.shares = shares
        self.pages = {name: model.page(name) for name in SINGLE}
        #: By unit: (cipher, log likelihood ratio, text) of the readings that any source's prior could make count.
        self.known: dict[str, tuple[tuple[int, float, str], ...]] = {}
        self.prior_of: dict[str, np.ndarray] = {}
        self.judged: dict[tuple[str, str], Reading] = {}

    def priors(self, source: str) -> np.ndarray:
        if source not in self.prior_of:
            own, default = self.shares.get(source, {}), GARBLED / len(CIPHERS)
            self.prior_of[source] = np.log([own.get(c.name, default) for c in CIPHERS])
        return self.prior_of[source]

    def one(self, source: str, unit: str) -> Reading:
        """The reading of a unit that `read` has seen."""
        options = self.known[unit]
        if not options:
            return CLEAN
        if (source, unit) not in self.judged:
            if len(self.judged) > MOST_REMEMBERED:
                self.judged.clear()
            prior = self.priors(source)
            self.judged[source, unit] = _reading([(k, odds + float(prior[k]), text) for k, odds, text in options])
        return self.judged[source, unit]

    def read(self, units: Iterable[str]) -> None:
        """Make the units known; those of a call are known until the next."""
        units = dict.fromkeys(units)
        if len(self.known) > MOST_REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = [u for u in units if u not in known]
        if not fresh:
            return
        plain = self.model.score([u.replace("\0", LOST) for u in fresh])
        found: list[list[tuple[int, float, str | None]]] = [[] for _ in fresh]
        by_shown: dict[str, list[int]] = {}
        for i, unit in enumerate(fresh):
            for shown in _shown_as(unit):
                by_shown.setdefault(shown, []).append(i)
        owner, which, texts, sure = [], [], [], []
        for shown, members in by_shown.items():
            raws = [_bytes_of(fresh[i], shown) for i in members]
            members = [i for i, raw in zip(members, raws) if raw is not None]
            raws = [raw for raw in raws if raw is not None]
            if not raws:
                continue
            flat = np.frombuffer(b"\0" + b"\0".join(raws) + b"\0", dtype=np.uint8).astype(np.int32)
            at = np.flatnonzero(flat == 0)[:-1]
            cells = flat[:-1] * 256 + flat[1:]
            alone = np.array([len(fresh[i]) == 1 for i in members])
            for k in _BY_SHOWN[shown]:
                cipher = CIPHERS[k]
                if cipher.written in SINGLE:
                    if shown == "utf-8":
                        continue
                    odds = np.add.reduceat(self.pages[cipher.written][cells], at) - plain[members]
                    for j in np.flatnonzero((odds > NEGLIGIBLE) & ~alone):
                        found[members[j]].append((k, float(odds[j]), _text_of(raws[j], cipher.written)))
                    continue
                if shown == "utf-8" and cipher.written != "gbk":
                    continue
                for i, raw in zip(members, raws):
                    if len(fresh[i]) == 1 and shown in SINGLE or _VALID[cipher.written].search(raw) is None:
                        continue
                    text = _text_of(raw, cipher.written)
                    if cipher.times == 2:
                        again = _bytes_of(text, shown)
                        text = _text_of(again, cipher.written) if again is not None else fresh[i]
                    if text == fresh[i]:
                        continue
                    replaced = cipher.written == "utf-8" and b"\xef\xbf\xbd" in raw  # letters were lost before it was read wrongly
                    if replaced or text.count(LOST) * 4 <= len(text):
                        owner.append(i)
                        which.append(k)
                        texts.append(text.replace("\0", LOST))
                        sure.append(replaced)
        if texts:
            odds = np.where(sure, SURE, self.model.score(texts) - plain[owner])
            for i, k, text, odd in zip(owner, which, texts, odds.tolist()):
                if odd > NEGLIGIBLE:
                    found[i].append((k, odd, text))
        known.update(zip(fresh, map(tuple, found)))


def _reading(options: list[tuple[int, float, str]]) -> Reading:
    options = [x for x in options if x[1] > NEGLIGIBLE]
    if not options:
        return CLEAN
    k, odd, text = max(options, key=lambda x: (x[1], -x[0]))
    top = max(0.0, odd)
    total = np.exp(-top) + sum(np.exp(o - top) for _, o, _ in options)
    kept = tuple((c, float(np.exp(o - top) / total), t) for c, o, t in options)
    clean = float(np.exp(-top) / total)
    # units likelier clean than anything else count as such: a rare sign in many rows mustn't become a cipher by small shares
    return Reading(k, odd, text, kept, clean) if odd > 0 else CLEAN


#: By code page shown: the characters it has, their bytes as characters of the same number, and the ciphers.
_REPERTOIRE = {c: frozenset(code_page(c).values()) for c in SINGLE}
_BYTES = {c: {ord(char): chr(byte) for byte, char in code_page(c).items()} for c in SINGLE}
_BY_SHOWN: dict[str, list[int]] = {}
for _k, _c in enumerate(CIPHERS):
    _BY_SHOWN.setdefault(_c.shown, []).append(_k)


#: A reading in several bytes a letter must hold at least one whole letter.
_VALID = {"utf-8": re.compile(b"[\xc2-\xf4][\x80-\xbf]"), "gbk": re.compile(b"[\x81-\xfe][\x40-\xfe]"), "big5": re.compile(b"[\x81-\xfe][\x40-\xfe]")}
#: Pages that show characters from U+2E80 on.
_WIDE_PAGES = tuple(c for c in MULTI if c != "utf-8")
_SHOWN: dict[frozenset, tuple[str, ...]] = {}


def _shown_as(unit: str) -> tuple[str, ...]:
    """The code pages that have the unit's characters."""
    highest = max(unit)
    if highest >= "⺀" and highest != LOST:
        return _WIDE_PAGES
    special = frozenset(c for c in unit if c > "\x7f")
    if special not in _SHOWN:
        if len(_SHOWN) > MOST_REMEMBERED:
            _SHOWN.clear()
        _SHOWN[special] = tuple(c for c in SINGLE if special <= _REPERTOIRE[c]) + (("utf-8",) if highest < "ࠀ" else ())
    return _SHOWN[special]


def _bytes_of(unit: str, shown: str) -> bytes | None:
    if shown in SINGLE:
        return unit.translate(_BYTES[shown]).encode("latin-1") if {c for c in unit if c > "\x7f"} <= _REPERTOIRE[shown] else None
    try:
        return unit.encode(shown)
    except UnicodeEncodeError:
        return None


def _text_of(raw: bytes, written: str, errors: str = "replace") -> str:
    if written in MULTI:
        return raw.decode(written, errors)
    try:
        return raw.decode(written)
    except UnicodeDecodeError:  # bytes without a character
        page = code_page(written)
        return "".join(page.get(byte, chr(byte)) for byte in raw)


def readings(unit: str, errors: str = "replace", written: tuple[str, ...] = (*SINGLE, *MULTI)) -> Iterator[tuple[int, str]]:
    """What the unit deciphers to under each cipher that can have shown its characters. A lone letter is no evidence
    for any cipher that gives a letter for a letter. errors: 'strict' leaves out what can't be decoded whole."""
    for shown in _shown_as(unit):
        raw = _bytes_of(unit, shown)
        if raw is None:
            continue
        for k in _BY_SHOWN[shown]:
            cipher = CIPHERS[k]
            if len(unit) == 1 and (shown in SINGLE or cipher.written in SINGLE):
                continue
            if cipher.written not in written or shown == "utf-8" and cipher.written != "gbk":
                continue
            try:
                text = _text_of(raw, cipher.written, errors)
                if cipher.times == 2:
                    again = _bytes_of(text, shown)
                    if again is None:
                        continue
                    text = _text_of(again, cipher.written, errors)
            except UnicodeDecodeError:
                continue
            yield k, text


class _Kinds(dict):
    """Characters to letters for their kind: a A ASCII, l L Latin, c C Cyrillic, r rare Cyrillic, h H common and rare
    Chinese, o other letters, x never in text, p punctuation, s symbols."""

    def __missing__(self, code: int) -> str:
        char, kind = chr(code), unicodedata.category(chr(code))
        if code < 0x80:
            out = "A" if kind == "Lu" else "a" if kind == "Ll" else "p"
        elif CONTROL.match(char) or char == LOST or kind in ("Co", "Cn", "Cs", "Mn"):
            out = "x"
        elif 0x410 <= code < 0x450 or code in (0x401, 0x451):
            out = "C" if kind == "Lu" else "c"
        elif 0x400 <= code < 0x530:
            out = "r"
        elif 0x4E00 <= code < 0xA000:
            try:
                out = "h" if char.encode("gb2312")[0] <= 0xD7 else "H"
            except UnicodeEncodeError:
                out = "H"
        elif kind[0] == "L":
            out = "o" if code >= 0x250 or kind == "Lo" else "L" if kind == "Lu" else "l"
        else:
            out = "p" if kind[0] in "PZ" else "s"
        self[code] = out
        return out


_KINDS = _Kinds()
#: What words of no language look like, and how much each place counts.
_STRANGE = [
    (re.compile("x"), 4), (re.compile("[rHo]|(?<=[aAlLcC])s|s(?=[aAlLcC])|(?<=[lL][lL])[lL]"), 2),
    (re.compile("[ac](?=[LC])|[lc](?=[ALC])|[aAlL](?=[cC])|[cC](?=[aAlL])|[lL](?=[hH])|[hH](?=[lL])|(?<=[a])[hH](?=a)"), 2),
    (re.compile("(?<![cC])CC+(?!c)"), 1),
]


def strangeness(text: str) -> int:
    kinds = text.translate(_KINDS)
    return sum(weight * len(pattern.findall(kinds)) for pattern, weight in _STRANGE)


def suspect(unit: str) -> bool:
    """Whether the unit looks less strange in one of its strict readings, or no stranger as UTF-8, which other text
    hardly ever is."""
    own = strangeness(unit)
    for k, text in readings(unit, "strict", ("utf-8",) if own == 0 else (*SINGLE, *MULTI)):  # nothing is less strange than 0
        if text != unit and strangeness(text) < own + (CIPHERS[k].written == "utf-8"):
            return True
    return False


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about PIECE bytes of text: what a worker holds doesn't depend on the texts' lengths."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + PIECE, "right")))
            yield batch.slice(low, high - low)
            low = high


def _batch_units(batch: pa.RecordBatch) -> tuple[list[str], list[list[str]]]:
    return batch.column(0).to_pylist(), [UNIT.findall(t) for t in batch.column(1).to_pylist()]


def _by_source(sources: list[str], units: list[list[str]]) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for source, row in zip(sources, units):
        number = out.setdefault(source, {})
        for u in row:
            number[u] = number.get(u, 0) + 1
    return out


def _rows_of(kind: str, cells: np.ndarray, values: np.ndarray, names: pa.Array | None = None) -> pa.RecordBatch:
    """Rows (kind, source, cell, name, value) of a table without sources."""
    n = len(cells)
    names = pa.repeat(pa.scalar(""), n) if names is None else names
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(kind), n), pa.repeat(pa.scalar(""), n), pa.array(cells, pa.int64()), names, pa.array(values, pa.float64())],
        ["kind", "source", "cell", "name", "value"],
    )


def _learn(model: Bigrams | None, shares: dict, last: bool = False):
    """One scan: rows (kind, source, cell, name, value) of the tables of the next round. last: also the pairs of characters outside
    ASCII by source, in SPREAD sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, reader = Bigrams(), Decipherer(model, shares) if model is not None else None
        mass: dict[tuple[str, str], float] = {}
        letters: dict[tuple[str, str], float] = {}
        suspects: dict[str, bool] = {}
        for batch in _pieces(batches):
            names, weights, parts = [], [], []
            by_source = _by_source(*_batch_units(batch))
            if reader is not None:
                reader.read(u for number in by_source.values() for u in number)
            for source, number in by_source.items():
                part = int(source or 0) % SPREAD
                for u, n in number.items():
                    read = reader.one(source, u) if reader is not None else CLEAN
                    for k, p, text in read.options:
                        key = (source, CIPHERS[k].name)
                        mass[key] = mass.get(key, 0.0) + p * n
                        names.append(text.replace("\0", LOST))
                        weights.append(p * n)
                        parts.append(part)
                        if CIPHERS[k].written in SINGLE and CIPHERS[k].shown in SINGLE:
                            for a, b in zip(u, text):
                                if a != b:
                                    letters[key[1], a + b] = letters.get((key[1], a + b), 0.0) + p * n
                    clean = n * read.clean
                    if read.cipher < 0:
                        if u not in suspects:
                            if len(suspects) > MOST_REMEMBERED:
                                suspects.clear()
                            suspects[u] = suspect(u)
                        clean *= SUSPECT if suspects[u] else 1.0
                    names.append(u.replace("\0", LOST))
                    weights.append(clean)
                    parts.append(part)
                mass[source, ""] = mass.get((source, ""), 0.0) + float(sum(number.values()))
            counts.add(names, np.array(weights, dtype=float))
            if last and names:
                codes, at = Bigrams.codes(names)
                low = (codes[:-1] < substitution.BEYOND) & (codes[1:] < substitution.BEYOND) & ((codes[:-1] >= 0x80) | (codes[1:] >= 0x80))
                lengths = np.diff(np.append(at, len(codes) - 1))
                keys = np.repeat(np.array(parts, np.int64), lengths)[low] << 32 | codes[:-1][low].astype(np.int64) << 16 | codes[1:][low].astype(np.int64)
                cells, place = np.unique(keys, return_inverse=True)
                found = np.bincount(place, np.repeat(np.array(weights, dtype=float), lengths)[low], len(cells))
                yield _rows_of("spread", cells & 0xFFFFFFFF, found, pa.array(cells >> 32).cast(pa.string()))
        for kind, table in (("pair", counts.pairs), ("char", counts.chars), ("class", counts.classes.ravel())):
            at = np.flatnonzero(table)
            if len(at):
                yield _rows_of(kind, at, table[at])
        rows = []
        rows += [("share", s, 0, c, v) for (s, c), v in mass.items()]
        rows += [("letter", c, 0, ab, v) for (c, ab), v in letters.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["kind", "source", "cell", "name", "value"])

    return run


def _unexplained(learned: Learned):
    """Counts of neighbours (source, kind, a, b, n) of units; kind 'odd': of units that no known cipher explains and that look
    likelier as letters shown by unknown characters than as they stand. a = b = -1: the number of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Decipherer(learned.model, learned.shares)
        for batch in _pieces(batches):
            slots, units = _batch_units(batch)
            sources = batch.column(2).to_pylist()
            slot_of, by_source = dict(zip(sources, slots)), _by_source(sources, units)
            reader.read(u for number in by_source.values() for u in number)
            every = list(by_source)
            low = [(i, u, n) for i, source in enumerate(every) for u, n in by_source[source].items() if max(u) < chr(substitution.BEYOND)]
            if not low:
                continue
            codes, at = Bigrams.codes([u.replace("\0", LOST) for _, u, _ in low])
            special = codes >= 0x80
            touched = special[:-1] | special[1:]
            plain = np.add.reduceat(learned.language.logs(codes), at)
            unknown = -np.add.reduceat(substitution.UNKNOWN * special[:-1] + substitution.STEP * touched, at)
            odd = plain < unknown + substitution.PRIOR
            odd &= np.array([reader.one(slot_of[every[i]], u).cipher < 0 for i, u, _ in low])
            number_of, owner = np.array([float(n) for _, _, n in low]), np.array([i for i, _, _ in low], np.int64) * 2 + odd
            lengths = np.diff(np.append(at, len(codes) - 1))
            pairs = np.repeat(owner, lengths)[touched] << 32 | codes[:-1][touched].astype(np.int64) << 16 | codes[1:][touched].astype(np.int64)
            cells, place = np.unique(pairs, return_inverse=True)
            found = np.bincount(place, np.repeat(number_of, lengths)[touched], len(cells))
            yield substitution.count_rows(every, cells >> 32, cells >> 16 & 0xFFFF, cells & 0xFFFF, found)
            total = np.bincount(owner, number_of)
            sets = np.flatnonzero(total)
            yield substitution.count_rows(every, sets, np.full(len(sets), -1), np.full(len(sets), -1), total[sets])

    return run


@dataclass
class Learned:
    model: Bigrams
    shares: dict[str, dict[str, float]]
    letters: dict[str, dict[str, str]]
    language: substitution.Language


def learn(texts: DataFrame, rounds: int = 3) -> Learned:
    """EM over texts (source, text). The first scan counts bigrams as they stand, suspects at a low weight; each
    further round is one E and M step. What is collected is bounded by the sizes of the tables."""
    model, shares, letters = None, {}, {}
    for k in range(rounds):
        counted = texts.mapInArrow(
            _learn(model, shares, k == rounds - 1), "kind string, source string, cell bigint, name string, value double"
        ).groupBy("kind", "source", "cell", "name").agg(F.sum("value").alias("value"))
        among = F.col("kind") == "spread"  # what all sources but the largest have of a pair
        found = counted.groupBy("kind", "source", "cell", F.when(~among, F.col("name")).otherwise("").alias("name")).agg(
            (F.sum("value") - F.max(F.when(among, F.col("value")).otherwise(0.0))).alias("value")
        ).toArrow()
        kind = np.array(found.column("kind").to_pylist(), dtype=object)
        cell, value = found.column("cell").to_numpy(), found.column("value").to_numpy()
        pairs, chars, classes = np.zeros(BIGRAMS), np.zeros(CHARS), np.zeros(CLASSES**2)
        pairs[cell[kind == "pair"]] = value[kind == "pair"]
        chars[cell[kind == "char"]] = value[kind == "char"]
        classes[cell[kind == "class"]] = value[kind == "class"]
        first = model is None
        model = Bigrams(pairs, chars, classes.reshape(CLASSES, CLASSES))
        if not first:
            rows = [r for r in found.filter(pa.array(np.isin(kind, ["share", "letter"]))).to_pylist()]
            total = {r["source"]: r["value"] for r in rows if r["kind"] == "share" and not r["name"]}
            mass = {(r["source"], r["name"]): r["value"] for r in rows if r["kind"] == "share" and r["name"]}
            shares = {s: {c.name: (mass.get((s, c.name), 0.0) + 0.02) / (total[s] + 1.0) for c in CIPHERS} for s in total}
            best: dict[tuple[str, str], tuple[float, str]] = {}
            for r in rows:
                if r["kind"] == "letter":
                    key = (r["source"], r["name"][0])
                    best[key] = max(best.get(key, (0.0, "")), (r["value"], r["name"][1]))
            letters = {}
            for (c, a), (_, b) in best.items():
                letters.setdefault(c, {})[a] = b
    return Learned(model, shares, letters, substitution.Language(cell[kind == "spread"], value[kind == "spread"], model.chars))


def _restored_line(line: str, hit: dict, tables: dict[int, dict]) -> str:
    """The line with its garbled units restored. Lone letters, which are no evidence, follow the cipher of their line if
    all other units of the line have the same one."""
    units = [u for u in UNIT.findall(line) if len(u) > 1]
    ciphers_here = {hit[u][0] if u in hit else -1 for u in units}
    whole = tables.get(next(iter(ciphers_here))) if len(ciphers_here) == 1 else None

    def one(m: re.Match) -> str:
        if m[0] not in hit:
            return m[0].translate(whole) if whole and len(m[0]) == 1 else m[0]
        k, _, text = hit[m[0]]
        return m[0].translate(tables[k]) if k in tables else text

    return UNIT.sub(one, line)


def _restore(learned: Learned, odds_needed: float):
    tables = {k: {**c.table, **{ord(a): b for a, b in learned.letters.get(c.name, {}).items()}}
              for k, c in enumerate(CIPHERS) if c.shown in SINGLE and c.written in SINGLE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Decipherer(learned.model, learned.shares)
        swapped: dict[tuple[str, str], dict[str, tuple[float, str]]] = {}

        def swap(shown: str, letters: str, units: list[str]) -> dict[str, tuple[float, str]]:
            """The units that the source's own swap explains better than anything else: log odds, deciphered."""
            known, table = swapped.setdefault((shown, letters), {}), str.maketrans(shown, letters)
            fresh = [u for u in dict.fromkeys(units) if u not in known and u.translate(table) != u]
            if fresh:
                texts = [u.translate(table) for u in fresh]
                (codes, at), (own, _) = Bigrams.codes(texts), Bigrams.codes(fresh)  # equal lengths, so equal places
                odds = np.add.reduceat(learned.language.logs(codes) - learned.language.logs(own), at) + substitution.PRIOR
                known.update(zip(fresh, zip(odds.tolist(), texts)))
            return known

        for batch in _pieces(batches):
            slots, units = _batch_units(batch)
            texts, shown, letters, throughout = (batch.column(i).to_pylist() for i in (1, 3, 4, 5))
            reader.read(u for row in units for u in row)
            found, restored, lost, kinds = [], [], [], []
            for i, (slot, row) in enumerate(zip(slots, units)):
                readings_of = {u: reader.one(slot, u) for u in row}
                hit = {u: (x.cipher, x.odds, x.text) for u, x in readings_of.items() if x.cipher >= 0 and x.odds > odds_needed}
                if shown[i]:
                    own = swap(shown[i], letters[i], row)
                    hit.update({u: (LEARNED, *own[u]) for u in row if u in own and (throughout[i] or own[u][0] > max(odds_needed, hit[u][1] if u in hit else 0.0))})
                if not hit and LOST not in texts[i] and not CONTROL.search(texts[i]):
                    continue
                text = "\n".join(_restored_line(line, hit, tables) for line in texts[i].split("\n")) if hit else texts[i]
                found.append(i)
                restored.append(text)
                lost.append(LOST in text)
                kinds.append(sorted({"learned" if k == LEARNED else CIPHERS[k].name for k, _, _ in hit.values()}))
            if found:
                keep = batch.take(pa.array(found))
                yield pa.RecordBatch.from_arrays(
                    [keep.column(6), keep.column(7), pa.array(restored, pa.string()), pa.array(lost), pa.array(kinds, pa.list_(pa.string()))],
                    ["tab", "rec_key", "restored", "lost", "ciphers"],
                )

    return run


#: Number of a source's own swap among the ciphers.
LEARNED = len(CIPHERS)


def garbled(texts: DataFrame, rounds: int = 3, odds_needed: float = 1.0) -> DataFrame:
    """(tab, rec_key, restored, lost, ciphers) of the rows of texts (tab, rec_key, source, text) that are, wholly or
    partly, text read with a wrong encoding. lost: characters were replaced by U+FFFD and can't come back. ciphers: the
    swaps found in it; 'learned' is one of the source's own, whose page isn't known.

    odds_needed: log odds of garbled against clean from which a unit counts. Defined cases: null and empty texts and
    texts in ASCII aren't garbled; a null source is a source; repeated rows give repeated results; no rows give none.
    """
    scratch = Scratch(texts.sparkSession, "garbled")
    ship_package(texts.sparkSession)
    source = F.coalesce("source", F.lit(""))
    rows = texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).select(
        F.pmod(F.xxhash64(source), F.lit(SLOTS)).cast("string").alias("slot"), "text", source.alias("source"), "tab", "rec_key"
    )
    learned = learn(rows.select(F.col("slot").alias("source"), "text"), rounds)
    own = scratch.cut(substitution.learn_substitutions(rows.select("slot", "text", "source"), _unexplained(learned), learned.language), "own")
    rows = rows.join(own.drop("gain"), "source", "left").select("slot", "text", "source", "shown", "letters", "throughout", "tab", "rec_key")
    return rows.mapInArrow(
        _restore(learned, odds_needed), "tab string, rec_key string, restored string, lost boolean, ciphers array<string>"
    )
