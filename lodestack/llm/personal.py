"""Personal information inside free text: candidates, boosted trees, calibrated thresholds.

1. High-recall generators propose spans that may overlap: anything built like an e-mail address, a phone or identity
   number, a street address, or the name of a person.
2. Boosted trees, one model per kind, score each span by its format and by the words around it.
3. Spans above the kind's threshold, calibrated on held-out rows, are selected best first without overlaps, and
   replaced by a placeholder of their kind.

No labelled rows come with the data, so the models are trained on rows labelled by construction: `training_rows`
invented lines (invented.py) with known spans and look-alikes. The corpus itself is only scanned: many texts are
joined, generators run over the joined text, and all features of all spans are computed as arrays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import lexicon
from lodestack.llm.boosting import Boosted
from lodestack.llm.invented import Invented
from lodestack.llm.scan import BIT, CASELESS, CLASS, DIGIT, GIVEN_HAN, HAN, HAN_BIT, HAN_PHRASES, LINE, LOWER, SPACE, SURNAME, UPPER, WORDS, Scan
from lodestack.session import ship_package

KINDS = ("email", "phone", "id", "address", "name")
#: Characters of text handled at once in a Python worker, besides the last text of a piece.
PIECE = 1 << 20
#: A name has at most so many words, not counting initials and particles.
NAME_WORDS = 4

#: F1 given up for recall when a kind's threshold is calibrated, if not 0.005.
SLACK = {"name": 0.001}

_L = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿḀ-ỿ"
_U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶŁŃŇŐŒŘŚŞŠŢŤŪŮŰŹŻŽΑ-ΩА-ЯЁІЇЄ"
_DOT = r"(?:\.| ?[\[({] ?(?:dot|DOT|Dot|punto|point|\.) ?[\])}] ?| (?:dot|DOT|Dot|punto) )"
_AT = re.compile(r"@|[\[({<] ?(?:at|AT|At|arroba|@) ?[\])}>]| (?:at|AT|At|arroba) (?=[A-Za-z0-9])")
_DOMAIN = re.compile(rf" ?[A-Za-z0-9À-ɏ-]+(?:{_DOT}[A-Za-z0-9-]+)*")
_LABELS = re.compile(_DOT)
_GLUED = re.compile(r"(?<=[. ])[a-z]{2,}(?=(?:[A-Z][A-Za-z]*|\d[\w.]*)\Z)")
_SPELT = re.compile(rf"[A-Za-z0-9%+_-]+(?:{_DOT}[A-Za-z0-9%+_-]+)* ?\Z")
_NUMBER = re.compile(r"(?:\(?\+ ?)?\(?\d+(?:(?:[ \xa0]?[-–‐‑./][ \xa0]?|\)[ \xa0]?[-/]?[ \xa0]?|[ \xa0])\(?\d+)*")
_CODE = re.compile(r"(?:[A-Z]{1,4}[ -]?)?\d[0-9A-Z]*(?:[ -](?:\d[0-9A-Z]*|[A-Z]{1,2}(?![A-Za-z])))*[Xx]?(?![A-Za-z0-9])")
_PARTICLE = "(?:von|van|de|der|den|du|la|le|zu|zum|zur|del|della|dos|da|di|y|ten|ter|bin|al|el|ibn|af|av)"
_WORD = rf"[{_U}][{_L}’'-]*\.?"
_RUN = re.compile(rf"{_WORD}(?:,?[ \xa0](?:{_PARTICLE}[ \xa0])*{_WORD})+")
_CAPITAL = re.compile(rf"[{_U}][{_L}’'-]*\.?")
_TITLE_CASE = re.compile(r"[A-Z][a-z]")

_UPPER_WORD = rf"[{_U}][{_L}’'-]*\.?"
_UNIT_EN = r"(?:,? (?:Apt|Flat|Unit|Suite|Apartment|Ste|#)\.? ?\w+)?"
_TOWN = rf"(?:(?:,|,?\n|,? in| -|,? à) ?(?:\d{{4,5}} )?[{_U}][{_L}’'-]+(?:[ -][{_U}][{_L}’'-]+)*)?"
_POST = r"(?:,? (?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5}|\d{5}))?"
_AFTER_EN = "|".join(w.capitalize() for w in sorted(lexicon.STREET_AFTER.split(), key=len, reverse=True))
_HOUSE_FIRST = re.compile(
    rf"\d+[A-Za-z]?(?:[-–/]\d+)?(?: (?:bis|ter|quater))?,? (?:(?:(?:St|Mt|N|S|E|W|NE|NW|SE|SW)\.? )?(?:(?:[{_U}][{_L}’'-]*|\d+(?:st|nd|rd|th))\.? )+?(?:{_AFTER_EN})(?![{_L}])\.?{_UNIT_EN}{_TOWN}{_POST}"
    rf"|(?:{'|'.join(lexicon.STREET_BEFORE_FR.split())}) (?:[{_L}’'.-]+ )*?[{_U}][{_L}’'-]*(?: [{_U}][{_L}’'-]*)*{_TOWN})"
)
_STREET_FIRST = re.compile(
    rf"(?=[CAPRVупнбш])(?:{lexicon.STREET_BEFORE})(?:(?<=[./])|(?![{_L}]))(?: ?(?:de|del|la|las|los|el|da|do|dos|dei|della|di|von|{_UPPER_WORD}|\d+(?:-я|-й)?))+,? (?:nº |n\.º |núm\. |num\. |№ ?|д\. ?|дом )?\d+[{_L}]?(?![\w])(?:, ?\d+\.?º ?\w?)?(?:, (?:кв|корп|к|стр)\. ?\d+)*(?:, г\. ?[{_U}][{_L}-]+)?{_TOWN}"
)
_NAMED_FIRST = re.compile(
    rf"[{_U}][{_L}-]+ (?:{lexicon.STREET_AFTER_RU.replace('.', chr(92) + '.')}),? (?:д\. ?|дом )?\d+[{_L}]?(?![\w])(?:, (?:кв|корп|к|стр)\. ?\d+)*(?:, г\. ?[{_U}][{_L}-]+)?{_TOWN}"
)
_PREPOSITION = re.compile(rf"[AIZUHVB](?:m|n|uf|ur|um|nter|inter|or|ei|eim) (?:d(?:er|em|en) )?(?:[{_U}][{_L}ß-]+ ){{1,3}}\d+ ?[a-h]?\b(?=,|\n\d| in|\.|$|\n)(?:(?:,|\n|,? in) ?(?:\d{{5}} )?[{_U}][{_L}-]+)?")
_AFTER_HOUSE = re.compile(rf" ?[a-h]?\b(?:(?:,|,?\n|,? in) ?(?:\d{{5}} )?[{_U}][{_L}-]+(?: [{_U}][{_L}-]+)?)?")
_TOWN_BEFORE = re.compile(rf"(?:г\. ?|город |[{_U}][{_L}-]+, )(?:[{_U}][{_L}-]+, )?\Z")
_HAN_HOUSE = re.compile("(?:路|街|道|巷|弄|里|胡同)\\d+[号弄](?:[0-9A-Z]+[栋楼室号单元层座幢]+)*")
_TOWN_ENDS = frozenset(lexicon.HAN_TOWN_ENDS)


class _Found:
    """Spans of one kind with the features that only their generator knows."""

    def __init__(self, extras: int):
        self.start: list[int] = []
        self.end: list[int] = []
        self.more: list[tuple] = []
        self.extras = extras

    def add(self, start: int, end: int, *more: float) -> None:
        self.start.append(start)
        self.end.append(end)
        self.more.append(more)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.start, np.int64), np.array(self.end, np.int64), np.array(self.more, float).reshape(-1, self.extras)


def _emails(scan: Scan) -> tuple:
    text, found = scan.text, _Found(7)
    for m in _AT.finditer(text):
        sign = m[0]
        if sign[0] == " " and " dot " not in text[m.end():m.end() + 80].lower() and "." not in text[m.end():m.end() + 80]:
            continue
        host = _DOMAIN.match(text, m.end())
        if host is None:
            continue
        stop = m.start()
        if sign[0] != " " and text[stop - 1:stop] == " ":
            stop -= 1
        begin = stop
        while begin > 0 and (text[begin - 1] in "._%+-'" or (text[begin - 1].isalnum() and text[begin - 1] < "ɐ")):
            begin -= 1
        while True:  # words for dots in the local part
            for word in (" dot ", " DOT ", "[dot]", "(dot)", " [dot] ", " (dot) "):
                if text.endswith(word, 0, begin):
                    before = _SPELT.search(text, max(0, text.rfind("\n", 0, begin) + 1), begin - len(word))
                    if before is not None and before.end() == begin - len(word):
                        begin = before.start()
                        break
            else:
                break
        while begin < stop and text[begin] in "._%+-'":
            begin += 1
        if begin >= stop or not text[stop - 1].isalnum() and text[stop - 1] != "_":
            continue
        end = host.end()
        while text[end - 1] == "-":
            end -= 1
        glued = _GLUED.search(text, m.end(), end)  # what follows may stand right behind the last label
        for stop in {end, glued.end()} if glued else {end}:
            labels = [x.strip() for x in _LABELS.split(text[m.end():stop])]
            last = labels[-1]
            found.add(begin, stop, len(labels), len(last), last.isalpha(), last.lower() in _FILE_TYPES, 1 if sign == "@" else 2 if sign[0] != " " else 3, labels[0][:1].isdigit(), min(len(x) for x in labels))
    return found.arrays()


_FILE_TYPES = frozenset(lexicon.FILE_TYPE.split())


def _numbers(scan: Scan) -> tuple[tuple, tuple]:
    """Spans of digits as phone numbers, and those and codes with letters as identity numbers."""
    text, phone, identity = scan.text, [], set()
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if b - a < 6:
            continue
        phone.append((a, b))
        cut = text.find(" ", a, b)
        if cut > 0 and b - cut > 6 and text[cut + 1] not in ")/-.":
            phone.append((cut + 1, b))
    for m in _CODE.finditer(text):
        if m.end() - m.start() >= 7:
            identity.add(m.span())
    spans = np.array(phone, np.int64).reshape(-1, 2)
    identity.update(x for x in phone)
    codes = np.array(sorted(identity), np.int64).reshape(-1, 2)
    out = []
    for s, least in ((spans, 6), (codes, 5)):
        a, b = s[:, 0], s[:, 1]
        digits = scan.count("digit", a, b)
        before = scan.code_at(a - 1)
        joined = np.isin(scan.class_at(a - 1), (LOWER, UPPER, CASELESS, DIGIT)) | np.isin(before, [ord(c) for c in "_\\"])
        keep = (digits >= least) & ~joined & (scan.class_at(b) != DIGIT)
        a, b = a[keep], b[keep]
        year = scan.number(a + 6, 4)
        month, day = scan.number(a + 10, 2), scan.number(a + 12, 2)
        born = (year >= 1900) & (year <= 2035) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
        out.append((a, b, born[:, None].astype(float)))
    return out[0], out[1]


def _addresses(scan: Scan) -> tuple:
    text, found = scan.text, _Found(4)

    def free(at: int) -> bool:
        before = text[at - 1:at]
        return not (before.isalnum() and not "一" <= before <= "鿿") and before not in ("\\", "/", "_", ".", "-")

    for kind, pattern in ((1, _HOUSE_FIRST), (2, _STREET_FIRST), (3, _NAMED_FIRST), (4, _PREPOSITION)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if not free(a) and not (kind == 2 and text[a - 1:a] == "."):
                continue
            found.add(a, b, kind, 0, 0, 0)
            if kind in (2, 3, 4):
                town = _TOWN_BEFORE.search(text, max(0, text.rfind("\n", 0, a) + 1, a - 80), a)
                if town is not None and free(town.start()):
                    found.add(town.start(), b, kind + 10, 0, 0, 0)
    # a word for a street right before a number
    house = np.flatnonzero((scan.kind[1:] == 2) & (scan.kind[:-1] == 1)) + 1
    gap = scan.first[house] - scan.last[house - 1]
    house = house[(gap <= 2) & (gap >= 1) & (scan.code_at(scan.first[house] - 1) == 32)]
    ending = np.zeros(len(house), bool)
    for size in range(2, 8):
        ending |= _ENDINGS.of(scan.hashes(np.maximum(scan.last[house - 1] - size, scan.first[house - 1]), scan.last[house - 1])) > 0
    ending &= scan.last[house - 1] - scan.first[house - 1] >= 3
    for j in house[ending].tolist():
        k, a = j - 1, int(scan.first[j - 1])
        after = _AFTER_HOUSE.match(text, int(scan.last[j]))
        end = after.end() if after else int(scan.last[j])
        words = 0
        while True:
            if text[a].isupper() and free(a):
                found.add(a, end, 5, words, 0, 0)
                words += 1
                if words == 1 or words == 2:
                    town = _TOWN_BEFORE.search(text, max(0, text.rfind("\n", 0, a) + 1, a - 80), a)
                    if town is not None and free(town.start()):
                        found.add(town.start(), end, 15, words, 0, 0)
            if words > 3 or k == 0 or text[a - 1] not in " -" or scan.last[k - 1] != a - 1 or scan.kind[k - 1] != 1:
                break
            k, a = k - 1, int(scan.first[k - 1])
    for m in _HAN_HOUSE.finditer(text):
        at = m.start()
        begin = at
        while begin > 0 and ("一" <= text[begin - 1] <= "鿿"):
            begin -= 1
        towns = [p for p in range(max(begin, at - 24), at) if text[p] in _TOWN_ENDS]
        starts = {p - k for p in towns for k in range(1, 5)} | {at - k for k in range(1, 7)}
        for a in sorted(s for s in starts if begin <= s < at):
            first_town = next((p for p in towns if p > a), None)
            found.add(a, m.end(), 6, first_town - a if first_town is not None else 0, at - a, a == begin)
    return found.arrays()


class _Endings:
    def __init__(self):
        from lodestack.llm.scan import word_hash

        self.keys = np.array(sorted({word_hash(w.rstrip(".")) for w in lexicon.STREET_ENDINGS.split()}), dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes


_ENDINGS = _Endings()
_TITLES = frozenset(lexicon.TITLE.split())


def _names(scan: Scan) -> tuple:
    """Spans of capitalised words, and Chinese surnames with one or two characters after them at every place."""
    text = scan.text
    start, end, initials, commas, words_in = [], [], [], [], []
    for m in _RUN.finditer(text):
        low = m.start()
        before = text[low - 1:low]
        if before and (before.isalnum() and not "一" <= before <= "鿿" or before in "_\\@/."):
            low = -1  # the first word belongs to what stands before it
        words = [(w.start(), w.end()) for w in _CAPITAL.finditer(text, m.start(), m.end())]
        n = len(words)
        small = [w_end - w_start <= 2 and text[w_end - 1] == "." or w_end - w_start == 1 for w_start, w_end in words]
        heads = (low,)
        if low >= 0:  # particles before the first word
            head = low
            while True:
                space = text.rfind(" ", 0, head - 1) if text[head - 1:head] == " " else -1
                word = text[max(space, text.rfind("\n", 0, head - 1), text.rfind("\0", 0, head - 1)) + 1:head - 1] if text[head - 1:head] == " " else ""
                if not word or word not in _PARTICLES:
                    break
                head -= len(word) + 1
            while head < low and text[head:text.index(" ", head)] in _NEVER_FIRST:
                head = text.index(" ", head) + 1
            heads = (low, head) if head < low else (low,)
        for i in range(0 if low >= 0 else 1, n - 1):
            if text[words[i][0]:words[i][1]].rstrip(".").lower() in _TITLES and not small[i]:
                continue
            full, comma, short = not small[i], 0, int(small[i])
            full = int(full)
            for j in range(i + 1, n):
                last = text[words[j - 1][1] - 1]
                if last == "." and not small[j - 1]:
                    break  # a sentence ends in between
                comma += text[words[j - 1][1]] == ","
                if comma > 1:
                    break
                full += not small[j]
                short += small[j]
                if full > NAME_WORDS:
                    break
                stop = words[j][1]
                if text[stop - 1] == "." and not small[j]:
                    stop -= 1
                if full == 0:
                    continue
                for begin in heads if i == 0 else (words[i][0],):
                    start.append(begin)
                    end.append(stop)
                    initials.append(short)
                    commas.append(comma)
                    words_in.append(full)
    latin = np.stack([np.array(x, float) for x in (initials, commas, words_in)] + [np.zeros(len(start))], axis=1) if start else np.zeros((0, 4))
    # Chinese
    han = np.flatnonzero((scan.cls[:-1] == HAN) & (scan.cls[1:] == HAN))
    double = HAN_PHRASES.of(scan.hashes(han, han + 2)) & HAN_BIT["compound"] > 0
    parts = []
    for size, which in ((2, double), (1, SURNAME[scan.small[han]])):
        at = han[which]
        for given in (1, 2):
            ok = np.ones(len(at), bool)
            for k in range(given):
                ok &= scan.class_at(at + size + k) == HAN
            a = at[ok]
            if size == 1:  # common words that begin or end with the surname's character aren't names
                a = a[(HAN_PHRASES.of(scan.hashes(a, a + 2)) & HAN_BIT["word"] == 0)]
                backed = GIVEN_HAN[scan.code_at(a + 1)] | _cued(scan, a)
                a = a[backed]
            parts.append((a, a + size + given, size, given))
    starts = np.concatenate([np.array(start, np.int64), *[p[0] for p in parts]])
    ends = np.concatenate([np.array(end, np.int64), *[p[1] for p in parts]])
    more = [np.concatenate([latin, np.zeros((len(latin), 10))], axis=1)]
    for a, b, size, given in parts:
        word = HAN_BIT["word"]
        cols = [np.zeros(len(a))] * 3 + [np.full(len(a), 1.0), np.full(len(a), float(size)), np.full(len(a), float(given)), GIVEN_HAN[scan.code_at(a + size)], GIVEN_HAN[scan.code_at(b - 1)]]
        for x, y in ((a, a + 2), (a - 1, a + 1), (b - 1, b + 1), (a + size, a + size + 2), (b, b + 2), (b - 2, b)):
            cols.append(HAN_PHRASES.of(scan.hashes(x, y)) & word > 0)
        more.append(np.stack([np.asarray(c, float) for c in cols], axis=1))
    return starts, ends, np.concatenate(more)


_NEVER_FIRST = ("der", "den", "du", "zum", "zur", "dos")
_PARTICLES = frozenset(lexicon.PARTICLE.split()) - {"y", "of", "und"}


def _cued(scan: Scan, at: np.ndarray) -> np.ndarray:
    """Whether a Chinese cue of names or a border stands right before."""
    out = ~np.isin(scan.class_at(at - 1), (HAN,))
    for size in (1, 2, 3):
        out |= HAN_PHRASES.of(scan.hashes(at - size, at)) & HAN_BIT["before_name"] > 0
    return out


def candidates(scan: Scan) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By kind: starts, ends and the generator's own features of all proposed spans, overlapping ones included."""
    phone, identity = _numbers(scan)
    return {"email": _emails(scan), "phone": phone, "id": identity, "address": _addresses(scan), "name": _names(scan)}


_NEAR = ("phone", "identity", "address", "before_name", "title", "counted", "organisation", "given", "common", "file_type")
_AHEAD = ("after_name", "organisation", "counted", "given", "common", "phone", "street")
_INSIDE = ("given", "family", "organisation", "common", "particle", "counted", "street", "before_name", "title", "file_type")
_SIGNS = "+(.-/: ,@_\\"
_BEFORE_SIGNS, _AFTER_SIGNS = ":;,(\"“”'<[\\/@#_-.=、。，", ":;,.)\"”'>]\\/@_-%?!、。，("


def features(scan: Scan, s: np.ndarray, e: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Format and context of spans, a row each."""
    cols: list[np.ndarray] = [e - s]
    for name in ("digit", "letter", "upper", *_SIGNS):
        cols.append(scan.count(name, s, e))
    first_digit, last_digit = np.searchsorted(scan.digit_first, s), np.searchsorted(scan.digit_last, e, "right")
    groups = last_digit - first_digit
    cols.append(groups)
    sizes = np.append(scan.digit_last - scan.digit_first, 0)
    for k in range(6):
        cols.append(np.where(groups > k, sizes[np.minimum(first_digit + k, len(sizes) - 1)], 0))
    cols.append(np.where(groups > 0, sizes[np.maximum(last_digit - 1, 0)], 0))
    head, tail = scan.class_at(s), scan.class_at(e - 1)
    cols += [head, tail, scan.code_at(s) == ord("+"), scan.code_at(s) == ord("("), scan.code_at(s) == ord("0"), scan.number(s, 1), scan.class_at(s + 1)]
    # neighbours
    left, right = scan.class_at(s - 1), scan.class_at(e)
    spaced_left = np.where(left == SPACE, scan.code_at(s - 2), scan.code_at(s - 1))
    spaced_right = np.where(right == SPACE, scan.code_at(e + 1), scan.code_at(e))
    cols += [left, right, np.where(left == SPACE, scan.class_at(s - 2), left), np.where(right == SPACE, scan.class_at(e + 1), right)]
    for signs, code in ((_BEFORE_SIGNS, spaced_left), (_AFTER_SIGNS, spaced_right)):
        table = np.zeros(1 << 16, np.int8)
        for i, c in enumerate(signs):
            table[ord(c)] = i + 1
        cols.append(table[code])
    # words
    n = len(scan.first)
    flags = np.append(scan.flags, 0).astype(np.int64)
    i0, i1 = np.searchsorted(scan.first, s), np.searchsorted(scan.last, e, "right") - 1
    i1 = np.maximum(i1, np.minimum(i0, n - 1))
    first, last = flags[np.minimum(i0, n)], flags[np.clip(i1, 0, n)]
    cols.append(i1 - i0 + 1)
    for name in _INSIDE:
        cols.append(scan.flagged(name, i0, i1 + 1))
    for name in ("given", "family", "common", "before_name", "after_name", "organisation", "counted", "title"):
        cols += [first & BIT[name] > 0, last & BIT[name] > 0]
    for at in (i0, i1):
        at = np.clip(at, 0, max(n - 1, 0))
        cols.append(scan.last[at] - scan.first[at] if n else np.zeros(len(s)))
    line = scan.lines[np.minimum(s, len(scan.lines) - 1)] if len(scan.lines) else np.zeros(len(s))
    near = {name: np.full(len(s), 6, np.int8) for name in _NEAR}
    above = {name: np.zeros(len(s), bool) for name in _NEAR[:4]}
    for k in range(5, 0, -1):
        at = i0 - k
        ok = at >= 0
        at = np.maximum(at, 0)
        same = ok & (scan.lines[scan.first[at]] == line) if n else ok
        f = flags[at]
        for name in _NEAR:
            near[name][same & (f & BIT[name] > 0)] = k
        if k <= 2 and n:
            over = ok & (scan.lines[scan.first[at]] == line - 1) & (scan.code_at(s - 1) == 10)
            for name in above:
                above[name] |= over & (f & BIT[name] > 0)
    cols += [*near.values(), *above.values()]
    ahead = {name: np.full(len(s), 4, np.int8) for name in _AHEAD}
    for k in range(3, 0, -1):
        at = i1 + k
        ok = at < n
        at = np.minimum(at, max(n - 1, 0))
        same = ok & (scan.lines[scan.first[at]] == line) if n else ok
        f = flags[at]
        for name in _AHEAD:
            ahead[name][same & (f & BIT[name] > 0)] = k
    cols += list(ahead.values())
    if n:
        before, after = np.clip(i0 - 1, 0, n - 1), np.clip(i1 + 1, 0, n - 1)
        touching = (i0 > 0) & (scan.last[before] == s - 1) & (left == SPACE)
        followed = (i1 + 1 < n) & (scan.first[after] == e + 1) & (right == SPACE)
        cols += [touching & (scan.class_at(scan.first[before]) == UPPER), followed & (scan.class_at(scan.first[after]) == UPPER), touching & (scan.class_at(scan.first[before]) == DIGIT), followed & (scan.class_at(scan.first[after]) == DIGIT)]
    else:
        cols += [np.zeros(len(s))] * 4
    cols += _han_context(scan, s, e)
    return np.concatenate([np.stack([np.asarray(c, float) for c in cols], axis=1), own], axis=1)


_HAN_NEAR = ("phone", "identity", "address", "before_name", "counted")


def _han_context(scan: Scan, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Distances of Chinese cues before a span, and whether one stands right after it."""
    out = [np.full(len(s), 12, np.int8) for _ in _HAN_NEAR]
    after = np.zeros(len(s), bool)
    close = np.zeros(len(s), bool)
    for k in range(1, 5):
        close |= scan.class_at(s - k) == HAN
    rows = np.flatnonzero(close)
    if len(rows):
        a = s[rows]
        for gap in range(9, -1, -1):
            for size in (1, 2, 3, 4, 5, 6) if gap <= 2 else (2, 3, 4):
                flags = HAN_PHRASES.of(scan.hashes(a - gap - size, a - gap))
                if not flags.any():
                    continue
                for i, name in enumerate(_HAN_NEAR):
                    if name == "before_name" and gap > 3:
                        continue
                    out[i][rows[flags & HAN_BIT[name] > 0]] = gap
    rows = np.flatnonzero(scan.class_at(e) == HAN)
    for size in (1, 2, 3):
        after[rows[HAN_PHRASES.of(scan.hashes(e[rows], e[rows] + size)) & HAN_BIT["after_name"] > 0]] = True
    return [*out, after]


@dataclass
class Models:
    by_kind: dict[str, Boosted]


_TRAINED: dict[tuple[int, int], Models] = {}


def train(training_rows: int = 24_000, seed: int = 7, frames: dict | None = None) -> Models:
    """One model per kind, trained on four fifths of the invented lines and calibrated on the rest."""
    if frames is None and (training_rows, seed) in _TRAINED:
        return _TRAINED[training_rows, seed]
    source = Invented(seed, frames)
    lines = [source.line() for _ in range(training_rows)]
    scan = Scan([text for text, _ in lines])
    real = {(k, int(scan.starts[i]) + a): int(scan.starts[i]) + b for i, (_, spans) in enumerate(lines) for k, a, b in spans}
    models = {}
    for kind, (s, e, own) in candidates(scan).items():
        close = {"name": 1, "address": 1 << 30}.get(kind, 1)
        y = np.array([abs(real.get((kind, a), -(1 << 31)) - b) <= close for a, b in zip(s.tolist(), e.tolist())], float)
        if kind == "address":
            y *= np.array([(kind, a) in real for a in s.tolist()])
        x = features(scan, s, e, own)
        held = scan.owner(s) % 5 == 0
        models[kind] = Boosted(rounds=60, depth=5).fit(x[~held], y[~held])
        models[kind].calibrate(x[held], y[held], SLACK.get(kind, 0.005))
    if frames is None:
        _TRAINED[training_rows, seed] = Models(models)
    return Models(models)


@dataclass
class Accepted:
    """Spans in order, without overlaps: the text of each, its kind, start and end within the text."""

    text: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray


def select(texts: list[str], models: Models) -> Accepted:
    """The accepted spans of all texts: best first, those that overlap a better one left out."""
    scan = Scan(texts)
    scores, kinds, starts, ends = [], [], [], []
    for k, (kind, (s, e, own)) in enumerate(candidates(scan).items()):
        if not len(s):
            continue
        model = models.by_kind[kind]
        p = model.predict(features(scan, s, e, own))
        keep = p >= model.threshold
        scores.append(np.round(p[keep], 2))
        kinds.append(np.full(int(keep.sum()), k))
        starts.append(s[keep])
        ends.append(e[keep])
    if not scores:
        return Accepted(*[np.zeros(0, np.int64)] * 4)
    p, k, a, b = (np.concatenate(x) for x in (scores, kinds, starts, ends))
    order = np.lexsort((k, a, a - b, -p))
    taken: list[tuple[int, int]] = []  # in order of their starts
    kept = []
    for i, s, e in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        at = bisect_left(taken, (s, e))
        if at < len(taken) and taken[at][0] < e or at > 0 and taken[at - 1][1] > s:
            continue
        taken.insert(at, (s, e))
        kept.append(i)
    kept = np.array(kept, np.int64)
    kept = kept[np.argsort(a[kept])]
    owner = scan.owner(a[kept])
    return Accepted(owner, k[kept], a[kept] - scan.starts[owner], b[kept] - scan.starts[owner])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in pieces of about PIECE characters and at least one text; null texts as empty ones."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    low, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= PIECE or i == len(texts) - 1:
            yield batch.slice(low, i + 1 - low), texts[low:i + 1]
            low, size = i + 1, 0


_NAMES = np.array(KINDS)


def personal_information(docs: DataFrame, training_rows: int = 24_000) -> DataFrame:
    """(doc_id, kind, start_pos, length) of every occurrence in docs (doc_id, text); start_pos counts from 1.

    Defined cases: null and empty texts have none; rows with null doc_id are ignored; repeated rows give repeated
    results; texts of any length are read whole.
    """
    ship_package(docs.sparkSession)
    models = train(training_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _pieces(batch):
                found = select(texts, models)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(found.text)), pa.array(_NAMES[found.kind].tolist(), pa.string()), pa.array(found.start + 1), pa.array(found.end - found.start)],
                    ["doc_id", "kind", "start_pos", "length"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return rows.mapInArrow(run, f"doc_id {id_type}, kind string, start_pos bigint, length bigint")


def redact(docs: DataFrame, training_rows: int = 24_000) -> DataFrame:
    """(doc_id, redacted, replaced): the texts with [EMAIL], [PHONE], [ID], [ADDRESS] and [NAME] in place of personal
    information, and how many places were replaced. Null and empty texts stay as they are."""
    ship_package(docs.sparkSession)
    models = train(training_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _pieces(batch):
                found = select(texts, models)
                parts: list[list[str]] = [[] for _ in texts]
                ends = [0] * len(texts)
                for i, k, a, b in zip(found.text.tolist(), found.kind.tolist(), found.start.tolist(), found.end.tolist()):
                    parts[i] += [texts[i][ends[i]:a], f"[{KINDS[k].upper()}]"]
                    ends[i] = b
                out = ["".join([*p, t[e:]]) if p else None if o is None else t for p, t, e, o in zip(parts, texts, ends, part.column(1).to_pylist())]
                counts = np.bincount(found.text, minlength=len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(counts)], ["doc_id", "redacted", "replaced"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, f"doc_id {id_type}, redacted string, replaced bigint")
