"""Swaps of unknown one-byte code pages as substitution ciphers, learned for each source without knowing the page.

A text of such a source shows, for each letter outside ASCII, always the same wrong character. What must be learned is the
letter of each character. The data of a source are its counts of neighbouring characters, at most a square of the 128
characters of a page and ASCII however much text there is; the language is the bigrams of the corpus. Expectation-
maximization alternates between the posterior of each character's letter, given the expected letters of its neighbours,
and what is expected of those; counts are tempered, so that early rounds don't settle anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters a character may stand for: those outside ASCII with at least this share of all of them in the corpus.
LEAST_SHARE = 2e-5
#: Characters from here on belong to no one-byte page.
BEYOND = 0x2E80
#: Cost in nats of a character of which nothing is known, and of each step from or to the letter it stands for; and the prior of a
#: unit being of an unknown page.
UNKNOWN, STEP, PRIOR = 4.2, 2.5, -4.0
#: A source is deciphered if its characters occur at least so often, are at least so many, gain so many nats each, and if of a
#: character's places in the source at least such a share can't be explained as they stand. If that holds for such a share of the
#: source's units, all of them are taken as swapped.
LEAST_SEEN, LEAST_LETTERS, LEAST_GAIN, LEAST_UNEXPLAINED = 100, 5, 4.0, 0.5
#: Nats that a step from or to a letter may cost on average in the deciphered text: more is no language that the corpus knows, such as
#: another script that only this source has.
MOST_COST = 3.2
ROUNDS = 60
SMOOTH = 5.0
SCHEMA = "source string, shown string, letters string, gain double, throughout boolean"


class Language:
    """Log probabilities of neighbours among the border, ASCII and the corpus's other letters, for those outside ASCII.

    What a source says of itself doesn't count: `spread` holds for each pair of characters (first * 2^16 + second) its places in
    all sources but the one that has most of them. A source whose letters are all wrong is strange by this measure,
    however large it is."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, chars: np.ndarray):
        """chars: how often each character stands in the corpus."""
        first, second = cells >> 16, cells & 0xFFFF
        as_second = np.bincount(second, counts, BEYOND)[:BEYOND]
        as_first = np.bincount(first, counts, BEYOND)[:BEYOND]
        others = np.flatnonzero(as_second)
        others = others[(others >= 0xA0) & (others != 0xFFFD)]
        total = max(1.0, as_second[others].sum())
        self.others = others[as_second[others] >= LEAST_SHARE * total]
        self.share = as_second[self.others] / total
        ascii_codes = np.concatenate([[0], np.arange(0x20, 0x7F)])
        codes = np.concatenate([ascii_codes, self.others])
        self.fixed, size = len(ascii_codes), len(codes) + 1  # the last stands for all others
        self.places = np.full(BEYOND, size - 1, np.int64)
        self.places[codes] = np.arange(len(codes))
        pairs = np.zeros((size, size))
        np.add.at(pairs, (self.places[first], self.places[second]), counts)
        pairs[-1], pairs[:, -1] = 0, 0
        of_first = np.append(np.where(codes < 0x80, chars[codes], as_first[codes]), 0.0)
        of_second = np.append(np.where(codes < 0x80, chars[codes], as_second[codes]), 0.0)
        usual = of_second / max(1.0, of_second.sum())
        self.log = np.log(np.maximum((pairs + SMOOTH * usual) / (of_first[:, None] + SMOOTH), 1e-7))
        self.log[-1], self.log[:, -1] = np.log(1e-6), np.log(1e-6)
        if not len(self.others):
            self.log[:] = 0.0

    def place(self, code: int) -> int:
        return int(self.places[code]) if code < BEYOND else -1

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Of each character and its successor, where one of them is outside ASCII; 0 elsewhere."""
        at = np.where(codes < BEYOND, self.places[np.minimum(codes, BEYOND - 1).astype(np.int64)], -1)
        touched = (codes[:-1] >= 0x80) | (codes[1:] >= 0x80)
        return np.where(touched, self.log[at[:-1], at[1:]], 0.0)


def solve(cells: np.ndarray, counts: np.ndarray, language: Language) -> tuple[dict[int, int], float, float]:
    """The letter of each character from the counts of neighbours (pairs of codes), the gain in nats for each place where
    such a character stands, and what a step costs in the deciphered text."""
    shown = np.unique(cells[cells >= 0x80])
    letters = len(language.others)
    if not len(shown) or not letters:
        return {}, 0.0, 0.0
    place = {int(c): i for i, c in enumerate(shown)}
    k, f = len(shown), language.fixed
    inner = np.zeros((k, k))
    before, after = np.zeros((k, f)), np.zeros((k, f))
    for (a, b), n in zip(cells.tolist(), counts.tolist()):
        if a >= 0x80 and b >= 0x80:
            inner[place[a], place[b]] += n
        elif b >= 0x80:
            before[place[b], language.place(a)] += n
        elif a >= 0x80:
            after[place[a], language.place(b)] += n
    log = language.log
    outside = before @ log[:f, f:-1] + after @ log[f:-1, :f].T  # from neighbours in ASCII
    seen = before.sum(axis=1) + inner.sum(axis=0)
    share = seen / max(1.0, seen.sum())
    near = -((np.log(share + 1e-6)[:, None] - np.log(language.share + 1e-6)[None, :]) ** 2)
    within = log[f:-1, f:-1]
    best, best_value = None, -np.inf
    for start in (np.full((k, letters), 1.0 / letters), _rows(near), _rows(outside / (1 + seen[:, None]))):
        q = start
        for step in range(ROUNDS):
            heat = min(1.0, 0.02 * 1.12**step)
            score = outside + inner.T @ (q @ within) + inner @ (q @ within.T)
            q = _assigned(heat * score)
        choice = _injective(outside + inner.T @ (q @ within) + inner @ (q @ within.T), seen)
        choice, value = _climbed(choice, outside, inner, within)
        if value > best_value:
            best, best_value = choice, value
    as_shown = [language.place(int(c)) for c in shown]
    own = sum(before[i] @ log[:f, at] + after[i] @ log[at, :f] for i, at in enumerate(as_shown)) + (inner * log[np.ix_(as_shown, as_shown)]).sum()
    return {int(c): int(language.others[choice]) for c, choice in zip(shown, best)}, (best_value - own) / max(1.0, seen.sum()), -best_value / max(1.0, counts.sum())


def _climbed(choice: np.ndarray, outside: np.ndarray, inner: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, float]:
    """The mapping after the best moves to another letter, or swaps of two letters, until none gains anything."""

    def value(c: np.ndarray) -> float:
        return float(outside[np.arange(len(c)), c].sum() + (inner * within[np.ix_(c, c)]).sum())

    best = value(choice)
    for _ in range(10 * len(choice)):
        hard = np.eye(outside.shape[1])[choice]
        score = outside + inner.T @ (hard @ within) + inner @ (hard @ within.T)
        gain = score - score[np.arange(len(choice)), choice][:, None]
        for i, letter in enumerate(choice):  # taking another's letter gives it one's own
            gain[:, letter] += gain[i, choice]
        moved = False
        for at in np.argsort(-gain, axis=None)[:8]:
            i, letter = divmod(int(at), gain.shape[1])
            if gain[i, letter] <= 1e-9:
                break
            after = np.where(choice == letter, choice[i], choice)
            after[i] = letter
            if value(after) > best + 1e-9:
                choice, best, moved = after, value(after), True
                break
        if not moved:
            break
    return choice, best


def _rows(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _assigned(scores: np.ndarray) -> np.ndarray:
    """Posteriors of letters by character; a letter isn't expected of several characters at once."""
    q = _rows(scores)
    for _ in range(3):
        q = q / np.maximum(1.0, q.sum(axis=0, keepdims=True))
        q = q / np.maximum(1e-300, q.sum(axis=1, keepdims=True))
    return q


def _injective(scores: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The best letter of each character, frequent characters first, each letter once while there are enough."""
    out, free = np.zeros(len(scores), np.int64), np.ones(scores.shape[1], bool)
    for i in np.argsort(-seen, kind="stable"):
        masked = np.where(free, scores[i], -np.inf) if free.any() else scores[i]
        out[i] = int(masked.argmax())
        free[out[i]] = False
    return out


def learn_substitutions(texts: DataFrame, neighbours, language: Language) -> DataFrame:
    """(source, shown, letters, gain): what translate() replaces by what, for each source of texts (source, text) that
    an unknown swap explains. neighbours: the Arrow stage that counts neighbours (source, kind, a, b, n) of units. throughout: all of the source is swapped."""

    schema = pa.schema([("source", pa.string()), ("shown", pa.string()), ("letters", pa.string()), ("gain", pa.float64()), ("throughout", pa.bool_())])

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        cells = np.stack([rows.column("a").to_numpy(), rows.column("b").to_numpy()], axis=1)
        counts, odd = rows.column("n").to_numpy(), np.array(rows.column("kind").to_pylist()) == "odd"
        units = cells[:, 0] < 0
        throughout = bool(counts[units & odd].sum() >= LEAST_UNEXPLAINED * counts[units].sum())
        if throughout:
            use = ~units
        else:
            last, told = cells[:, 1], {}
            for c in np.unique(last[odd & (last >= 0x80)]).tolist():
                told[c] = counts[odd & (last == c)].sum() >= LEAST_UNEXPLAINED * counts[last == c].sum()
            use = odd & np.array([all(0 <= c < 0x80 or told.get(c, False) for c in pair) for pair in cells.tolist()], bool)
        merged: dict[tuple[int, int], float] = {}
        for pair, n in zip(map(tuple, cells[use].tolist()), counts[use].tolist()):
            merged[pair] = merged.get(pair, 0.0) + n
        cells, counts = np.array(list(merged), np.int64).reshape(-1, 2), np.array(list(merged.values()))
        if not len(cells) or counts[cells[:, 1] >= 0x80].sum() < LEAST_SEEN or len(np.unique(cells[cells >= 0x80])) < LEAST_LETTERS:
            return schema.empty_table()
        mapping, gain, cost = solve(cells, counts, language)
        if gain < LEAST_GAIN or cost > MOST_COST:
            return schema.empty_table()
        found = {"source": [key[0].as_py()], "shown": ["".join(map(chr, mapping))], "letters": ["".join(map(chr, mapping.values()))], "gain": [gain], "throughout": [throughout]}
        return pa.table(found, schema=schema)

    counted = texts.mapInArrow(neighbours, "source string, kind string, a bigint, b bigint, n double").groupBy("source", "kind", "a", "b").agg(F.sum("n").alias("n"))
    return counted.groupBy("source").applyInArrow(each, SCHEMA)


def count_rows(sources: list[str], sets: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows (source, kind, a, b, n); sets: twice the place of the source, and one more for kind 'odd'."""
    return pa.RecordBatch.from_arrays(
        [pa.array(sources, pa.string()).take(pa.array(sets >> 1)), pa.array(["even", "odd"]).take(pa.array(sets & 1)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts, pa.float64())],
        ["source", "kind", "a", "b", "n"],
    )
