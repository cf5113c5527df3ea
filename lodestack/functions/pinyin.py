"""Pinyin of Chinese names: initials and full syllables, as expressions over one literal table.

The table is built once per session from the ICU transliterator that comes with Spark, character by character, and
used with translate() for the initials and a literal map for the syllables, so no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = 0x4E00, 0x9FA5
_TABLES: dict[str, dict[str, str]] = {}


def syllables(spark: SparkSession) -> dict[str, str]:
    """Character to toneless lower-case syllable, for U+4E00 to U+9FA5."""
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower")  # noqa: SLF001
        chars = [chr(c) for c in range(FIRST, LAST + 1)]
        # one call: characters apart by line ends, so that none is read together with its neighbour
        read = icu.transliterate("\n".join(chars)).split("\n")
        _TABLES[app] = {c: s.strip() for c, s in zip(chars, read) if s.strip().isascii() and s.strip().isalpha()}
    return _TABLES[app]


def has_han(text: Column) -> Column:
    return text.rlike(f"[{chr(FIRST)}-{chr(LAST)}]")


def pinyin(spark: SparkSession, text: Column) -> tuple[Column, Column]:
    """(initials, full) of a name, both null without Chinese characters; other characters are copied in lower case."""
    table = syllables(spark)
    chars = "".join(table)
    first = F.translate(F.lower(text), chars, "".join(s[0] for s in table.values()))
    by_syllable: dict[str, str] = {}
    for char, syllable in table.items():
        by_syllable[syllable] = by_syllable.get(syllable, "") + char
    # each character as the number of its syllable (a private-use character), then numbers to syllables
    order = sorted(by_syllable)
    private = {s: chr(0xE000 + i) for i, s in enumerate(order)}
    coded = F.translate(F.lower(text), chars, "".join(private[s] for s in table.values()))
    names = F.array(*[F.lit(s) for s in order])
    pieces = F.transform(
        F.split(coded, ""),
        lambda c: F.when((c >= chr(0xE000)) & (c < chr(0xE000 + len(order))), F.get(names, F.ascii(c) - 0xE000)).otherwise(c),
    )
    return F.when(has_han(text), first), F.when(has_han(text), F.array_join(pieces, ""))
