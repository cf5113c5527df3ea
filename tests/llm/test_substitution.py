"""Swaps of pages that are in no list: learned from the text of their source alone."""

import random
from collections import Counter

import pytest

from lodestack.llm import mojibake

WORDS = {
    "pl": "żółty źródło łąka gęś święto książka ręka ząb ćma śnieg miód łódź pięć dziesięć jabłko góra wąż chłopiec dziewczynka słońce księżyc morze rzeka kość dąb wieś gałąź mąka pączek źrebię niedźwiedź żaba różny często później zawsze między środek błąd ścieżka każdy żeby tęcza kąt wróbel gołąb".split(),
    "de": "Größe Straße Übung schön grün für müde Bär Käse Löffel Öl Tür Schlüssel Mädchen Jäger König süß heiß weiß früh spät Äpfel Füße Wärme Köpfe Vögel läuft hätte würde können müssen Gäste Brücke Stück Fuß groß".split(),
    "fr": "été élève père mère très après déjà français garçon où fenêtre tête hôtel forêt île naïf cœur sœur être préféré répéter théâtre août goût sûr drôle âge gâteau château bientôt côté problème".split(),
    "ru": "резервная копия проверяет черновик договора сегодня утром после обеда новая книга лежит на столе большая река течёт через город старый дом стоит под горой мы читаем письмо о погоде дети играют в саду вечером было холодно и тихо хорошая мысль пришла поздно каждый день нужно работать".split(),
}


def text(r, language, n=9):
    return " ".join(r.choice(WORDS[language]) for _ in range(n))


def shown_wrongly(line, table):
    return "".join(table.get(c, c) for c in line)


@pytest.mark.parametrize("case", ["cp1250", "latin permuted", "cyrillic permuted"])
def test_unknown_page(spark, case):
    r = random.Random(4)
    clean = [("t", f"c{i}", f"s{i % 3}", text(r, list(WORDS)[i % 4])) for i in range(1200)]
    letters = sorted({c for words in WORDS.values() for w in words for c in w if c > "\x7f" and (c < "Ѐ") == (case != "cyrillic permuted")})
    if case == "cp1250":
        table = {c: c.encode("cp1250").decode("latin-1") for c in letters if c in "żółźąęśćńŻŁ"}
        language = "pl"
    else:
        signs = letters[:]
        r.shuffle(signs)
        table, language = dict(zip(letters, signs)), "ru" if case == "cyrillic permuted" else "fr"
    planted = {f"g{i}": text(r, language, 14) for i in range(500)}
    rows = clean + [("t", k, "odd", shown_wrongly(v, table)) for k, v in planted.items()]
    found = {x["rec_key"]: x for x in mojibake.garbled(spark.createDataFrame(rows, "tab string, rec_key string, source string, text string")).collect()}
    restored = [k for k, v in planted.items() if k in found and found[k]["restored"] == v]
    assert sum(k.startswith("c") for k in found) <= 0.01 * len(clean)
    assert sum(k in found for k in planted) >= 0.95 * len(planted)
    wrong = Counter((a, b) for k, v in planted.items() if k in found and len(found[k]["restored"]) == len(v) for a, b in zip(v, found[k]["restored"]) if a != b)
    # bigrams can't tell every rare letter: one that stands in a single word may be another language's
    special = sum(c > "\x7f" for v in planted.values() for c in v)
    assert sum(wrong.values()) <= 0.05 * special and len(restored) >= 0.6 * len(planted), wrong.most_common(9)


def test_script_of_one_source_stays(spark):
    """Greek that a single source has is no swap of letters that the corpus knows."""
    r = random.Random(6)
    greek = "καλημέρα σήμερα βιβλίο θάλασσα ουρανός μεγάλος δρόμος χρόνος ψωμί κρασί άνθρωπος γράμμα φίλος ξένος ήλιος ζωή πόλη νερό".split()
    rows = [("t", f"c{i}", f"s{i % 3}", text(r, list(WORDS)[i % 4])) for i in range(900)]
    rows += [("t", f"e{i}", "odd", " ".join(r.choice(greek) for _ in range(12))) for i in range(300)]
    found = mojibake.garbled(spark.createDataFrame(rows, "tab string, rec_key string, source string, text string")).collect()
    assert len(found) <= 0.01 * len(rows)
