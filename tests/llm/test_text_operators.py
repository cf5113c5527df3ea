import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import boosting, leaks, mixing, mojibake, near_duplicates, words

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
VOCABULARY = [f"w{i}" for i in range(400)] + list("数据结构层级路径快照")


def split(text):
    return WORD.findall((text or "").lower())


def runs(text, width):
    w = split(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def sentence(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        at = r.randrange(len(w))
        w[at:at + r.choice([0, 1])] = [r.choice(VOCABULARY)] if r.random() < 0.7 else []
    return " ".join(w)


def test_words(spark):
    texts = ["Hello, WORLD_2 été ÉTÉ", "数据结构abc数1", "", None, "a\r\nb", "x²"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(words.words(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else split(t) for t in texts]


def corpus(seed, n=40):
    r = random.Random(seed)
    base = [sentence(r, r.choice([8, 30, 120])) for _ in range(n)]
    form = sentence(r, 60)
    out = base + [edited(r, t, r.randint(1, 6)) for t in base for _ in range(2)] + [t for t in base[:10] for _ in range(2)]
    out += [form + " " + sentence(r, 30) for _ in range(20)] + [t.upper().replace(" ", "  ") for t in base[:3]]
    return out + ["", None, "one two three four", "one two three four five", "one two three four five"]


@pytest.mark.parametrize(("threshold", "block"), [(0.6, 2000), (0.8, 3)])
def test_near_duplicates(spark, threshold, block):
    texts = corpus(1)
    rows = [(f"p{i:03d}", t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "clash")]
    df = spark.createDataFrame(rows, "id string, text string, class string")
    members, links = near_duplicates.near_duplicates(df, threshold, block=block)
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.expand_pairs(members, links).collect()}
    sets = {i: runs(t, 5) for i, t, _ in rows if i and runs(t, 5)}
    want = {
        (a, b) for a in sets for b in sets
        if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    }
    assert got == want and len(want) > 40
    group = {r["id"]: r["group_id"] for r in near_duplicates.groups(members, links).collect()}
    parent = {i: i for i in sets}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for a, b in want:
        parent[top(a)] = top(b)
    assert set(group) == set(sets)
    assert all((group[a] == group[b]) == (top(a) == top(b)) for a in sets for b in sets)


def test_near_duplicates_empty(spark):
    members, links = near_duplicates.near_duplicates(spark.createDataFrame([], "id string, text string"), 0.6)
    assert members.count() == 0 and links.count() == 0 and near_duplicates.groups(members, links).count() == 0


def test_long_chain_is_one_group(spark):
    names = [bytes([i]) for i in range(60)]
    members = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, class binary")
    links = spark.createDataFrame(list(zip(names, names[1:])), "class_a binary, class_b binary")
    assert near_duplicates.groups(members, links).select("group_id").distinct().count() == 1


def test_pruning_keeps_similar_pairs():
    limits = near_duplicates.most_mismatches(0.6, 1e-5)
    assert limits == sorted(limits) and all(0 < b <= 64 * (i + 1) for i, b in enumerate(limits))
    r = np.random.default_rng(1)
    kept = dropped = 0
    for _ in range(200):
        a = r.integers(0, 2**63, 300, dtype=np.uint64)
        for share, similar in ((0.25, True), (0.75, False)):
            b = a.copy()
            change = int(300 * share) // (1 if not similar else 2)
            b[:change] = r.integers(0, 2**63, change, dtype=np.uint64)
            sig = near_duplicates.signatures(np.concatenate([a, b]), np.array([0, 300, 600]))
            p = near_duplicates.bit_planes(sig).view(np.uint64)
            bad, alive = 0, True
            for stage, limit in enumerate(limits):
                x = (p[0, 2 * stage] ^ p[1, 2 * stage]) | (p[0, 2 * stage + 1] ^ p[1, 2 * stage + 1])
                bad += int(np.bitwise_count(x))
                alive = alive and bad <= limit
            kept += similar and alive
            dropped += not similar and not alive
    assert kept == 200 and dropped > 190


@pytest.mark.parametrize("per_pass", [50_000, 60])
def test_leaks(spark, per_pass):
    r = random.Random(3)
    items = [(i, sentence(r, 30)) for i in range(12)] + [(90, "too short"), (91, None), (None, sentence(r, 20)), (92, "")]
    docs = []
    for i in range(60):
        text = sentence(r, r.choice([0, 5, 40, 200]))
        if i % 3 == 0:
            w = items[i % 12][1].split(" ")
            at = r.randint(0, 15)
            text += "\r\n" + " ".join(w[at:at + r.choice([11, 12, 20])]) + " " + sentence(r, 10)
        docs.append((i, text, "clash"))
    docs += [(100, None, "x"), (None, items[0][1], "x"), (101, items[1][1], "x"), (101, items[1][1], "x"), (102, sentence(r, 40_000) + " " + items[2][1], "x")]
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string"), pass_windows=per_pass)
    got = [(x["doc_id"], x["item_id"]) for x in found.where("exact").collect()]
    want = {(d, i) for d, t, _ in docs if d is not None for i, s in items if i is not None and runs(t, 12) & runs(s, 12)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_leaks_similar(spark):
    r = random.Random(9)
    words_of = lambda n: [f"m{min(int(r.expovariate(0.05)), 60)}" for _ in range(n)]
    items = [(i, " ".join(["often", *words_of(r.choice([11, 11, 12])), "always"][:r.choice([12, 13])])) for i in range(40)]
    docs = []
    for i in range(80):  # a light word at the edge is another
        w = split(items[i % 40][1])
        w[0] = "always"
        docs.append((i, sentence(r, 3) + " " + " ".join(w if i % 2 else w[:12]) + " " + sentence(r, 3)))
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    holders = {}
    for i, t in items:
        for word in set(split(t)):
            holders.setdefault(word, set()).add(i)
    weight = {w: min(8, max(1, round(-np.log2(len(x) / len(items))) + 1)) for w, x in holders.items()}

    def similarity(a, b):
        heavy = lambda x: sum(sum(weight.get(w, 8) for w in s) for s in x)
        a, b = ({tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        return heavy(a & b) / heavy(a | b) if a & b else 0.0

    want = set()
    for d, t in docs:
        x = split(t)
        for i, s in items:
            y = split(s)
            pairs = [(x[k:k + n], y[m:m + n]) for n in {12, len(y)} for k in range(len(x) - n + 1) for m in range(len(y) - n + 1)]
            if any(similarity(*p) >= 0.8 for p in pairs):
                want.add((d, i))
    assert got == want and len(want) > 10


def test_leaks_within_radius():
    r = np.random.default_rng(2)
    index = leaks.ItemIndex(list(range(20)), [list(r.integers(-2**62, 2**62, 14)) for _ in range(20)], 12, 3)
    probes = []
    for p in index.prints:
        for _ in range(5):
            for bit in r.choice(64, r.integers(0, 5), replace=False):
                p = p ^ np.uint64(1 << int(bit))
            probes.append(p)
    probes = np.array(probes, dtype=np.uint64)
    got = set(zip(*map(list, index.near(probes))))
    want = {(i, j) for i, a in enumerate(probes) for j, b in enumerate(index.prints) if int(a ^ b).bit_count() <= 3}
    assert got == want and want


def test_leaks_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaks(docs, items).count() == 0
    assert leaks.leaks(spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string"), items).count() == 0


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(VOCABULARY) for _ in range(r.choice([5, 20, 60]))), r.choice(["big", " Big", "BIG", "mid one", "mid_one", "tiny", None, "other"])) for i in range(1500)]
    rows = [(i, t, s if s != "tiny" or i % 4 == 0 else "big") for i, t, s in rows]
    rows += [(5000 + i, rows[i][1], "mid one") for i in range(50)] + [(6000, "", "big"), (6001, None, "big"), (None, "text", "big")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid-one", 0.3, 3), ("tiny", 0.2, 4), ("absent", 0.1, 2), (None, 0.1, 1), ("zero", None, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix_sources(docs, targets)
    shares = {x["source"]: x for x in report.collect()}
    for source in ("big", "mid_one", "tiny"):
        assert abs(shares[source]["actual_share"] - shares[source]["wanted_share"]) < 0.01
    assert shares["absent"]["actual_share"] == 0 and abs(sum(x["wanted_share"] for x in shares.values()) - 1) < 1e-9
    got = chosen.collect()
    cap = {"big": 1, "mid_one": 3, "tiny": 4}
    texts = {i: t for i, t, _ in rows}
    assert all(0 < x["copies"] <= cap[x["source"]] for x in got)
    assert len({texts[x["doc_id"]] for x in got}) == len(got)  # equal texts are one text
    assert sum(x["tokens"] * x["copies"] for x in got) == sum(x["used_tokens"] for x in shares.values())
    small, report = mixing.mix_sources(docs, targets, total_tokens=2000)
    assert abs(sum(x["used_tokens"] for x in report.collect()) - 2000) < 150 and small.count() < len(got)
    empty, report = mixing.mix_sources(docs.limit(0), targets)
    assert empty.count() == 0 and all(x["actual_share"] == 0 for x in report.collect())


SENTENCES = [
    "Der Größenfilter überspringt die Übersicht für Gäste", "El año archivado perdió la búsqueda según la guía", "La sauvegarde répète le résumé de l’été à côté",
    "Резервная копия проверяет черновик договора", "索引服务反复打开会议纪要的两个副本", "The price is £20 at 20° – “fine”", "plain ascii text",
]


def test_mojibake(spark):
    r = random.Random(5)
    clean = [(f"c{i}", " ".join(r.choice(SENTENCES).split(" ")[r.randint(0, 2):]) if i % 2 else r.choice(SENTENCES)) for i in range(3000)]
    swaps = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("gbk", "latin-1"), ("utf-8", "cp437"), ("cp1252", "cp850"), ("mac_roman", "latin-1")]
    garbled = []
    for i in range(48):  # garbled text is rare
        written, shown = swaps[i % len(swaps)]
        for text in r.sample(SENTENCES, len(SENTENCES)):
            try:
                broken = text.encode(written).decode(shown)
            except UnicodeError:
                continue
            if broken != text:
                garbled.append((f"g{i}", broken, text))
                break
    rows = [("t", k, "s", t) for k, t in clean] + [("t", k, "s", t) for k, t, _ in garbled] + [("t", "lost", "s", "Pr�fung"), ("t", "null", "s", None), ("t", "empty", None, "")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "tab string, rec_key string, source string, text string, lost int")
    found = {x["rec_key"]: x for x in mojibake.garbled(df).collect()}
    assert found["lost"]["lost"] and "null" not in found and "empty" not in found
    hit = [k for k, _, _ in garbled if k in found]
    wrong = [k for k in found if k.startswith("c")]
    missed = {k: (broken, text) for k, broken, text in garbled if k not in found}
    assert not missed or len(missed) <= 0.05 * len(garbled), missed
    assert not wrong or len(wrong) <= 0.005 * len(clean), [(found[k]["restored"], found[k]["ciphers"]) for k in wrong][:5]
    assert len(hit) >= 0.95 * len(garbled) and len(wrong) <= 0.005 * len(clean)
    restored = [k for k, _, t in garbled if k in found and found[k]["restored"] == t]
    assert len(restored) >= 0.8 * len(garbled)
    assert mojibake.garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize(("written", "shown"), [("utf-8", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251")])
def test_mojibake_frequent(spark, written, shown):
    r = random.Random(8)
    clean = [(f"c{i}", " ".join(r.choice(SENTENCES).split(" ")[r.randint(0, 2):])) for i in range(1200)]
    text = SENTENCES[0 if written == "utf-8" else 3]
    broken = text.encode(written).decode(shown)
    rows = [("t", k, "s", t) for k, t in clean] + [("t", f"g{i}", "s", broken) for i in range(600)]
    found = {x["rec_key"]: x["restored"] for x in mojibake.garbled(spark.createDataFrame(rows, "tab string, rec_key string, source string, text string")).collect()}
    assert sum(k.startswith("g") for k in found) == 600 and set(v for k, v in found.items() if k.startswith("g")) == {text}
    assert sum(k.startswith("c") for k in found) <= 0.005 * len(clean)


def test_boosting_learns():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.Boosted(rounds=40).fit(x[:2000], y[:2000])
    model.calibrate(x[2000:2500], y[2000:2500])
    assert ((model.predict(x[2500:]) >= model.threshold) == y[2500:]).mean() > 0.95
