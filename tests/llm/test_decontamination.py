"""Benchmark items planted in documents in all the ways in which they must be found."""

import random

import numpy as np
import pyarrow as pa

from myospark.llm import decontaminate


def found_in(spark, docs, bench):
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated_pairs(*frames).collect()}


NAMED = [
    "We know that Alice bought 12 apples and sold 7 kg to Bob for 30 dollars", "Who met Anna near Bert and saw Carl beside Dora in that town", "Did Anna Bert Carl beat Dora Emil", "see Anna Bert",
    "В городе Иван видел Петра и Анну у реки в полдень", "Émile a vendu à Zoë les Études de Åsa pour neuf francs",
]


def test_items_in_other_case(spark):
    bench = [*enumerate(NAMED)]
    docs = [(10 * k + j, f"so it goes: {change(t)} and on") for k, t in bench for j, change in enumerate((str, str.upper, str.lower, str.title))]
    assert set(found_in(spark, docs, bench)) == {(10 * k + j, k) for k, _ in bench for j in range(4)}


def test_scripts_without_blanks(spark):
    items = ["水は何度で沸騰しますか", "一个苹果五元，买三个一共多少钱？", "น้ำเดือดที่กี่องศา"]
    around = ["", "これは問題です。", "plain words before "]
    docs = [(10 * k + j, a + t + a) for k, t in enumerate(items) for j, a in enumerate(around)] + [(99, "天气很好，我们去公园吧。")]
    assert set(found_in(spark, docs, [*enumerate(items)])) == {(10 * k + j, k) for k in range(3) for j in range(3)}


def test_words_as_they_stand_are_exact(spark):
    found = found_in(spark, [(1, "who wrote hamlet then"), (2, "look and SEE ANNA BERT now")], [(1, "Who wrote Hamlet"), (2, "see Anna Bert")])
    assert found == {(1, 1): "exact", (2, 2): "exact"}


def test_planted_items_by_brute_force(spark):
    """Every item of 8 words or more is found in other case, with a changed word and with other numbers; clean documents hold none."""
    rnd = random.Random(21)
    syllables = ["ka", "lo", "mi", "ter", "sun", "dra", "vel", "po", "ri", "gan"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(2, 4)))
    bench, docs, wanted = [], [], set()

    def plant(item, text):
        docs.append((len(docs), " ".join(word() for _ in range(rnd.randint(0, 40))) + ". " + text + " " + " ".join(word() for _ in range(rnd.randint(0, 40)))))
        wanted.add((len(docs) - 1, item))

    for k in range(120):
        words = [word() for _ in range(rnd.randint(8, 60))]
        places = rnd.sample(range(1, len(words)), max(1, len(words) // 6))
        for p in places:
            words[p] = word().title() if rnd.random() < 0.5 else str(rnd.randint(10, 9999))
        bench.append((k, " ".join(words)))
        plant(k, bench[k][1])
        plant(k, bench[k][1].upper())
        changed = list(words)
        changed[rnd.randrange(len(words))] = word() + "x"
        plant(k, " ".join(changed))
        new = {w: str(rnd.randint(10_000, 99_999)) if w.isdigit() else word().title() for w in words if w.isdigit() or w[0].isupper()}
        plant(k, " ".join(new.get(w, w) for w in words))
    clean = [(len(docs) + k, " ".join(word() for _ in range(200))) for k in range(200)]
    found = set(found_in(spark, docs + clean, bench))
    assert found <= wanted
    kinds = [[(d, i) in found for d, i in sorted(wanted) if d % 4 == way] for way in range(4)]
    assert all(kinds[0]) and all(kinds[1])
    assert np.mean(kinds[2]) >= 0.95 and np.mean(kinds[3]) >= 0.95, [np.mean(x) for x in kinds]


def test_lower_case_stays_in_place():
    column = pa.array(["İstanbul K Ⱥ ÜBER ẞ", None, "ABC", ""])
    data = decontaminate.raw(column)
    low = decontaminate.lowered(column, data)
    assert len(low) == len(data) and low.tobytes().decode() == "İstanbul K Ⱥ über ẞabc"
