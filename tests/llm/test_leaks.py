import random

import pytest

from simlode.llm import leaks as L

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "tu") for b in ("ban", "cor", "dil", "fen", "gar", "hul")]


def item(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if i % 7 else str(r.randrange(1000)) for i in range(n))


def brute(doc, text):
    """By edit distance with free ends, for each stretch of the item."""
    a, b = (L.WORD.findall((t or "").lower()) for t in (text, doc))
    least = L.least_words(len(a))
    for s in range(len(a)):
        row = [0] * (len(b) + 1)
        for e in range(s, len(a)):
            new = [row[0] + 1]
            for j, w in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a[e] != w)))
            row = new
            n = e - s + 1
            if n >= least and min(row) * L.DIFFER <= n:
                return True
    return False


def planted():
    r = random.Random(5)
    noise = lambda k: " ".join(r.choice(["return", "value", "index", "the", "7"]) for _ in range(k))
    items = {i: item(i) for i in range(6)}
    docs = {}
    for k in range(40):
        words = L.WORD.findall(items[k % 6])
        n = r.choice([8, 15, 19, 20, 21, 26, 40, 60])
        s = r.randrange(len(words) - n + 1)
        part = words[s : s + n]
        for _ in range(r.choice([0, 0, 1, 2, n // 8])):
            part[r.randrange(len(part))] = r.choice(["changed", "12345", r.choice(WORDS)])
        if k % 4 == 3:
            del part[len(part) // 2]
        if k % 4 == 2:
            part.insert(len(part) // 2, "more")
        docs[k] = noise(20) + "\n// " + (" ".join(part).upper() if k % 2 else "_- ".join(part)) + "\n" + noise(9)
    return items, docs


def test_against_brute_force():
    items, docs = planted()
    index = L.Index(list(items.items()))
    k, i = index.scan(list(docs.values()))
    found = {(int(a), int(b)) for a, b in zip(k, i)}
    truth = {(a, b) for a, d in docs.items() for b, t in items.items() if brute(d, t)}
    assert found == truth and 15 < len(truth) < 40


def test_a_word_more_or_less_near_the_end_of_the_stretch():
    words = L.WORD.findall(item(9, 41))
    texts = [
        " ".join([*words[:5], "other", *words[6:12], "added", *words[12:16]]),
        " ".join([*words[25:29], "added", *words[29:35], "other", *words[36:41]]),
        " ".join([*words[:5], "other", *words[6:12], *words[13:17]]),
        " ".join([*words[:5], "other", *words[6:12], "added", "twice", *words[12:16]]),
    ]
    text = " ".join(words)
    truth = [k for k, t in enumerate(texts) if brute(t, text)]
    assert truth == [0, 1, 2]
    assert L.Index([(1, text)]).scan(["x y " + t + " z" for t in texts])[0].tolist() == truth


def test_same_pattern_with_other_words_is_no_case():
    text = "Suppose Hollor labels 479 amber beads with gimyarumb signs, then hides 840 behind a mirror. How many tokens stay?"
    other = "Suppose Fenquo labels 31 violet kites with sulpel signs, then hides 12 behind the shelf. How many marbles stay?"
    index = L.Index([(1, text)])
    assert index.scan([other])[0].size == 0
    assert index.scan(["x " + text.upper().replace(" ", "\n# ")])[0].size == 1


def test_shortest_items():
    index = L.Index([(1, "alpha"), (2, "beta gamma"), (3, "")])
    k, i = index.scan(["alpha", "gamma", "delta", None, ""])
    assert {(int(a), int(b)) for a, b in zip(k, i)} == {(0, 1), (1, 2)}


def test_window_guarantee():
    for least in range(1, 60):
        width = L.sure_run(least)
        for n in range(least, least + 70):
            d = n // L.DIFFER
            assert -(-(n - d) // (d + 1)) >= width


@pytest.mark.parametrize("slice_words", [L.SLICE_WORDS, 40])
def test_tables(spark, monkeypatch, slice_words):
    monkeypatch.setattr(L, "SLICE_WORDS", slice_words)
    items, _ = planted()
    rows = [(i, t, "x") for i, t in items.items()] + [(99, None, "x"), (98, "", "x")]
    texts = [(1, items[0], 0), (1, items[0], 0), (2, None, 0), (3, "", 0), (4, "word " * 200_000 + items[3], 0)]
    d = spark.createDataFrame(texts, "doc_id long, text string, i int")
    e = spark.createDataFrame(rows, "item_id long, text string, d string")
    assert sorted(map(tuple, L.leaks(d, e).collect())) == [(1, 0), (1, 0), (4, 3)]
    assert L.leaks(d.limit(0), e).collect() == [] and L.leaks(d, e.limit(0)).collect() == []


QUESTION = "A train leaves Harlow at 9 and Bexley gets 120 riders by 45 past so Harlow sends 30 riders more to Bexley by 11 and Harlow gets 8"


def kinds(doc, items):
    index = L.Index(items)
    return [{int(x) for x in index.scan([doc], kind)[1]} for kind in (L.COPY, L.OTHER_VALUES)]


def test_other_values_need_one_replacement_each():
    swap = lambda **by: " ".join(by.get(w, by.get("n" + w, w)) for w in QUESTION.split())
    items = [(1, QUESTION), (2, item(3))]
    again = swap(Harlow="Norwich", Bexley="Thame", n9="7", n120="85", n45="20", n30="14", n11="12", n8="3")
    assert kinds("x = 1 # " + again, items) == [set(), {1}]
    assert kinds(QUESTION, items) == [{1}, set()]
    # The same pattern, but one filling has two replacements.
    words = again.split()
    words[len(words) - 1 - words[::-1].index("Norwich")] = "Luton"
    assert kinds(" ".join(words), items) == [set(), set()]
    # Other words beside the slots.
    assert kinds(" ".join(w if i % 2 else "other" for i, w in enumerate(again.split())), items) == [set(), set()]


def test_reparameterised_table(spark):
    docs = spark.createDataFrame([(1, QUESTION), (2, QUESTION.replace("Harlow", "Norwich").replace("Bexley", "Thame").replace("120", "85").replace("45", "20").replace(" 9 ", " 7 ").replace("30", "14").replace(" 11 ", " 12 ")), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, QUESTION), (8, None)], "item_id long, text string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(L.leaks(docs, items)) == {(1, 7)} and rows(L.reparameterised(docs, items)) == {(2, 7)}


def test_common_opening_is_left_out_without_loss(monkeypatch):
    monkeypatch.setattr(L, "COMMON", 3)
    monkeypatch.setattr(L, "SLICE_PAIRS", 50)
    opening = "please answer the question below with one short word only"
    items = {i: f"{opening} {item(i, 50)}" for i in range(8)} | {20: opening}
    whole = L.Index(list(items.items()))
    assert any(whole.enough[k] == 1 for k in range(8))
    r = random.Random(1)
    docs = []
    for k in range(40):
        words = items[k % 8].split()
        n = r.choice([20, 22, 26, 30])
        s = r.randrange(max(1, len(words) - n))
        part = words[s : s + n]
        if k % 3 == 1:
            part.insert(len(part) // 2, "more")
        if k % 3 == 2:
            del part[len(part) // 2]
        docs.append(" ".join(part))
    found = {(int(a), int(b)) for a, b in zip(*whole.scan([*docs, opening]))}
    truth = {(a, b) for a, d in enumerate([*docs, opening]) for b, t in items.items() if brute(d, t)}
    assert found == truth and any(b == 20 for _, b in truth)


def test_lists_of_numbers_match_by_their_words():
    text = "check " + " ".join(str(i * 37 % 1000) for i in range(30))
    assert kinds("data = [" + ", ".join(str(i) for i in range(400)) + "]", [(1, text)])[0] == set()
    assert kinds("data = [" + ", ".join(str(i * 37 % 1000) for i in range(5, 25)) + "]", [(1, text)])[0] == {1}
