from __future__ import annotations

import random

from tidemark.llm import leaks as k

ITEM = "Suppose that Holdor, a tram inspector registered in Minfenzan, files 28 claims worth USD 69.20, half of them reversed by evening; strasse und Café."


def brute(docs, items, n=13):
    runs = lambda t: {tuple(w[i : i + n]) for w in [k.normal_words(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs if t for i, x in items if x and runs(t) & runs(x)}


def test_layouts(spark):
    words = ITEM.split()
    docs = [
        (1, "Intro. " + ITEM), (2, ITEM.upper()), (3, "\n> ".join(words)), (4, " ".join(f"**{w}**" for w in words)), (5, ITEM.replace("Café", "Café").replace("ss", "ß")),
        (6, "​".join(ITEM)), (7, " ".join(words[:12])), (8, " ".join(words[3:18])), (9, ""), (10, None), (11, " ".join(words[:12]) + " other " + " ".join(words[12:20])), (12, "x" * 60_000 + " " + ITEM),
    ]
    items = [(7, ITEM), (8, "too short"), (9, None), (7, ITEM), (5, ITEM + " And a tail of more words here for good measure, thank you.")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS start")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    got = {(r.doc_id, r.item_id) for r in k.leaks(d, i).distinct().collect()}
    assert got == brute(docs, items)
    assert {x for x, item in got if item == 7} >= {1, 2, 3, 4, 6, 8, 12} and not {7, 9, 10} & {x for x, _ in got}
    split = {(r.doc_id, r.item_id) for r in k.leaks(d, i, block_chars=100).distinct().collect()}
    assert split == got
    for r in k.leaks(d, i, places=True).collect():
        text = dict(docs)[r.doc_id]
        assert r.n_words >= 13 and len(k.normal_words(text[r.start : r.end])) == r.n_words


def test_random_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = ["a", "b", "ß", "É", "1"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(30))) for i in range(12)]
    docs = [(i, " , ".join(rnd.choice(vocab) for _ in range(rnd.randrange(60)))) for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in k.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), words=4).collect()}
    assert got == brute(docs, items, 4)


def test_a_stretch_follows_the_item():
    w = [f"w{i}" for i in range(60)]
    automaton = k._automaton(((1, " ".join(w)), (2, " ".join(w[:20] * 2))), 13)
    text = " ".join(w[:13] + w[40:53])
    assert sorted(k.spans(text, automaton)) == sorted([(1, 0, len(" ".join(w[:13])), 13), (1, text.index("w40"), len(text), 13), (2, 0, len(" ".join(w[:13])), 13)])
    assert sorted(k.spans(" ".join(w[3:30]), automaton))[0] == (1, 0, len(" ".join(w[3:30])), 27)
    assert [(i, n) for i, _, _, n in k.spans(" ".join(w[:20] * 2), automaton)] in ([(1, 20), (1, 20), (2, 40)], [(2, 40), (1, 20), (1, 20)])


def test_places_where_clusters_and_the_whole_differ():
    text = "Plain words, then \u1112\u1161\u11ab\u200b\u0301 x\u200d\u0301y and é end"
    placed = k.placed_words(text)
    assert [w for w, _, _ in placed] == k.normal_words(text)
    assert all(0 <= a < b <= len(text) and not text[a:b].strip() == "" for _, a, b in placed) and placed[-1][1:] == (len(text) - 3, len(text))
    assert all(b - a < 12 for _, a, b in placed)


def test_no_items_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, item_id bigint, text string")
    some = spark.createDataFrame([(1, 1, ITEM)], "doc_id bigint, item_id bigint, text string")
    assert k.leaks(none, some).count() == k.leaks(some, none).count() == 0
