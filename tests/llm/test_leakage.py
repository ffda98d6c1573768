import random

import __spark_entry__
from evidelta.llm.leakage import WINDOW
from evidelta.llm.words import plain_words


def shared(item, doc):
    a, b = plain_words(item), plain_words(doc)
    windows = {tuple(b[i : i + WINDOW]) for i in range(len(b) - WINDOW + 1)}
    return any(tuple(a[i : i + WINDOW]) in windows for i in range(len(a) - WINDOW + 1))


def test_words_in_odd_print():
    assert plain_words("Ｆｕｌｌ ﬁne­ness lo​st CASE-\n  law well-known") == ["full", "fineness", "lost", "caselaw", "well", "known"]
    assert plain_words(None) == plain_words("—") == []


def test_leaks_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    items = [(i, "s", "test", " ".join(word() for _ in range(r.randrange(35, 76)))) for i in range(40)]
    items += [(100, "s", "test", items[0][3]), (101, "s", "test", "too short"), (102, "s", "test", None), (None, "s", "test", items[1][3])]
    docs = [(0, None, "z"), (1, "", "z"), (2, " ".join(word() for _ in range(30_000)) + " " + items[2][3], "z"), (2, "twice", "z"), (3, items[3][3] * 3, "z")]
    for d in range(10, 130):
        words = r.choice(items[:40])[3].split()
        n = r.choice([11, 12, 13, len(words)])
        at = r.randrange(len(words) - n + 1)
        part = words[at : at + n]
        if r.random() < 0.3:
            part[r.randrange(n)] = word()
        text = [word() for _ in range(5)] + [r.choice([w, w.upper(), w[:2] + "-\n" + w[2:], w[:1] + "​" + w[1:], w + ","]) for w in part] + [word() for _ in range(5)]
        docs.append((d, r.choice([" ", "\r\n", " — "]).join(text), "z"))
    spark.createDataFrame(items, "item_id bigint, suite string, split string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i[0], d[0]) for i in items if i[0] is not None for d in docs if shared(i[3], d[1])}
    queries = __spark_entry__.queries()
    rows = queries["p7_found"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in rows} == want and len(rows) == len(want) > 60
    leaked = {x.item_id: x.documents for x in queries["p7_leaked_items"](spark, str(tmp_path)).collect()}
    assert leaked == {i: sum(x == i for x, _ in want) for i, _ in want}
