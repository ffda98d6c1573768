import random
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__
from evidelta.llm import overlaps
from evidelta.llm.words import case_words


def rule(a, b):
    x, y = Counter(case_words(a)), Counter(case_words(b))
    n = max(sum(x.values()), sum(y.values()))
    return min(sum(x.values()), sum(y.values())) >= 6 and 5 * sum((x & y).values()) >= 4 * n


def test_overlaps_as_by_brute_force(spark, tmp_path):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + [f"n{i}" for i in range(3000)]
    claim = lambda n: [r.choice(vocabulary[:30] if r.random() < 0.8 else vocabulary) for _ in range(n)]
    base = [claim(r.choice([5, 6, 7, 12, 30, 31, 50, 64, 65, 66, 80, 120])) for _ in range(150)]

    def changed(words):
        words = list(words)
        for _ in range(r.randrange(0, len(words) // 4 + 2)):
            k = r.randrange(3)
            if k == 0 and len(words) > 1:
                words.pop(r.randrange(len(words)))
            elif k == 1:
                words.insert(r.randrange(len(words) + 1), r.choice(vocabulary))
            else:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        r.shuffle(words)
        return ", ".join(words).upper()

    heldout = [("pair", f"H{i}", " ".join(w), ["test", " Test", None][i % 3]) for i, w in enumerate(base)] + [("pair", None, " ".join(base[0]), "test"), ("relation", "R", " ".join(base[0]), "test"), ("pair", "HN", None, "test")]
    pairs = [(f"P{i}.{k}", changed(w), ["1 A. 2", "1 a 2", None][i % 3]) for i, w in enumerate(base) for k in range(3)] + [("PN", None, "1 A. 2"), (None, " ".join(base[0]), "1 A. 2")]
    spark.createDataFrame(heldout, "item_kind string, pair_id string, claim string, split string").write.parquet(f"{tmp_path}/heldout.parquet")
    spark.createDataFrame(pairs, "pair_id string, claim string, citation string").write.parquet(f"{tmp_path}/pairs.parquet")
    want = {(h[1], p[0]) for h in heldout if h[0] == "pair" and h[1] for p in pairs if p[0] and rule(h[2], p[1])}
    rows = __spark_entry__.queries()["p3_found"](spark, str(tmp_path)).collect()
    assert len(rows) == len(set(rows)) and {tuple(x) for x in rows} == want and len(want) > 100

    counts = {(x.split, x.citation): x.overlaps for x in __spark_entry__.queries()["p3_overlap_counts"](spark, str(tmp_path)).collect()}
    split, cited = {h[1]: h[3] and h[3].strip().lower() for h in heldout}, {p[0]: p[2] and "1 A. 2" for p in pairs}
    assert counts == Counter((split[h], cited[p]) for h, p in want)


def test_pairs_within_the_rule_share_keys_and_pass_the_sketch():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([6, 7, 10, 25, 32, 50, 60, 64, 66, 75]))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base * 3:
        w = [x for x in w if r.random() > 0.12]
        w += [r.choice(vocabulary) for _ in range(r.randrange(1 + len(w) // 12))]
        r.shuffle(w)
        texts.append(" ".join(w))
    places, n, tokens, low, high = overlaps.read(texts)
    assert list(places) == [i for i, t in enumerate(texts) if len(t.split()) >= 6]
    often = np.array([r.choice([0, *[500, 600, 700] * 6]) for _ in range(overlaps.BUCKETS)])
    made = []
    for claims, parts in ((2, 1), (1000, 1), (1000, 3)):
        has, total = defaultdict(set), 0
        for part in range(parts):
            rows, key = overlaps.keys(n, tokens, often, claims, part, parts)
            total += len(key)
            for i, k in zip(rows.tolist(), key.tolist()):
                has[i].add(k)
        made.append((total, has))
        pairs = [(i, j) for i in range(len(n)) for j in range(i) if rule(texts[places[i]], texts[places[j]])]
        assert len(pairs) > 60 and all(has[i] & has[j] for i, j in pairs)
    assert made[1] == made[2] and made[0][0] > made[1][0]  # the passes have all keys, each once
    bits = lambda a, b: bin(int(a) ^ int(b)).count("1")
    for i, j in pairs:
        a, b = (np.array([low[x], high[x]]).view(np.uint64) for x in (i, j))
        assert bits(a[0], b[0]) + bits(int(a[1]) & 2**48 - 1, int(b[1]) & 2**48 - 1) <= n[i] + n[j] - 2 * overlaps.needed(max(n[i], n[j]))


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_is_shuffled_grows_as_the_claims_do(spark, tmp_path):
    r = random.Random(5)
    claims = [" ".join(f"w{int(120 * r.random() ** 1.3)}" for _ in range(30)) for _ in range(8000)]
    written = []
    for rows in (2000, 8000):
        folder = f"{tmp_path}/{rows}"
        spark.createDataFrame([("pair", f"H{i}", c, "test") for i, c in enumerate(claims[: rows // 4])], "item_kind string, pair_id string, claim string, split string").write.parquet(f"{folder}/heldout.parquet")
        spark.createDataFrame([(f"P{i}", c, "1 A. 2") for i, c in enumerate(claims[:rows])], "pair_id string, claim string, citation string").write.parquet(f"{folder}/pairs.parquet")
        before = shuffled(spark)
        found = __spark_entry__.queries()["p3_found"](spark, folder).collect()
        written.append(shuffled(spark) - before)
        assert {(f"H{i}", f"P{i}") for i in range(rows // 4)} == {tuple(x) for x in found}
    assert written[1] < 7 * written[0], written
