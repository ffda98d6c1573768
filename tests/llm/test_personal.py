import __spark_entry__
from evidelta.llm import personal
from evidelta.llm.personaldata import invented


def found(text):
    return [(k, text[s:e]) for s, e, k, _ in personal.model().mentions(text)]


def test_rows_not_trained_on():
    """Invented rows of another seed, with names and numbers that the model hasn't seen."""
    want, got, both = {}, {}, {}
    for text, truth in invented(600, seed=77):
        a, b = {(s, k) for s, _, k in truth}, {(s, k) for s, _, k, _ in personal.model().mentions(text)}
        for rows, counts in ((a, want), (b, got), (a & b, both)):
            for _, k in rows:
                counts[k] = counts.get(k, 0) + 1
    for k in personal.KINDS:
        assert both[k] >= 0.95 * want[k] and both[k] >= 0.95 * got[k], (k, want[k], got[k], both[k])


def test_mentions_and_lookalikes():
    text = "Ms. Clara “Skip” Vont-Harle (call (402) 555-0154) wrote to c.vont [at] mail [dot] example from 12 N. Brill Ave, Apt. 3, Torvel, QX 00123."
    assert [k for k, _ in found(text)] == ["person_name", "phone", "email", "street_address"]
    assert found(text)[0][1] == "Clara “Skip” Vont-Harle" and found(text)[1][1] == "(402) 555-0154"
    assert found("Le témoin Skaven, Hélène a été entendu, NIR 1 29 13 99 211 636 25.")[0] == ("person_name", "Skaven, Hélène")
    for clean in ("Stelow v. Martin Freight Co., 273 Marl. 540 (Land Ct. Quillon 1934).", "Bates range 073146-073186 was served.", "The ratio was 9 @ 5 per cent, rev. v2@draft.", "Justice Paend would have sealed it.", "Write to [EMAIL] or call [PHONE].", "Exhibit 90-52-297 of 11-03-1983, No. 08-07080"):
        assert found(clean) == [], clean


def test_best_segmentation_beats_every_other():
    """Dynamic programming against all sets of spans that don't overlap."""
    field = personal.model()

    def total(spans):
        return sum(field.score(s) for s in spans)

    def sets(spans, at=0):
        yield []
        for i, s in enumerate(spans):
            if s[0] >= at:
                for rest in sets(spans[i + 1 :], s[1]):
                    yield [s, *rest]

    tried = 0
    for text, _ in invented(150, seed=5):
        for cluster in personal.clusters(personal.lattice(text)):
            if 1 < len(cluster) <= 12:
                tried += 1
                assert abs(total(field.best(cluster)) - max(map(total, sets(cluster)))) < 1e-9
    assert tried > 50


def test_probabilities_sum_over_all_segmentations():
    import itertools
    import math

    field = personal.model()
    done = 0
    for text, _ in invented(80, seed=6):
        for cluster in personal.clusters(personal.lattice(text)):
            if not 1 < len(cluster) <= 7:
                continue
            spans = sorted(cluster, key=lambda s: (s[1], s[0]))
            weight, own = 0.0, [0.0] * len(spans)
            for n in range(len(spans) + 1):
                for chosen in itertools.combinations(range(len(spans)), n):
                    if all(spans[a][1] <= spans[b][0] for a, b in itertools.pairwise(chosen)):
                        w = math.exp(sum(field.score(spans[i]) for i in chosen))
                        weight += w
                        for i in chosen:
                            own[i] += w
            assert all(abs(o / weight - p) < 1e-6 for o, p in zip(own, field.marginals(spans)))
            done += 1
    assert done > 20


def test_queries(spark, tmp_path):
    long = "x " * 200_000 + "Witness Anna Brulk testified. " + "1 2 3 4 5 6 7 8 9 " * 5_000
    rows = [(1, None, "z"), (2, "", "z"), (3, "📜 Contact Anna Brulk at a.brulk@mail.example.", "z"), (3, "📜 Contact Anna Brulk at a.brulk@mail.example.", "z"), (4, long, "z"), (None, "Anna Brulk", "z")]
    spark.createDataFrame(rows, "doc_id bigint, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = __spark_entry__.queries()
    assert sorted(map(tuple, queries["p8_found"](spark, str(tmp_path)).collect())) == [(3, "email", 24), (3, "person_name", 10), (4, "person_name", 400_008)]
    redacted = {x.doc_id: x.text for x in queries["p8_redacted"](spark, str(tmp_path)).collect()}
    assert redacted[1] is None and redacted[2] == "" and redacted[3] == "📜 Contact [NAME] at [EMAIL]."
    assert redacted[4] == long.replace("Anna Brulk", "[NAME]")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries["p8_found"](spark, f"{tmp_path}/none").collect() == []
