import json
import random

import pytest

from evidelta.functions import jsonread
from evidelta.operators import nested
from evidelta.plans import quality


def test_the_deep_parser_agrees_with_the_decoder():
    r = random.Random(4)

    def value(depth):
        k = r.randrange(9 if depth else 6)
        if k == 6:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        if k > 6:
            return {r.choice(["a", "b", 'q"', "é", ""]): value(depth - 1) for _ in range(r.randrange(4))}
        return [None, True, False, r.randrange(-9, 99999), r.random() * 1e9, 'x\\"\n é'][k]

    for _ in range(400):
        text = json.dumps(value(4), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        assert jsonread._deep(text) == jsonread._decode(text)
        broken = text[: r.randrange(len(text) + 1)] + r.choice(["", "]", ",", "}", " x", '"'])
        try:
            want = jsonread._decode(broken)
        except ValueError:
            with pytest.raises(ValueError):
                jsonread._deep(broken)
        else:
            assert jsonread._deep(broken) == want


def test_depth_and_length_lose_nothing():
    deep = '{"evidence_spans": [{"text": "a"}], "x": ' + "[" * 100_000 + "]" * 100_000 + "}"
    assert jsonread.readable_object(deep)["evidence_spans"] == [{"text": "a"}]
    assert jsonread.readable_object('{"n": ' + "7" * 10_000 + "}")["n"] == "7" * 10_000
    assert jsonread.readable_object('{"n": NaN}') is None and jsonread.readable_object('"7"') is None and jsonread.readable_object("[]") is None


def tables(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "prediction_id bigint, extraction string, label string").write.parquet(f"{tmp_path}/predictions.parquet")
    return {n: quality.QUERIES[n](spark, str(tmp_path)).collect() for n in quality.QUERIES if n.startswith("p5_")}


def test_every_child_joins_its_parent(spark, tmp_path):
    texts = [
        json.dumps({"target_authority": {"name": "A", "extra": 1}, "evidence_spans": [{"text": "s", "alternates": [{"text": "t"}, 5, {}]}, 3, {"role": ["r"]}], "abstain": False, "more": {"deep": 1}}),
        json.dumps(json.dumps({"proposition": "p", "evidence_spans": {"text": "alone", "alternates": {"role": "x"}}})),
        json.dumps({"target_authority[]": {"name": "no"}, "evidence_spans.text": 1, "[]": {"name": "no"}}),
        "{",
        "",
        None,
        "[1]",
        '{"evidence_spans": [' + "[" * 20_000 + "]" * 20_000 + ', {"text": "deep"}]}',
    ]
    t = tables(spark, tmp_path, texts)
    rows = {(r.prediction_id, r.label) for n in ("p5_predictions", "p5_evidence_spans") for r in t[n]}
    children = [r for n in ("p5_target_authorities", "p5_evidence_spans", "p5_alternates") for r in t[n]]
    assert len(children) == 1 + 4 + 3 and all((r.prediction_id, r.parent_label) in rows for r in children)
    spans = {(r.prediction_id, r.label): r for r in t["p5_evidence_spans"]}
    assert all((r.prediction_id, r.parent_label) in spans for r in t["p5_alternates"])
    assert sorted((r.prediction_id, r.pos, r.text, r.role) for r in t["p5_evidence_spans"]) == [(0, 0, "s", None), (0, 2, None, None), (1, 0, "alone", None), (7, 1, "deep", None)]
    assert sorted(map(tuple, t["p5_found"])) == [(0, "alternate", 0, 0), (0, "alternate", 0, 2), (0, "evidence_span", 0, -1), (0, "evidence_span", 2, -1), (0, "target_authority", 0, -1), (1, "alternate", 0, 0), (1, "evidence_span", 0, -1), (7, "evidence_span", 1, -1)]
    other = {(r.prediction_id, r.member): (r.kind, r.value) for r in t["p5_other_members"]}
    assert other == {(0, "extra"): ("number", "1"), (0, "more"): ("object", None), (2, "target_authority[]"): ("object", None), (2, "evidence_spans.text"): ("number", "1"), (2, "[]"): ("object", None)}
    assert sorted(r.prediction_id for r in t["p5_unreadable"]) == [3, 4, 5, 6]


def test_all_nodes_without_wanted_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": 1}, [{"c": 2}]]}}'), (1, '{"a": {"b": [{"c": 1}, [{"c": 2}]]}}')], "i bigint, t string")
    rows = nested.objects(df, "i", "t").collect()
    assert sorted(("/".join(r.path), r.label, r.parent_label or "-") for r in rows) == sorted(2 * [("", "", "-"), ("a", "0", "-"), ("a/b/[]", "0.0.0", "0"), ("a/b/[]/[]", "0.0.1.0", "0")])


def test_empty_table(spark, tmp_path):
    assert all(rows == [] for rows in tables(spark, tmp_path, []).values())
