import io
import json
from argparse import Namespace

import pytest

from evidelta import cli
from evidelta.operators import gate
from evidelta.sources import jsonl

GOOD = {"citation": "1 A. 2", "jurisdiction": "X", "status": "controlling", "treatment": "good_law", "exists": True}


def case(key, support="supported", **authority):
    return {"case_id": key, "support": support, "authority": GOOD | authority}


#: Candidate against a good baseline case, class, kinds of its findings.
RULES = [
    (case("same"), "UNCHANGED", []),
    (case("gone", exists=False), "REGRESSION", ["citation_existence"]),
    (case("unproven", exists=None), "UNCHANGED", []),
    (case("bad", treatment="Overruled "), "REGRESSION", ["treatment"]),
    (case("weaker", status="persuasive", jurisdiction="Y"), "REGRESSION", ["authority_strength"]),
    (case("synonym", status=" Binding"), "UNCHANGED", []),
    (case("foreign", jurisdiction="Y"), "UNKNOWN", ["jurisdiction"]),
    (case("partial", "partial"), "REGRESSION", ["proposition_support"]),
    (case("odd", "who knows"), "UNKNOWN", ["proposition_support"]),
    (case("cited", citation="2 B. 3"), "UNCHANGED", ["citation"]),
    (case("world", "unsupported", exists=False) | {"world_change": "false"}, "WORLD_CHANGE", ["world_change"]),
    (case("several", "partial", exists=False, citation="2 B. 3", jurisdiction="Y"), "REGRESSION", ["citation_existence", "proposition_support", "jurisdiction", "citation"]),
    ({"case_id": "bare", "support": "supported", "authority": ["none"]}, "REGRESSION", ["authority_strength", "citation"]),
    ({"case_id": "new", "support": "supported"}, "UNKNOWN", ["new_candidate_case"]),
]


def write(path, records):
    path.write_text("\n\n".join(json.dumps(r) for r in records) + "\n")
    return str(path)


def runs(spark, tmp_path):
    baseline = [case(c["case_id"]) for c, *_ in RULES if c["case_id"] != "new"] + [case("missing")]
    return write(tmp_path / "b.jsonl", baseline), write(tmp_path / "c.jsonl", [c for c, *_ in RULES])


def test_every_rule(spark, tmp_path):
    b, c = (jsonl.read_run(spark, p) for p in runs(spark, tmp_path))
    got = {x.case_id: (x.classification, [f.kind for f in x.changes], x.blocking) for x in gate.run_diff(b, c).collect()}
    want = {c["case_id"]: (k, kinds, k == "REGRESSION") for c, k, kinds in RULES} | {"missing": ("UNKNOWN", ["missing_candidate_case"], False)}
    assert got == want
    back = {x.case_id: x.classification for x in gate.run_diff(c, b.withColumns({"world_change": gate.F.lit(False), "world_change_reason": gate.F.lit("")})).collect()}
    assert back["gone"] == back["bad"] == back["partial"] == "IMPROVEMENT"
    same = gate.run_summary(gate.run_diff(b, b.withColumn("world_change_reason", gate.F.lit(None).cast("string")))).first()
    assert same.decision == "PASS" and same.unchanged == same.cases_evaluated == len(RULES)
    assert gate.run_summary(gate.run_diff(b.limit(0), c.limit(0))).first().decision == "PASS"


def test_command(spark, tmp_path, capsys):
    b, c = runs(spark, tmp_path)
    out = io.StringIO()
    assert cli.gate_command(spark, Namespace(baseline=b, candidate=c, json=None), out) == 1
    assert "RESULT: BLOCK" in out.getvalue() and "REGRESSION weaker\n- authority_strength: controlling -> persuasive" in out.getvalue() and "same" not in out.getvalue()
    assert cli.gate_command(spark, Namespace(baseline=b, candidate=b, json=str(tmp_path / "j")), out) == 0
    assert len(spark.read.json(str(tmp_path / "j")).collect()) == len(RULES)
    for bad in ([case("a"), case("a")], [{"support": "x"}], [case("")]):
        assert cli.gate_command(spark, Namespace(baseline=write(tmp_path / "bad.jsonl", bad), candidate=c, json=None)) == 2
    (tmp_path / "bad.jsonl").write_text('{"case_id": "a"}\n[1]\n')
    assert cli.gate_command(spark, Namespace(baseline=str(tmp_path / "bad.jsonl"), candidate=c, json=None)) == 2
    assert cli.gate_command(spark, Namespace(baseline=str(tmp_path / "none.jsonl"), candidate=c, json=None)) == 2


def test_lines_with_absent_null_and_odd_members(spark, tmp_path):
    texts = ['{"case_id": "a", "authority": {"exists": null}}', '{"case_id": "b", "authority": {}}', '{"case_id": "c", "authority": 5, "world_change": 0}', '{"case_id": "d", "authority": {"exists": "true"}, "world_change": []}', '{"case_id": "e ", "world_change": "no"}', "  "]
    (tmp_path / "r.jsonl").write_text("\n".join(texts), encoding="utf-8")
    got = {x.case_id: (x.authority.exists, x.world_change) for x in jsonl.read_run(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got == {"a": (None, False), "b": (True, False), "c": (True, False), "d": (None, False), "e ": (True, True)}
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": NaN}\n7\n')
    assert sorted(x.reason for x in jsonl.violations(jsonl.lines(spark, str(tmp_path / "bad.jsonl"))).collect()) == ["each row must be an object", "invalid JSON"]
    (tmp_path / "p.jsonl").write_text('{"pair_id": "p", "expected_support": "perhaps"}\n')
    with pytest.raises(ValueError, match="p.jsonl"):
        jsonl.read_pairs(spark, str(tmp_path / "p.jsonl"))
    (tmp_path / "empty.jsonl").write_text("\n")
    assert jsonl.read_run(spark, str(tmp_path / "empty.jsonl")).collect() == []


def test_lines_come_back_as_they_were_written(spark, tmp_path):
    df = spark.createDataFrame([("z", None, 1), ("é\n", "b", 2)], "z string, a string, m int")
    jsonl.write(df, str(tmp_path / "out"))
    text = sorted(line for p in (tmp_path / "out").glob("part*") for line in p.read_text().splitlines())
    assert text == ['{"a":"b","m":2,"z":"é\\n"}', '{"a":null,"m":1,"z":"z"}']
