import json

from pyspark.sql import functions as F

from evidelta.functions.html import text_of
from evidelta.operators import enrichment, gate, verify, windows
from evidelta.sources import fetch, jsonl
from evidelta.streaming import gate as stream

CLUSTER = "struct<id:bigint,case_name:string,date_filed:string,precedential_status:string,absolute_url:string,docket:string,docket_id:bigint,sub_opinions:array<string>>"
LOOKUP = f"citation string, status int, adapter_state string, clusters array<{CLUSTER}>"


def cluster(i, name, docket="http://d/1", opinions=("http://o/1", "http://o/2")):
    return (i, name, "1990-01-01", "Published", None, docket, i, list(opinions))


def world(spark):
    rows = [("1 A. 1", 200, "FOUND", [cluster(1, "Stelow v. Brand")]), ("2 A. 2", 404, "NOT_FOUND", []), ("3 A. 3", 300, "AMBIGUOUS", [cluster(1, "Other v. Case"), cluster(2, "Stelow v. Brand Co.")]), ("4 A. 4", 200, "FOUND", [cluster(1, "X"), cluster(2, "Y")]), ("5 A. 5", 429, "THROTTLED", None)]
    lookups = enrichment.disambiguated(spark.createDataFrame(rows, LOOKUP), F.lit("Stelow vs. Brand"))
    dockets = spark.createDataFrame([("http://d/1", "ca2", "9-1")], "url string, court_id string, docket_number string")
    opinions = spark.createDataFrame([("http://o/1", "040dissent", " ", "<p>The toll &amp; lantern</p>", None), ("http://o/2", "020lead", None, None, "The ferry is free."), ("http://o/3", "x", "", " ", None)], "url string, type string, html_with_citations string, html string, plain_text string")
    opinions = opinions.withColumns({c: F.lit(None).cast("string") for c in ("html_lawbox", "html_columbia", "html_anon_2020")})
    return enrichment.resolved(lookups, dockets), enrichment.opinion_texts(opinions)


def test_evidence_laid_over_a_run(spark, tmp_path):
    found, opinions = world(spark)
    state = {r.citation: (r.status, r.adapter_state, r.metadata_state) for r in found.collect()}
    assert state["3 A. 3"] == (200, "FOUND_DISAMBIGUATED", "RESOLVED") and state["4 A. 4"] == (200, "FOUND", "UNRESOLVED") and state["5 A. 5"][2] == "UNRESOLVED"
    chosen = {r.citation: (r.text, r.opinions) for r in enrichment.source_texts(found, "citation", opinions).collect()}
    assert chosen == {"1 A. 1": ("The ferry is free.", 2), "3 A. 3": ("The ferry is free.", 2)}
    cases = [{"case_id": str(i), "support": "unknown", "authority": {"citation": c}, "context": {"target_court_id": "ca2", "support_contract": {"required_phrases": ["Toll & Lantern", "ferry is free"]}}} for i, c in enumerate(["1 A. 1", "2 A. 2", "4 A. 4", "5 A. 5", None, " ", "9 Z. 9"])]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, cases)))
    run = enrichment.enriched(jsonl.read_run(spark, str(tmp_path / "r.jsonl")), found, enrichment.whole_texts(found, "citation", opinions))
    got = {r.case_id: r for r in run.collect()}
    assert (got["0"].authority.exists, got["0"].authority.status, got["0"].support) == (True, "controlling", "supported")
    assert got["0"].authority.verification.matches[0].case_name == "Stelow v. Brand" and got["0"].authority.verification.opinion_count == 2
    assert got["1"].authority.exists is False and got["3"].authority.exists is True and got["3"].support == "unknown"
    assert [got[i].authority.verification.lookup_status for i in "0123456"] == ["FOUND", "NOT_FOUND", "FOUND", "THROTTLED", "NO_CITATION", "NO_CITATION", "UNPARSED"]
    assert {r.state: r.records for r in enrichment.state_tally(run).collect()}["NO_CITATION"] == 2
    assert gate.run_summary(gate.run_diff(run, run)).first().decision == "PASS"


def test_federal_status(spark):
    rows = [("scotus", "ca9", None, "controlling"), ("CA9 ", "ca9", "Published", "controlling"), ("ca1", "ca9", "published", "persuasive"), ("ca1", "ca9", "unpublished", None), ("nysd", "ca9", "published", None), ("scotus", "nysd", "published", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, t string, p string, want string")
    assert all(r.got == r.want for r in df.select("want", enrichment.federal_status(F.col("s"), F.col("t"), F.col("p")).alias("got")).collect())


def test_each_key_is_fetched_once_and_failures_are_values(spark, tmp_path):
    log = tmp_path / "log"

    def ask(key):
        with open(log, "a") as f:
            f.write(key + "\n")
        if key == "bad":
            raise RuntimeError("no such thing")
        return {"key": key}

    df = spark.createDataFrame([("a",), ("a",), ("b",), ("bad",), (None,)], "k string")
    got = fetch.fetched(df, "k", ask)
    assert {(r.k, r.error) for r in got.collect()} == {("a", None), ("b", None), ("bad", "no such thing")} == {(r.k, r.error) for r in got.collect()}
    assert sorted(log.read_text().split()) == ["a", "b", "bad"]
    waits, tries = [], iter([RuntimeError("HTTP 429"), RuntimeError("throttled"), None])

    def flaky(key):
        if (e := next(tries)) is not None:
            raise e
        return 7

    assert fetch.attempt(flaky, "k", wait=2, sleep=waits.append) == (7, None) and waits == [2, 4]
    two = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("b", "x")], "k string, v string")
    assert [r.k for r in fetch.single_valued(two, "k", "v").collect()] == ["a"]


def test_files_and_markup(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.pdf")
    got = {r.path[-5:]: (r.text, r.error) for r in fetch.pdf_texts(files, lambda b: {"text": "t", "pages": 1, "characters": 1, "text_sha256": "s"}).collect()}
    assert got == {"a.pdf": ("t", None), "b.pdf": (None, "not a PDF")}
    urls = spark.createDataFrame([("347 U. S. 483",), ("1 A. 2",), (None,)], "c string").select(fetch.reports_url(F.col("c"), "base").alias("u")).collect()
    assert [r.u for r in urls] == ["base/USREPORTS-347/pdf/USREPORTS-347-483.pdf", None, None]
    assert text_of("<p>a &amp;amp; b</p><!-- c --><script>d</script>") == "a & b d" and text_of(None) is None and text_of("") == ""


def test_models_of_the_caller(spark):
    claims = spark.createDataFrame([("a", "the toll is void", "k"), ("b", "zebra", "k"), ("c", None, "k"), ("d", "toll", "none")], "id string, claim string, key string")
    src = windows.source_windows(spark.createDataFrame([("k", "The ferry sank. the toll is void today.")], "key string, text string"), "key", "text")
    got = {r.id: r.verdict for r in verify.verified(windows.top_windows(windows.paired(claims, "claim", src, "key")), "claim").collect()}
    assert got["a"].predicted == "supported" and "toll is void" in got["a"].window and got["b"].predicted == "unsupported" and (got["d"].neutral, got["d"].window) == (1.0, "") and got["c"].window == ""

    def ask(text):
        claim = json.loads(text)["tested_claim"]
        return {"ok": {"text": '{"a": 1}'}, "no": {"refusal": "will not"}, "cut": {"text": "{", "status": "incomplete"}, "odd": {"text": "{"}, "": {"text": " "}}[claim]

    rows = spark.createDataFrame([(c, "ctx" if c != "none" else "", "n", "1 A. 2") for c in ("ok", "no", "cut", "odd", "", "none", "boom")], "claim string, context string, target_case string, target_citation string")
    errors = {r.claim: r.error for r in verify.extracted(rows, ask).collect()}
    assert errors == {"ok": None, "no": "model_refusal:will not", "cut": "incomplete_response:incomplete", "odd": "structured_output_not_json", "": "empty_structured_output", "none": "missing_field", "boom": "request_failed:'boom'"}


def test_the_gate_on_a_stream(spark, tmp_path):
    one = lambda k, s: {"case_id": k, "support": s, "world_change": False, "authority": {"citation": "1 A. 1", "exists": True, "status": "binding", "treatment": "good_law", "jurisdiction": "x"}}
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(one(k, "supported")) for k in "abc"))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(one(k, s)) for k, s in (("a", "partial"), ("b", "supported"), ("new", "supported"), ("", "partial"))))
    baseline, rows = (jsonl.read_run(spark, str(tmp_path / n)) for n in ("b.jsonl", "c.jsonl"))
    rows.write.parquet(str(tmp_path / "in"))
    query = stream.start(baseline, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    assert {(r.case_id, r.classification) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "REGRESSION"), ("b", "UNCHANGED"), ("new", "UNKNOWN")}
