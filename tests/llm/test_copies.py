import __spark_entry__


def test_records_that_cant_be_compared_are_kept(spark, tmp_path):
    authority = "struct<citation: string>"
    rows = [(1, "A claim", ("1 A. 2",)), (2, "a  claim!", ("1 A. 2",)), (3, None, ("1 A. 2",)), (4, None, ("1 A. 2",)), (5, "A claim", (" ",)), (6, "A claim", None)]
    spark.createDataFrame(rows, f"rec_id bigint, claim string, authority {authority}").write.parquet(f"{tmp_path}/baseline.parquet")
    relations = [(1, "relation", None, "1 A. 2", "x"), (2, "pair", "1 A. 2", "1 A. 2", "x")]
    spark.createDataFrame(relations, "heldout_id bigint, item_kind string, source_citation string, target_citation string, anchor string").write.parquet(f"{tmp_path}/heldout.parquet")
    spark.createDataFrame([(1, "C", "{"), (2, "C", "{")], "prediction_id bigint, challenge_id string, extraction string").write.parquet(f"{tmp_path}/predictions.parquet")
    queries = __spark_entry__.queries()
    copies = sorted(tuple(x) for x in queries["p1_copies"](spark, str(tmp_path)).collect())
    assert copies == [("baseline", 1, 2), ("baseline", 3, 1), ("baseline", 4, 1), ("baseline", 5, 1), ("baseline", 6, 1), ("heldout", 1, 1), ("predictions", 1, 1), ("predictions", 2, 1)]
    assert [tuple(x) for x in queries["p1_found"](spark, str(tmp_path)).collect()] == [("baseline", 1, 2)]


def test_groups_against_brute_force(spark, tmp_path):
    """A hot group of a third of the rows, spellings of one citation, a row repeated with its id."""
    import random
    from collections import defaultdict

    r = random.Random(8)
    forms = ["12 A. 34 (Sup. Ct. Dov 1990)", "(1990, sup ct dov) 12 a 34", "12 A 34; Sup. Ct. Dov, 1990", "34 A. 12 (Sup. Ct. Dov 1990)", "12 A. 34"]
    same = [0, 0, 0, 1, 2]  # volume and page don't swap; without court and year it is another citation
    rows, want = [], defaultdict(list)
    for i in range(600):
        form, claim = (0, "The toll is due.") if i % 3 == 0 else (r.randrange(5), r.choice(["The toll is due.", "THE  TOLL​ is due", "No toll.", "n-o toll", "", None]))
        rows.append((i, claim, (forms[form],), "z"))
        if claim:
            want[same[form], "".join(c for c in claim.lower() if c.isalnum())].append(i)
    rows.append(rows[3])
    spark.createDataFrame(rows, "rec_id bigint, claim string, authority struct<citation: string>, copies string").write.parquet(f"{tmp_path}/baseline.parquet")
    spark.createDataFrame([], "heldout_id bigint, item_kind string, source_citation string, target_citation string, anchor string").write.parquet(f"{tmp_path}/heldout.parquet")
    spark.createDataFrame([], "prediction_id bigint, challenge_id string, extraction string").write.parquet(f"{tmp_path}/predictions.parquet")
    queries = __spark_entry__.queries()
    found = sorted(tuple(x) for x in queries["p1_found"](spark, str(tmp_path)).collect())
    assert found == sorted(("baseline", ids[0], i) for ids in want.values() for i in ids[1:])
    copies = {x.first_id: x.copies for x in queries["p1_copies"](spark, str(tmp_path)).collect()}
    assert all(copies[ids[0]] == len(ids) + (3 in ids) for ids in want.values())
    assert sum(copies.values()) == 601
    plan = queries["p1_copies"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan  # made once, then read from the written table
