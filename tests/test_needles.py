"""Many needles at once find what one expression per rule finds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.operators import needles
from lintlake.operators.rules import LineRule, matched_guidance, scan_lines
from lintlake.plans.needle_queries import MANY_RULES
from lintlake.plans.views import table

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def plain_rules(words):
    return [LineRule(f"r{i}", f"{w}.", f"why {i}", w) for i, w in enumerate(words)]


@given(st.lists(st.text("aé𝄞.", min_size=1, max_size=9), min_size=1, max_size=9), st.text("aé𝄞.", max_size=40))
@settings(max_examples=300, deadline=None)
def test_a_text_with_a_needle_has_its_anchor(words, text):
    for needle, gram in needles.anchors(words).items():
        assert gram in needle and (needle not in text or gram in text)


def test_anchor_is_the_rarest():
    assert needles.anchors(["abcde"], {"abcd": 2, "bcde": 1}) == {"abcde": "bcde"}
    assert needles.anchors(["abcde", "bcdex"])["abcde"] == "abcd"
    assert needles.anchors(["ab"]) == {"ab": "ab"}


def test_same_rows_as_literal_rules(spark):
    rng = random.Random(5)
    word = lambda low, high: "".join(rng.choice("abé𝄞 .") for _ in range(rng.randint(low, high)))
    words = [word(1, 7).replace(".", "x") for _ in range(60)] + ["ab", "ab"]
    texts = [(i, "\n".join(word(0, 30) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "\n\n"), (None, "ab ab ab")]
    files = spark.createDataFrame(texts, "id int, text string")
    got = needles.scan_many_rules(files, plain_rules(words), ["id"])
    want = scan_lines(files, plain_rules(words), ["id"])
    assert got.columns == want.columns
    assert rows(got) == rows(want) and len(rows(got)) > 100
    counts = {r.gram: r.n for r in needles.gram_counts(files, words).collect()}
    assert rows(needles.scan_many_rules(files, plain_rules(words), ["id"], counts=counts)) == rows(want)


def test_counts_are_of_pieces(spark):
    files = spark.createDataFrame([("abcd abcd",), ("xabcdx",), (None,)], "text string")
    assert rows(needles.gram_counts(files, ["abcde", "zz"])) == [("abcd", "2")]
    assert rows(needles.gram_counts(files, [])) == []


def test_needles_across_pieces_and_long_lines(spark):
    at = needles.PIECE
    long = "." * (at - 3) + "needle" + "." * (3 * at) + "needle" + "x" * (at - 1) + "needle"
    files = spark.createDataFrame([(1, long), (2, "needl\ne"), (3, "𝄞" * (at - 2) + "needle!")], "id int, text string")
    rules = [LineRule("n", "needle.", "r", "needle"), LineRule("end", "needle$", "r", "needle"), LineRule("big", "𝄞", "r", "𝄞" * 5000)]
    got = rows(needles.scan_many_rules(files, rules, ["id"]))
    assert got == [("1", "0", "1", "n", "r"), ("1", "1", "1", "end", "r"), ("3", "0", "1", "n", "r")]


def test_guidance_equals_the_literal_form(spark):
    guidance = {"os.": "a", "b\nc": "b", "": "all", "𝄞x": "c", "zzzz": "never"}
    files = spark.createDataFrame(
        [(1, "import os.path"), (2, "b\nc 𝄞x os."), (3, ""), (4, None), (5, "𝄞" * 9000 + "x")], "_unit int, code string"
    )
    got = needles.match_many(files, guidance, ["_unit"])
    made = got.select("_unit", "pos", F.concat(F.lit("\t* For '"), "needle", F.lit("', "), "advice").alias("s"))
    want = files.select("_unit", F.posexplode(matched_guidance(F.col("code"), guidance)).alias("pos", "s"))
    assert rows(made) == rows(want)


def test_nothing_to_look_for_and_nowhere_to_look(spark):
    files = spark.createDataFrame([(1, "a")], "id int, text string")
    assert needles.scan_many_rules(files, [], ["id"]).collect() == []
    assert needles.match_many(files, {}, ["id"], "text").collect() == []
    assert needles.scan_many_rules(files.limit(0), plain_rules(["a"]), ["id"]).collect() == []
    with pytest.raises(ValueError, match="without a needle"):
        needles.scan_many_rules(files, [LineRule("a", "a", "b")], ["id"])


def test_ten_thousand_rules_on_documents(spark):
    """A slice of the rules as literals, all of them as needles."""
    documents = table(spark, SF_DIR, "documents").select("doc_id", "text")
    got = needles.scan_many_rules(documents, MANY_RULES, ["doc_id"]).drop("pos")
    assert len(MANY_RULES) > 10_000
    some = [r for r in MANY_RULES if r.variable_name in ("mail3", "mail5", "net188")]
    want = scan_lines(documents, some, ["doc_id"]).drop("pos")
    assert rows(got.where(F.col("variable_name").isin("mail3", "mail5", "net188"))) == rows(want)


def test_only_hits_are_shuffled(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = needles.scan_many_rules(documents, MANY_RULES, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")  # above it


def test_only_runs_of_needles_leave_a_text(spark):
    """Each run is found, whatever its bytes; no other one goes on to be compared."""
    known = ["mail", "é", "日本語x", "10.1", "x"]
    texts = ["".join(f"{i:04x}" for i in range(3000)), "a mail to é 日本語x", "10.", "", "1", "mai", "l 10.10.1 日本語"]
    units = spark.createDataFrame(list(enumerate(texts)), "id int, _unit string")
    found = {(r.id, r._gram) for r in needles._text_grams(units, "_unit", known, 3).collect()}
    assert found == {(i, g) for i, t in enumerate(texts) for g in known if g in t}
