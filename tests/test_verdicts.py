import subprocess
import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineproof.functions import verdicts as J
from lineproof.operators import audits as A
from tests.conftest import ROOT


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout.strip() == "True"


def test_damage_scores_and_phrases(spark):
    assert one(spark, J.damaged_phones, "02-12O4-5678, 02-1234-5678") == ["02-12O4-5678"]
    assert one(spark, J.damaged_phones, None) == []
    assert one(spark, J.exam_scores, "TOEIC Speaking 130, TOEIC 800점, IELTS 6.5") == ["TOEIC Speaking=130", "TOEIC=800", "IELTS=6.5"]
    assert one(spark, lambda t: J.lost_phrases(t, F.lit("The Open Day in May")), 'the "Open Day" and (spring term)') == ["spring term"]


def test_cells_roles_and_fees(spark):
    assert one(spark, J.closed_cell, "3~5인") == "teams of 3 to 5" and one(spark, J.closed_cell, "그 외") is None
    assert one(spark, J.fallback_text, "한글") == "[romanised] hangeul"
    assert one(spark, J.role, "문의: a@b.org") == "contact" and one(spark, J.role, "hello") == "other"
    assert one(spark, J.fee_issue, "지원금 3만 원") == "award" and one(spark, J.fee_issue, "참가비 무료") is None


def test_glyph_height_and_answers(spark):
    corners = [(0.0, 0.0), (30.0, 0.0), (30.0, 10.0), (0.0, 8.0)]
    df = spark.createDataFrame([(corners,)], "p array<struct<x: double, y: double>>")
    assert df.select(J.glyph_height(F.col("p")).alias("h")).first().h == 9
    df = spark.createDataFrame([("10 May", "on 10  may!"), ("", "x"), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(J.scored(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é한\n", max_size=300), st.integers(4, 40))
def test_cuts_join_and_keep_the_bound(text, most):
    found = A.cut(text, most)
    assert "".join(found) == text and all(0 < len(c.encode()) <= most for c in found)


def test_recovered_candidates(spark):
    df = spark.createDataFrame([(1, "bad", [("good long", 0.5), ("good", 0.5), ("g", 0.9)]), (2, "good", []), (3, "bad", None)], "id int, t string, alt array<struct<text: string, conf: double>>")
    found = A.recovered_candidates(df, "t", "alt", lambda c: c.startswith("g"), 80)
    assert {r.id: r.recovered for r in found.collect()} == {1: "good long", 2: "good", 3: "bad"}


def test_marks_save_searches_and_no_issue(spark):
    """A search runs only where its mark stands; case, blanks and nulls as without the marks."""
    from lineproof.functions import english as E

    cases = [
        ("3명 이상", "3 people", ["missing inclusive minimum for 3"]), ("3명", "at least Three people", []), ("ielts 6.5", "ok", ["missing or changed score pairing: ielts / 6.5"]),
        ("글", "TOEFLiBT", ["unsupported exam name: toefl ibt"]), ("글", "opic", ["unsupported exam name: opic"]), ("글", "plain", []), (None, "x", []), ("3명 이내", "Up to THREE students", []),
    ]
    rows = spark.createDataFrame(cases, "s string, e string, want array<string>").select("want", E.pair_issues(F.col("s"), F.col("e")).alias("x"))
    assert [r.x for r in rows.collect()] == [r.want for r in rows.collect()]
    dear = [E.limit_issues(F.col("s"), F.col("e")), E.digits_for_counts(F.col("e"))]
    assert all("CASE WHEN" in str(c) for c in dear)  # before, every search ran on every text
