"""Golden cases of the text and quality functions, derived by hand."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import quality as q
from quillspark.functions import text as t


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "chunks"),
    [("AAA\n\nBBB", ["AAA BBB"]), ("a" * 200 + "\n\n" + "b" * 199, ["a" * 200 + " " + "b" * 199]), ("a" * 200 + "\n\n" + "b" * 200, ["a" * 200, "b" * 200]), ("x" * 401, ["x" * 401]), ("", []), (" \n\n ", []), (None, None)],
)
def test_chunks(spark, text, chunks):
    assert one(spark, text, t.chunks) == chunks


def test_sentences_and_hard_split(spark):
    assert one(spark, "Hi. there. Ok", t.sentences) == ["Hi. there.", "Ok"]
    assert [len(p) for p in one(spark, " ".join(["abcde"] * 10), lambda c: t.hard_split(c, 40))] == [35, 23]
    assert one(spark, "a  b", lambda c: t.hard_split(c, 40)) == ["a  b"]


@pytest.mark.parametrize(("text", "answer"), [("<think>a</think> Hi", "Hi"), ("<THINK>x</THINK>", ""), ("<think>a</think>B<think>c", "B"), ("<think>abc", t.NO_ANSWER), (None, None)])
def test_thinking(spark, text, answer):
    assert one(spark, text, t.strip_thinking) == answer


def test_degenerate(spark):
    varied = " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "x" + str(i) for i in range(44))
    for text, flag in [(" ".join(["same"] * 39), False), (" ".join(["same"] * 40), True), (varied + " abc1 abc2 abc3 abc4", False), (varied + " abc1 abc2 ab abc3 abc4 abc5", True), (None, False), ("", False)]:
        assert one(spark, text, q.is_degenerate) is flag


def test_script_and_files(spark):
    assert one(spark, "abcdefg ש", q.hebrew_ratio) == 0.125 and one(spark, "123 !", q.hebrew_ratio) is None
    assert one(spark, "abcשלום", q.is_rtl) is True and one(spark, "", q.is_rtl) is False
    assert one(spark, "a<b>:c", t.safe_filename) == "a b c" and one(spark, "??", t.safe_filename) == "document"
    assert one(spark, "https://x.example/a/b.pdf?q", t.url_basename) == "b.pdf" and one(spark, "https://x.example", t.url_basename) == "document.pdf"
    assert one(spark, "https://evilx.example/a", lambda c: t.in_domain(c, "x.example")) is False
    assert one(spark, "https://www.x.example/a", lambda c: t.in_domain(c, "x.example")) is True
    assert one(spark, "&lt;b&gt;", t.unescape) == "<b>"


def test_citations(spark):
    assert one(spark, "- See Section 12. See Section 12.\nNo cite.", t.citations) == ["See Section 12."]
    assert one(spark, "plain", t.warn_uncited).endswith("*")
    assert one(spark, "make me slides about tea", t.asks_for_slides) and not one(spark, "what should I say in my presentation tomorrow?", t.asks_for_slides)


def test_window(spark):
    rows = spark.createDataFrame([(4096, None), (6144, 16384), (6144, 4096), (10000, None), (1, 0)], "p int, r int")
    assert [r[0] for r in rows.select(t.window_tokens(F.col("r"), F.col("p"))).collect()] == [8192, 16384, 8192, 12048, 8192]
