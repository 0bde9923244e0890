import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.idna import ascii_domain


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "made"),
    [("Weekly Plan!", "weekly-plan"), ("  ", "meeting"), (None, "meeting"), ("a" * 59 + " b", "a" * 59 + "-"), ("Планы", "meeting")],
)
def test_slug(spark, value, made):
    assert one(spark, value, T.slug) == made


def test_wide_slug(spark):
    assert one(spark, "https://Site.test/Видео ёж", T.wide_slug) == "site-test-видео-ёж"
    assert one(spark, "", T.wide_slug) == "video"


def test_names(spark):
    assert one(spark, ' a/b:c  d__e. ', T.safe_file_name) == "a-b-c_d_e"
    assert one(spark, "...", T.safe_file_name) == "contract"
    titles = spark.createDataFrame([(" T ", "z"), (None, "Zoom"), (" ", None)], "t string, a string")
    assert [r[0] for r in titles.select(T.meeting_title(F.col("t"), F.col("a"))).collect()] == ["T", "Zoom meeting", "Untitled meeting"]
    assert [r[0] for r in titles.select(T.export_title(F.col("t"), F.col("a"))).collect()] == [" T ", "Zoom meeting", " "]
    stem = titles.limit(1).select(T.output_stem(F.lit("2026-08-02T10:00:00Z"), F.lit("Planning"), F.lit(42)), T.output_stem(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("long"))).first()
    assert tuple(stem) == ("2026-08-02-planning-42", "unknown-date-meeting-unknown-id")


def test_speakers(spark):
    assert [one(spark, v, T.speaker) for v in (" Ann\r\nB ", "", None)] == ["Ann  B", "Unknown", "Unknown"]


def test_domains(spark):
    assert one(spark, " Example.COM. ", T.domain) == "example.com"
    assert one(spark, "http://a.b/c", T.domain_problem).startswith("URLs") and one(spark, "a b", T.domain_problem) == "spaces are not allowed" and one(spark, "a.b", T.domain_problem) is None
    assert one(spark, " HTTPS://A.b/c?d", T.host_of) == "a.b"
    assert one(spark, "почта.рф", ascii_domain) == "xn--80a1acny.xn--p1ai" and one(spark, "a.b", ascii_domain) == "a.b" and one(spark, None, ascii_domain) is None


def test_urls(spark):
    row = lambda v: tuple(spark.createDataFrame([(v,)], "v string").select(T.is_url(F.col("v")), T.is_http(F.col("v")), T.is_youtube(F.col("v"))).first())
    assert row("ftp://x") == (True, False, False) and row("https://www.youtube.com/watch") == (True, True, True) and row("a.txt") == (False, False, False)


@pytest.mark.parametrize(
    ("line", "said"),
    [("WEBVTT", None), ("12", None), ("00:00:01.000 --> 00:00:02.000", None), ("00:01,000 --> x", None), ("NOTE x", None), ("Kind: captions", None), ("[Music]", None), (" <c.a>Hi</c> &amp; <00:00:01.000>you ", "Hi & you"), ("", None)],
)
def test_spoken_line(spark, line, said):
    assert one(spark, line, T.spoken_line) == said


def test_words_and_secrets(spark):
    assert one(spark, "  a  b\nc ", T.word_count) == 3 and one(spark, None, T.word_count) == 0
    assert one(spark, "abc", lambda v: T.redact(F.lit("llmApiKey"), v)) == "<redacted>" and one(spark, "env:K", lambda v: T.redact(F.lit("llmApiKey"), v)) == "env:K"


def test_tables(spark):
    rows = [["a|b", "c\nd"], ["1"]]
    assert one(spark, rows, T.markdown_table, "array<array<string>>") == "| a\\|b | c d |\n| --- | --- |\n| 1 |"
    assert one(spark, [["h", "i"], ["1", "2", "3"], ["x"]], lambda v: T.markdown_table(v, escape=False), "array<array<string>>") == "| h | i |\n| --- | --- |\n| 1 | 2 |\n| x |  |"


def test_headings(spark):
    level = lambda s, o: spark.createDataFrame([(s, o)], "s string, o int").select(T.heading_level(F.col("s"), F.col("o"))).first()[0]
    assert [level("Heading 2", None), level("Title", None), level("Normal", 3), level("Normal", 6), level("Normal", None)] == [2, 1, 4, None, None]
