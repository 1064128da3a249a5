"""Column expressions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import jsonfields as J
from factloom.functions import numbers as N
from factloom.functions import text as X


def run(spark, values, fn, type_="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {type_}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert run(spark, ["\t a  b\n", None, " \x01 ", "é "], X.clean_text) == ["a  b", None, "", "é"]
    assert run(spark, ["  Foo\t\n BAR ", "ÀB", ""], X.normalize_text) == ["foo bar", "àb", ""]


def test_tags(spark):
    got = run(spark, [["Tech", " Software ", "coding", None, "", "  ", "New"], None, [], ["prefs", "BOOKS", "book"],
                      ["personal-info", "kin", "jobs"]], X.normalize_tags, "array<string>")
    assert got == [["software", "new"], [], [], ["preferences", "publishing"], ["personal", "family", "jobs"]]
    again = run(spark, got, X.normalize_tags, "array<string>")
    assert again == got
    merged = run(spark, [["a", "A"], None], lambda c: X.merge_tags(c, ["A", "b"]), "array<string>")
    assert merged == [["a", "A", "b"], ["A", "b"]]
    assert X.split_tags(" a, b ,,c\t") == ["a", "b", "c"] and X.split_tags(None) == []


def test_secrets(spark):
    dash = "-" * 5
    values = ["s" + "k-ant-" + "a" * 24, "see gh" + "s_" + "b" * 36, "github" + "_pat_" + "c" * 30,
              "AS" + "IA" + "Q" * 16, "xox" + "b-123456789012", "AI" + "za" + "d" * 35,
              "ey" + "Jhbc.ey" + "Jzdw.sig", f"{dash}BEGIN PRIVATE KEY{dash}", "ask-me about skiing", "AKIA short"]
    assert run(spark, values, X.secret_label) == [
        "OpenAI key", "GitHub token", "GitHub token", "AWS access key id", "Slack token", "Google API key", "JWT",
        "PEM private key", None, None]


def test_instants(spark):
    values = ["2027-01-01T00:00:00Z", " 2027-01-01T02:00:00.250+02:00 ", "", None, "2027-01-01", "2027-13-01T00:00:00Z",
              "soon"]
    assert run(spark, values, lambda c: X.iso(X.parse_iso(c))) == [
        "2027-01-01T00:00:00Z", "2027-01-01T00:00:00.250Z", None, None, None, None, None]
    assert run(spark, values, X.bad_iso) == [False, False, False, False, True, True, True]


def test_html(spark):
    values = ["a<br/>b<BR>c<br clear=all>d", "&amp;lt;&nbsp;x&gt;", "“q” ‘s’", None, "<p>hi</p><script>x<1</script>", ""]
    assert run(spark, values, X.html_to_text) == ["a\nb c\nd", "< x>", "\"q\" 's'", "", " hi  x ", ""]


def test_ascii(spark):
    values = ["Ærø café", "“x” — €5 ß", "日本 ok", None, "plain"]
    assert run(spark, values, X.ascii_fold) == ["AEro cafe", '"x" - EUR5 ss', " ok", None, "plain"]


def test_dates(spark):
    values = ["1/2/24", "01/02/2024", "1.2.2024", "2024-1-2", "12/31/35", "12/31/34", "2/31/2024", "13/1/2024", "x", None,
              "2024-13-01", " 1/2/24"]
    shown = run(spark, values, lambda c: F.date_format(D.clean_date(c, 2024), "yyyyMMdd"))
    assert shown == ["20240102", "20240102", "20240102", "20240102", "19351231", "20341231", "20240302", None, None, None,
                     "20250101", None]


def test_epoch_dates(spark):
    values = [202402291530, 20240229, 20240230, 1709164800, 1709164800000, 202402292560, 0, -86400]
    shown = run(spark, values, lambda c: F.date_format(D.clean_epoch_date(c), "yyyy-MM-dd"), "bigint")
    # No such day or time: read as seconds.
    assert shown == ["2024-02-29", "2024-02-29", "1970-08-23", "2024-02-29", "2024-02-29", "8383-11-16", "1970-01-01",
                     "1969-12-31"]


def test_day_numbers(spark):
    got = run(spark, ["2024-06-02", "0001-01-01"], lambda c: D.julian_day(c.cast("date")))
    assert got[1] == 1 and got[0] % 7 == 0      # a Sunday
    back = run(spark, [*got, 0], lambda c: F.date_format(D.from_julian_day(c), "yyyy-MM-dd"), "bigint")
    assert back == ["2024-06-02", "0001-01-01", None]


def test_times(spark):
    values = ["5pm", "5:30 PM", "0530", "530p", "12am", "12:15 pm", "17.45", "5-5", "", None, "x", "12345", "5:", "7 a",
              "5:3p", "12"]
    assert run(spark, values, D.parse_hhmm) == [
        1700, 1730, 530, 1730, 0, 1215, 1745, 505, -1, -1, -1, -1, -1, 700, 503, 1200]
    assert run(spark, [0, 5, 1159, 1200, 1305], D.format_ampm, "int") == [
        "12:00 AM", "12:05 AM", "11:59 AM", "12:00 PM", "1:05 PM"]


def test_minutes_across_a_clock_change(spark):
    # New York went from 01:59 to 03:00 on 10 March 2024.
    got = run(spark, [202403100330, 202403100130, 0],
              lambda c: D.diff_minutes(c, F.lit(202403100100).cast("long"), "America/New_York"), "bigint")
    assert got == [90, 30, None]


def test_numbers(spark):
    values = ["1,234.50", " 7 ", "-5", "1.2.3", "", None, ",", "12abc", ".5", "1E3", "5."]
    assert run(spark, values, N.is_valid_number) == [True, True, False, False, False, False, False, False, True, False, True]
    assert run(spark, values, N.parse_number) == [1234.5, 0.0, -5.0, 1.2, 0.0, 0.0, 0.0, 12.0, 0.5, 1000.0, 5.0]
    assert run(spark, ["-7.9", "x"], N.parse_whole) == [-7, 0]
    nums = [2.5, -2.5, 2.4, -0.1]
    assert run(spark, nums, lambda c: N.round_half_away(c, 0), "double") == [3, -3, 2, 0]
    assert run(spark, nums, lambda c: N.round_up(c, 0), "double") == [3, -3, 3, -1]
    assert run(spark, nums, lambda c: N.round_down(c, 0), "double") == [2, -2, 2, 0]
    assert run(spark, nums, N.whole_part, "double") == [2, -3, 2, -1]


@pytest.mark.parametrize("path,kind,want", [
    ("a.b[1].c", "string", "x"), ("a.n", "int", 5), ("a.n", "long", 5), ("a.n", "string", "5"), ("a.d", "double", 1.5),
    ("a.t", "boolean", True), ("a.none", "boolean", False), ("a.none", "string", None), ("a.b[9].c", "string", None),
    ("a.b[1].c", "char", "x"), ("a.b[1]", "object", '{"c":"x"}'), ("a.list", "array", "[1,2]"), ("a.s", "int", None)])
def test_json_fields(spark, path, kind, want):
    doc = '{"a":{"b":[{"c":"w"},{"c":"x"}],"n":5,"d":1.5,"t":true,"list":[1,2],"s":"word"}}'
    assert run(spark, [doc], lambda c: J.json_field(c, path, kind)) == [want]


def test_json_date_and_bad_json(spark):
    got = run(spark, ['{"d":"3/4/24"}', "{broken", None], lambda c: F.date_format(J.json_field(c, "d", "date"), "yyyy-MM-dd"))
    assert got == ["2024-03-04", None, None]
