"""Golden tests for Column-level text functions."""
import unicodedata

from pyspark.sql import functions as F

from clauseflow.functions import lexicon as lx
from clauseflow.functions import textcols as tc


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("r")).first()["r"]


def test_strip_matches_python_unicode_whitespace(spark):
    for s in ["  a b  ", " x ", "\x1cy\x1f", "\t\n z \r\n", ""]:
        assert one(spark, tc.strip_ws(F.col("t")), s) == s.strip()


def test_word_count_matches_python_split(spark):
    for s in ["", "   ", "one", "a  b\tc\nd", " a b ", "x y"]:
        assert one(spark, tc.word_count(F.col("t")), s) == len(s.split())


def test_clean_text_and_similarity_norm(spark):
    s = "  Héllo,   World!\n\nIt's  5.25%  "
    assert one(spark, tc.clean_text(F.col("t")), s) == " ".join(s.split())
    # lower -> non [a-z0-9 whitespace] to space -> collapse -> strip (accents are lost)
    assert one(spark, tc.similarity_norm(F.col("t")), s) == "h llo world it s 5 25"


def test_strip_tags(spark):
    assert one(spark, tc.strip_tags_and_clean(F.col("t")), "<p>a</p><br/>b  <i>c</i>") == "a b c"


def test_nfkc_only_touches_non_ascii(spark):
    rows = [("ﬁne Ａ b",), ("plain ascii",)]
    df = spark.createDataFrame(rows, "t string")
    out = {r["t"]: r["n"] for r in tc.with_nfkc(df, "t", "n").collect()}
    for (s,) in rows:
        assert out[s] == unicodedata.normalize("NFKC", s)


def test_quoted_label(spark):
    assert one(spark, tc.quoted_label(F.col("t")), 'Find "  Cap On Liability " here "x"') == "cap on liability"
    assert one(spark, tc.quoted_label(F.col("t")), "no quotes") == ""
    assert one(spark, tc.has_quoted(F.col("t")), 'a "" b') is False


def test_first_match_is_alphabetical_and_substring(spark):
    # "non-exclusive" contains "exclusive" (substring semantics)
    s = "licence is non-exclusive and without notice"
    assert one(spark, tc.first_match(F.col("t"), lx.HIGH_RISK_PHRASES), s) == "exclusive"
    assert one(spark, tc.first_match(F.col("t"), lx.HIGH_RISK_PHRASES), "nothing here") is None


def test_count_and_regex_count(spark):
    s = "either party may give written notice; both parties agree"
    assert one(spark, tc.count_phrases(F.col("t"), lx.FAIRNESS_BALANCED_PHRASES), s) == 3
    # literal backslash-b pattern never matches ordinary text
    assert one(spark, tc.regex_count(F.col("t"), lx.OBLIGATION_PATTERN_LITERAL_B), "shall must shall") == 0
    assert one(spark, tc.regex_count(F.col("t"), lx.OBLIGATION_PATTERN_WORD), "shall must shall") == 3


def test_uni_bi_grams_skip_short_words(spark):
    got = one(spark, tc.uni_bi_grams(F.col("t")), "a bc de f gh")
    assert got == ["bc", "de", "gh", "bc de", "de gh"]


def test_valid_clause_edges(spark):
    base = "Party shall do this"  # 4 words
    cases = {
        base: False,
        base + " now": True,                                  # 5 words
        "party shall do this now": False,                     # lower-case start
        "Party will do this now": False,                      # no keyword
        "É" + "tat shall pay the fee": True,                  # non-ASCII upper case start
        " ".join(["Word"] * 119 + ["shall"]): True,           # 120 words
        " ".join(["Word"] * 120 + ["shall"]): False,          # 121 words
        "Mayor said the thing now": True,                     # 'may' is a substring test
    }
    for s, want in cases.items():
        assert one(spark, tc.is_valid_clause(F.col("t")), s) is want, s
