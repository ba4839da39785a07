from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import terms as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_tokenize():
    t = T.tokenize("The_quick brown fox jumped over the lazy dog.")
    assert {"the", "quick", "lazy"} <= set(t) and not any(" " in x for x in t)


def test_sanitize_and_split():
    assert T.sanitize("my_search & term") == "my search&term"
    assert T.sanitize("my_search & term", keep_operators=False) == "my search term"
    assert T.split("term1 & term2 | term3", keep_operators=True) == ["term1", "&", "term2", "|", "term3"]
    assert T.split("term1 & term2 | term3") == ["term1", "term2", "term3"]


def test_ngrams():
    assert set(T.ngrams("the quick brown fox", (1,))) == {"the", "quick", "brown", "fox"}
    assert set(T.ngrams("the quick brown fox", (2,))) == {"the quick", "quick brown", "brown fox"}
    assert len(T.ngrams("the quick brown fox")) == 7


def test_columns_agree_with_driver(spark):
    texts = ["my_search & term", "A|(b c)&D-e", "", "  ", "µ-opioid ½ naïve", "x & ", "ΑΒΓ 12_3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.words("t"), X.sanitized("t"), X.sanitized("t", False), X.subterms("t"))
    for t, words, clean, bare, subs in df.collect():
        if t is None:
            assert words is None
            continue
        assert (words, clean, bare, subs) == (T.tokenize(t), T.sanitize(t), T.sanitize(t, False), T.split(t))


def test_grams(spark):
    assert one(spark, "a b c", lambda c: X.grams(F.split(c, " "), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: X.grams(F.split(c, " "), 3)) == []
    assert one(spark, " a B ", X.trimmed_lower) == "a b"
    assert one(spark, None, X.trimmed_lower) is None


def test_small_functions(spark):
    assert one(spark, "a b c", X.gram_order) == 3
    assert one(spark, 12_345_678, X.document_bucket, "long") == "documents_12m"
    assert one(spark, "the", X.shard_of) == "shard_" + f"{__import__('zlib').crc32(b'the') % 950 + 1:04d}"
    assert one(spark, "docker://a.b/c:1.2", X.file_safe) == "a_b_c_1_2"
    assert one(spark, "x" * 81, X.short_description) == "x" * 77 + "..."
    assert one(spark, "/job/output/iteration_3/x.json", X.iteration_of) == 3
    assert one(spark, "/job/output/x.json", X.iteration_of) is None
    assert one(spark, "/iteration_1/b/iteration_12/x.json", X.iteration_of) == 12


def test_iteration_that_is_no_number_is_an_error(spark):
    try:
        one(spark, "/job/iteration_abc/x.json", X.iteration_of)
    except Exception as e:
        assert "CAST" in str(e)
    else:
        raise AssertionError


def test_parse():
    assert T.parse("a&b|c").tree == ("or", ("and", ("sub", 0), ("sub", 1)), ("sub", 2))
    assert T.parse("a&(b|c)").tree == ("and", ("sub", 0), ("or", ("sub", 1), ("sub", 2)))
    assert T.parse("(cancer").tree == ("sub", 0) and T.parse("x &").tree == ("sub", 0)
    for bad in ["", "()", "&", "(a)(b)", "b & ()a", "a (b)", "a | | b", "(a & b", "a & b)", "&a b|c"]:
        assert T.parse(bad).tree is None, bad
    assert T.parse("|".join(["a"] * 100)).tree is not None
    assert T.parse("|".join(["a"] * 101)).tree is None


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from("abc"), lambda t: st.tuples(st.sampled_from("&|"), t, t), max_leaves=8), st.sets(st.sampled_from("abc")))
def test_parse_evaluates_like_python(tree, present):
    def text(t):
        return t if isinstance(t, str) else f"({text(t[1])} {t[0]} {text(t[2])})"

    def truth(t):
        return t in present if isinstance(t, str) else (truth(t[1]) and truth(t[2]) if t[0] == "&" else truth(t[1]) or truth(t[2]))

    q = T.parse(text(tree))

    def run(n):
        if n[0] == "sub":
            return q.subterms[n[1]] in present
        return (all if n[0] == "and" else any)(run(x) for x in n[1:])

    assert run(q.tree) == truth(tree)


def test_user_error(spark):
    assert one(spark, "E: -BEGIN USER-FACING ERROR- bad\nterm -END USER-FACING ERROR-", X.user_error) == "bad\nterm"
    assert one(spark, "E", X.user_error) == "An error occurred during execution of this job."
    assert one(spark, None, X.user_error) is None
