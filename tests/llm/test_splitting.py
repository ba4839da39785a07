import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import splitting as S
from corpusloom.llm.tokens import DEFAULT_VOCABULARY, byte_bpe, counter, token_counts

LIMITS = [("a", 40, 8), ("b", 64, 0), ("c", 500, 50)]


def texts():
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(1, 12)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(1, 30))).capitalize() + r.choice([".", "!", "?", '."'])
    paragraph = lambda: " ".join(sentence() for _ in range(r.randint(1, 5)))
    out = ["\n\n".join(paragraph() for _ in range(r.randint(1, 12))) for _ in range(15)]
    out += ["\r\n".join(paragraph() for _ in range(8)), "# T\n" + "\n## S\n\n".join(paragraph() for _ in range(6)), "x" * 5000, "ACGT" * 3000, " " * 3000, "\n" * 500, "a \n \n b" * 300]
    out += ["日本語の文章です。" * 120, "été naïve Straße — " * 200, "😀👍🏽" * 300, "word " * 3000, "1234567890" * 200, "".join(r.choices("ab .\n\t😀é日", k=4000)), "'ve'll\t\t  \n" * 200]
    return out


@pytest.fixture(scope="module")
def splitter():
    return S.Splitter(DEFAULT_VOCABULARY)


def test_round_trip_limits_and_overlap(splitter):
    encode, count = splitter.encoding.encode_ordinary, counter(DEFAULT_VOCABULARY)
    for t in texts():
        n = len(encode(t))
        by = {}
        for x in splitter.pieces(t, LIMITS):
            by.setdefault(x[0], []).append(x)
        assert set(by) == {name for name, cap, _ in LIMITS if n > cap}
        for name, cap, overlap in LIMITS:
            if n <= cap:
                continue
            at, tokens, last = 0, 0, 0
            for k, (_, no, start, end, size, shared, boundary, piece) in enumerate(by[name]):
                assert no == k and t[start:end] == piece and start <= at < end and size <= cap and count(piece) <= cap, (name, k, count(piece))
                if k:
                    assert min(overlap, last - 1) <= shared <= overlap + 8, (t[:20], shared)
                at, tokens, last = end, tokens + size - shared, size
            assert at == len(t) and tokens == n and boundary == "end"


def test_boundaries(splitter):
    p1, p2 = "One two three. " * 6 + "End.", "Alpha beta gamma. " * 7 + "Stop."
    t = f"{p1}\n\n{p2}\n\n{p1}"
    got = list(splitter.pieces(t, [("l", 55, 0)]))
    assert [x[6] for x in got] == ["paragraph", "paragraph", "end"] and got[0][7] == p1 + "\n\n"
    sentences = list(splitter.pieces("One two three. " * 40, [("l", 50, 0)]))
    assert all(x[6] == "sentence" and x[7].endswith(".") for x in sentences[:-1])
    lines = list(splitter.pieces("a b c d e f\n" * 40, [("l", 50, 5)]))
    assert all(x[6] == "line" and x[7].endswith("\n") for x in lines[:-1])
    assert {x[6] for x in list(splitter.pieces("word " * 300, [("l", 50, 5)]))[:-1]} == {"word"}
    assert {x[6] for x in list(splitter.pieces("ACGT" * 300, [("l", 50, 5)]))[:-1]} == {"character"}
    sections = list(splitter.pieces("\n".join(f"## S{i}\n\n{p1}\n" for i in range(4)), [("l", 60, 0)]))
    assert [x[6] for x in sections] == ["section"] * 3 + ["end"] and all(x[7].startswith("## S") for x in sections)


def test_operator(spark):
    data = [(1, None, 0), (2, "", 0), (3, "short", 0), (None, "word. " * 100, 0), (4, "word. " * 100, 0), (4, "word. " * 100, 0), (5, "long text. " * 40_000, 0)]
    df = spark.createDataFrame(data, "doc long, body string, piece int").withColumn("key", F.lit("k"))
    got = S.split_texts(df, "doc", "body", [("l", 60, 10), ("m", 100_000, None)])
    c = {r[0]: r[1] for r in got.where("limit_name = 'l'").groupBy("doc").count().collect()}
    assert set(c) == {None, 4, 5} and c[4] == 2 * c[None]
    assert {r[0] for r in got.where("limit_name = 'm'").select("doc").distinct().collect()} == {5}
    assert S.split_texts(df.limit(0), "doc", "body", [("l", 60, 10)]).collect() == [] and S.split_texts(df, "doc", "body", []).collect() == []
    for bad in [("l", 0, 0), ("l", 10, 5), ("l", 10, -1)]:
        with pytest.raises(ValueError):
            S.split_texts(df, "doc", "body", [bad])


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = f"/opt/tokenizers/{name}"
    df = spark.createDataFrame([(1, "Hello, world <|endoftext|> 日本"), (2, None), (3, "")], "id long, text string").withColumn("_text", F.lit("clash"))
    got = {r[0]: r[1] for r in token_counts(df, "text", ["id"], path).collect()}
    assert got[1] > 3 and got[2] == got[3] == 0


def test_two_libraries_agree():
    a, b = counter("/opt/tokenizers/byte_bpe_50k.tiktoken"), counter("/opt/tokenizers/byte_bpe_50k.json")
    assert all(a(t) == b(t) for t in texts()[:12])
    with pytest.raises(ValueError):
        counter("x.txt")
    assert b"".join(byte_bpe(DEFAULT_VOCABULARY)[1][i] for i in byte_bpe(DEFAULT_VOCABULARY)[0].encode_ordinary("héllo")).decode() == "héllo"
