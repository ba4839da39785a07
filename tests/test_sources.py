import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import hypotheses as H
from corpusloom.operators import jobs as J
from corpusloom.operators.association import Corpus, UserError
from corpusloom.sources import records as R
from tests.conftest import rows

ARTICLE = """<PubmedArticle><MedlineCitation>{id}<DateCompleted>{done}</DateCompleted><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue></Journal>{title}{abstract}</Article></MedlineCitation></PubmedArticle>"""


def article(id='<PMID Version="1">7</PMID>', done="", date="<Year>2001</Year>", title="<ArticleTitle>T</ArticleTitle>", abstract=""):
    return ARTICLE.format(id=id, done=done, date=date, title=title, abstract=abstract)


def test_xml(spark, tmp_path):
    items = [
        article(title="<ArticleTitle>A <i>very</i> small p &lt; 0.05 &amp; q &gt; 1</ArticleTitle>", abstract="<Abstract><AbstractText>One <b>two</b>.</AbstractText></Abstract>"),
        article('<PMID Version="2">8</PMID>', "<Year>1999</Year>", "<MedlineDate>x</MedlineDate>", "", '<Abstract><AbstractText Label="A">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract>'),
        article("<PMID>9</PMID>", "", "<MedlineDate>Winter 1987-Spring 1988</MedlineDate>"),
        article("<PMID>10</PMID>", "", "<MedlineDate>12345 </MedlineDate>"),
        article("", "", "<Year>2000</Year>"),
        article("<PMID>11</PMID>", "", "<MedlineDate></MedlineDate>"),
    ]
    with gzip.open(tmp_path / "feed1.xml.gz", "wt") as f:
        f.write('<?xml version="1.0"?><PubmedArticleSet>' + "\n".join(items) + "</PubmedArticleSet>")
    got = {r["pmid"]: r for r in R.read_articles(spark, str(tmp_path / "feed1.xml.gz")).collect()}
    assert set(got) == {7, 8, 9, 10, 11} and {r["origin"] for r in got.values()} == {"feed1.xml.gz"}
    assert got[7]["title"] == "A very small p < 0.05 & q > 1" and got[7]["abstract"] == "One two."
    assert got[8]["title"] is None and got[8]["abstract"] == "First. Second." and got[9]["abstract"] is None
    assert [got[k]["pub_year"] for k in (7, 8, 9, 10, 11)] == [2001, 1999, 1987, 99999, 99999]
    assert rows(R.list_files(spark, str(tmp_path))) == [("feed1.xml.gz",)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"pmid": 1, "citation_count": 4}\nbroken\n{"pmid": 2}\n{"citation_count": 3}\n')
    assert rows(R.read_citations(spark, str(tmp_path / "c.json"))) == [(1, 4), (2, 0)]


def test_edges(spark, tmp_path):
    (tmp_path / "k.tsv").write_text('NAME\tTAG\tREL\tNAME\tTAG\tPMID\nname "x"\ttag\tR\tb\tB\t["1", 2]\na\tA\tR\tb\tB\t[1]\n')
    assert rows(R.read_edges(spark, str(tmp_path / "k.tsv"), "src")) == [('name "x"', "tag", "R", "b", "B", [1, 2], "src")]
    (tmp_path / "bad.tsv").write_text('h\th\th\th\th\th\na\tA\tR\tb\tB\t["x", 1]\n')
    with pytest.raises(Exception, match="x|MALFORMED"):
        R.read_edges(spark, str(tmp_path / "bad.tsv"), "src").collect()


def test_files_to_read(spark):
    base, up, done = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in [(["b2", "b1", "b3"], "name"), (["u1", "u0"], "name"), (["b2", "zz"], "origin")])
    got = lambda n: [tuple(r) for r in R.files_to_read(base, up, done, n).collect()]
    assert got(3) == [("b1", "baseline"), ("b3", "baseline"), ("u0", "update")] and got(1) == [("b1", "baseline")] and got(0) == [] and len(got(99)) == 4


def test_windows(spark):
    cases = {(2020, 2025, None): [(2020, 2025)], (2020, 2022, 1): [(2020, 2020), (2021, 2021), (2022, 2022)], (2020, 2025, 2): [(2020, 2021), (2022, 2023), (2024, 2025)], (2020, 2024, 2): [(2020, 2021), (2022, 2023), (2024, 2024)], (2020, 2020, 1): [(2020, 2020)], (2020, 2020, 5): [(2020, 2020)], (2022, 2020, 1): []}
    df = spark.createDataFrame(list(cases), "a int, b int, s int")
    for r in df.select("a", "b", "s", H.year_windows(F.col("a"), F.col("b"), F.col("s")).alias("w")).collect():
        assert [tuple(x) for x in r["w"]] == cases[r["a"], r["b"], r["s"]]


PAIR = {"data": [{"a_term": "a", "b_term": "b"}], "pair_hypothesis": "{a_term} {b_term}"}
CHAIN = {"data": [{"a_term": "a", "b_term": "b", "c_term": "c"}], "chain_hypotheses": {"AB": "{a_term}{b_term}", "BC": "{b_term}{c_term}", "AC": "{a_term}{c_term}", "rel_AC": "{a_term}{c_term}", "ABC": "{a_term}{b_term}{c_term}"}}


def test_evaluation_parameters():
    assert H.EvaluationParams(**PAIR).validated().iterations == 1 and H.EvaluationParams(**CHAIN).validated().censor_year_increment is None
    names = {"x_hypothesis": "pair_hypothesis", "y_hypotheses": "chain_hypotheses"}
    assert H.EvaluationParams.of({"data": [], "x_hypothesis": "h", "y_hypotheses": {}}, names) == H.EvaluationParams([], "h", {})
    with pytest.raises(UserError):
        H.EvaluationParams.of({"data": [], "x_hypothesis": "h", "pair_hypothesis": "g"}, names)
    with pytest.raises(TypeError):
        H.EvaluationParams.of({"data": [], "z_hypothesis": "h"}, names)
    for ok in (1, 3, 10):
        H.EvaluationParams(**PAIR, iterations=ok).validated()
    two = [{"a_term": "a", "b_term": "b"}, {"a_term": "a", "b_term": "c"}]
    H.EvaluationParams(two, "{a_term} {b_term}", is_dch=True).validated()
    bad = [PAIR | {"iterations": x} for x in (0, -1, 11)] + [PAIR | {"censor_year_increment": x} for x in (0, -1)]
    bad += [PAIR | {"data": []}, PAIR | {"pair_hypothesis": None}, PAIR | {"pair_hypothesis": "{a_term}"}, PAIR | {"data": [*PAIR["data"], *CHAIN["data"]]}, CHAIN | {"chain_hypotheses": {"AB": "{a_term}{b_term}"}}, PAIR | {"data": [{"a_term": "a"}]}]
    bad += [PAIR | {"is_dch": True}, {"data": [{"a_term": "a", "b_term": "b"}, {"a_term": "x", "b_term": "c"}], "pair_hypothesis": "{a_term} {b_term}", "is_dch": True}]
    for b in bad:
        with pytest.raises(UserError):
            H.EvaluationParams(**b).validated()


def test_results(spark, tmp_path):
    def put(path, value):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(value))

    with pytest.raises(FileNotFoundError):
        put("job/config.json", {})
        H.collect_results(spark, str(tmp_path / "job"))
    ab = {"A_B_Relationship": {"a_term": "a", "b_term": "b", "Result": "r"}}
    put("job/secrets.json", ab)
    put("job/output/iteration_1/debug/x.json", ab)
    put("job/output/x.json", ab)
    put("job/results/iteration_3/config.json", [ab, ab])
    got = H.collect_results(spark, str(tmp_path / "job"))
    assert sorted(r["iteration"] for r in got.collect()) == [1, 3, 3]
    assert rows(H.missing_iterations(got, 4)) == [(2,), (4,)]
    assert json.loads(got.first()["original_json"]) == ab


def test_evaluate(spark):
    docs = spark.createDataFrame([(i, 2000 + i, "x y", "x", "", "", 0) for i in range(4)], "pmid long, pub_year int, title string, abstract string, body string, origin string, citation_count long")

    def scorer(batches):
        for b in batches:
            b["n"] = b["ab_pmid_intersection"].map(len)
            yield b[["entry", "lo", "hi", "iteration", "n"]]

    run = lambda **p: rows(H.evaluate(Corpus(docs), H.EvaluationParams([{"a_term": "x", "b_term": "y", "ab_pmid_intersection": ["9"]}, {"a_term": "x", "b_term": "y"}], "{a_term} {b_term}", **p), scorer, "entry int, lo int, hi int, iteration int, n int"))
    assert run(iterations=2) == [(0, 1000, 2100, 1, 1), (0, 1000, 2100, 2, 1), (1, 1000, 2100, 1, 4), (1, 1000, 2100, 2, 4)]
    assert run(censor_year_lower=2000, censor_year_upper=2003, censor_year_increment=3) == [(0, 2000, 2002, 1, 3), (0, 2003, 2003, 1, 1), (1, 2000, 2002, 1, 3), (1, 2003, 2003, 1, 1)]


def test_scorer_files(spark, tmp_path):
    data = spark.createDataFrame([("a", "b", None, ["1", "2"], [], [])], H.INPUT)
    H.write_scorer_input(data, False, str(tmp_path / "j"), H.config_template(H.EvaluationParams(**PAIR), False))
    assert (tmp_path / "j/data.tsv").read_text() == "a_term\tb_term\tab_pmid_intersection\na\tb\t['1', '2']\n"
    assert (tmp_path / "j/files.txt").read_text() == "data.tsv\n" and (tmp_path / "j/output").is_dir()
    assert json.loads((tmp_path / "j/config.json").read_text())["MODEL"] == "o3-mini"
    template = {"SETTINGS": {"MODEL": "", "DELAY": 10}, "JOBS": {"one": {"position": False}}}
    got = H.config_template(H.EvaluationParams(**PAIR, iterations=3), False, template, {"MODEL": "SETTINGS.MODEL", "pair_hypothesis": "HYPOTHESIS", "is_dch": "JOBS.one.is_dch", "POST_N": None}, ("one", "three"))
    assert got["SETTINGS"] == {"MODEL": "o3-mini", "DELAY": 10} and got["HYPOTHESIS"] == "{a_term} {b_term}" and got["JOBS"] == {"one": {"position": False, "is_dch": False}}
    assert got["JOB_TYPE"] == "one" and got["ITERATIONS"] == 3 and "POST_N" not in got and template["SETTINGS"]["MODEL"] == ""
    assert H.scorer_input(data, True).columns[3:] == H.LISTS


def test_job_columns(spark):
    df = spark.createDataFrame([(50,), (51,)], "n int").select(J.priority(F.col("n")))
    assert [r[0] for r in df.collect()] == ["HIGH", "MEDIUM"] == [J.priority_of(50), J.priority_of(51)]
    t = spark.sql("SELECT timestamp'2024-07-01 13:05:00' AS t, -0.5D AS lo, 2D AS hi").select(J.local_time("t", "America/Chicago"), J.clamp_progress(F.col("lo")), J.clamp_progress(F.col("hi"))).first()
    assert tuple(t) == ("2024-07-01 8:05:00 AM", 0.0, 0.9999)
