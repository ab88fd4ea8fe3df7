"""Score sheets: the layouts of FIXTURES.md, written to a temporary folder."""

import csv
import os
import re
import statistics

import pytest
from pyspark.sql import functions as F

from gridscope.operators import order as O
from gridscope.operators import scores as S
from gridscope.operators import sheets as L
from gridscope.plans import analyses as P
from gridscope.plans.catalog import QUERIES
from gridscope.sources.cells import pandas_headers, read_cells
from paths import SF_SMALL

# Layouts of FIXTURES.md sections 1 and 2 with made-up names: sub-header rows, empty
# columns, flags in a keyword column, legend rows.
FIRST = [[3.5, 3.4, 3.39], [4.0, 3.9, 4.05], [3.44, 3.45, 3.44], [3.43, 3.42, 3.44], [3.37, 3.36, 3.38], [0.7, 0.66, 0.7]]
FIRST += [[1.0 + k / 10, 1.5 + k / 10, 2.0 + k / 10] for k in range(19)]
SECOND = [173.8, 164.63, 163.82, 156.34, 37.13] + [40.0 + 5 * k for k in range(21)]


def _sheet(path, header, body):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([header, *body])


@pytest.fixture(scope="module")
def sample_scores(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sheets")
    header = ["1 - NOME DA ESCOLA", "4°BIM", "", "3º BIM", "", "2º BIM", "SEMANA 11 ATÉ 21 - 1º BIMESTRE", "SEMANA 01 ATÉ 10 - 1º BIMESTRE"]
    body = [["", "", "", "S 29", "", "S 11", "S 1", ""], ["", "", "", "2025-08-23 00:00:00", "", "", "2024-05-04", ""]]
    body += [[f"Escola {k}", "", "", a, f"{k}º", b, x, "X"] for k, (a, b, x) in enumerate(FIRST)]
    body += [["Escola sem nota", "", "", "", "", "", "", "X"], [""] * 8, ["", "", "", "", "", "", "", "0,0 À 5,0"]]
    _sheet(folder / "first.csv", header, body)
    header = ["NOME", "3º BIM", "", "PLATAFORMA 2° BIMESTRE DA SEMANA 11 ATÉ", "", "2025 - 1º BIMESTRE"]
    body = [["", "S 29", "", "", "", ""]] + [[f"Escola {k}", "", "", v, "1 T", "X"] for k, v in enumerate(SECOND)] + [["", "", "", "", "", "3 ou mais"]]
    _sheet(folder / "second.csv", header, body)
    return L.cell_sheet_scores(read_cells(spark, str(folder))).drop("pos")


def _sheet_of_size(scores, n):
    """The sheet with ``n`` scored entities."""
    sizes = {r["Planilha"]: r["count"] for r in scores.groupBy("Planilha").count().collect()}
    names = [k for k, v in sizes.items() if v == n]
    assert len(names) == 1, sizes
    return names[0]


def _stats(scores, sheet):
    sub = scores.filter(F.col("Planilha") == sheet)
    return sub.agg(F.count("*").alias("n"), F.avg("Media").alias("mean"), F.stddev_samp("Media").alias("std"),
                   F.min("Media").alias("mn"), F.max("Media").alias("mx")).first()


def test_first_sample_sheet(sample_scores):
    sheet = _sheet_of_size(sample_scores, 25)
    r = _stats(sample_scores, sheet)
    means = [sum(x) / 3 for x in FIRST]
    assert (r["n"], r["mean"], r["std"]) == (25, pytest.approx(statistics.mean(means)), pytest.approx(statistics.stdev(means)))
    assert (r["mn"], r["mx"]) == pytest.approx((min(means), max(means)))
    rows = sample_scores.filter(F.col("Planilha") == sheet)
    top = [x["Media"] for x in rows.orderBy(F.desc("Media")).limit(4).collect()]
    assert top == pytest.approx(sorted(means, reverse=True)[:4])
    assert {x["Valores_Utilizados"] for x in rows.collect()} == {3}


def test_second_sample_sheet(sample_scores):
    sheet = _sheet_of_size(sample_scores, 26)
    r = _stats(sample_scores, sheet)
    assert (r["n"], r["mean"], r["std"]) == (26, pytest.approx(statistics.mean(SECOND)), pytest.approx(statistics.stdev(SECOND)))
    assert (r["mn"], r["mx"]) == pytest.approx((37.13, 173.8))


def test_sheet_stats_rounding(sample_scores):
    sheet = _sheet_of_size(sample_scores, 25)
    a = {r["Planilha"]: r for r in S.sheet_stats(sample_scores).collect()}[sheet]
    assert (a["escolas"], a["media"], a["minimo"], a["maximo"]) == (25, round(statistics.mean(sum(x) / 3 for x in FIRST), 2), 0.69, 3.98)


def test_ranking_medals(sample_scores):
    sheet = _sheet_of_size(sample_scores, 26)
    ranked = S.rank_in_sheet(sample_scores).filter(F.col("Planilha") == sheet).orderBy("rank").collect()
    assert [r["medal"] for r in ranked[:4]] == ["🥇", "🥈", "🥉", "📊"]
    assert ranked[0]["Media"] == pytest.approx(173.8)


def _write_hier(path):
    rows = [
        ["", "", "", "", ""],
        ["", "LÍNGUA PORTUGUESA", "", "MATEMÁTICA", ""],
        ["", "1ª QUINZENA", "", "1ª QUINZENA", ""],
        ["ESCOLA", "ENGAJAMENTO", "ACERTOS", "ENGAJAMENTO", "ACERTOS"],
        ["", "", "", "", ""],
        ["School A", "75,5 +", "70 -", "80", "60="],
        ["School B", "50", "", "-10", "n/a"],
        ["", "", "", "", ""],
    ]
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def test_hierarchical_sheet(spark, tmpdir_fresh):
    _write_hier(os.path.join(tmpdir_fresh, "hier.csv"))
    cells = read_cells(spark, os.path.join(tmpdir_fresh, "*.csv"))
    kind = L.is_hierarchical(cells).first()
    assert kind["all_unnamed"] and kind["hierarchical"]
    rec = L.unpivot_scores(cells).orderBy("Escola", "Area", "Metrica").collect()
    got = [(r["Escola"], r["Area"], r["Periodo"], r["Metrica"], r["Valor"]) for r in rec]
    assert got == [
        ("School A", "Língua Portuguesa", "1ª QUINZENA", "Acertos", 70.0),
        ("School A", "Língua Portuguesa", "1ª QUINZENA", "Engajamento", 75.5),
        ("School A", "Matemática", "1ª QUINZENA", "Acertos", 60.0),
        ("School A", "Matemática", "1ª QUINZENA", "Engajamento", 80.0),
        ("School B", "Língua Portuguesa", "1ª QUINZENA", "Engajamento", 50.0),
        ("School B", "Matemática", "1ª QUINZENA", "Engajamento", 10.0),
    ]
    res = P.score_sheets(cells)
    means = {r["Escola"]: (r["Media"], r["Valores_Utilizados"]) for r in res["scores"].collect()}
    assert means["School A"] == (pytest.approx(71.375), 4)
    assert means["School B"] == (pytest.approx(30.0), 2)


def test_pandas_headers():
    assert pandas_headers(["a", "", "a", "b", "a"]) == ["a", "Unnamed: 1", "a.1", "b", "a.2"]


def test_entity_and_keyword_columns(spark):
    df = spark.createDataFrame([("x", "1.5", "a", "2"), ("y", None, "b", "z")],
                               "`Nome da Escola` string, `Nota 1` string, texto string, `Media Final` string")
    assert S.entity_column(df) == "Nome da Escola"
    assert S.keyword_columns(df) == ["Nota 1", "Media Final"]
    rows = {r["Escola"]: (r["Media"], r["Valores_Utilizados"]) for r in S.sheet_scores(df, "s").collect()}
    assert rows == {"x": (1.75, 2)}


def test_score_sheets_many_files(spark, tmpdir_fresh):
    """P1 over a folder holding a plain sheet and a hierarchical one."""

    _write_hier(os.path.join(tmpdir_fresh, "hier.csv"))
    with open(os.path.join(tmpdir_fresh, "plain.csv"), "w", encoding="utf-8") as f:
        f.write("Nome da Escola,Nota 1,Media Final,obs\nEscola X,7.5,8.5,ok\nEscola Y,,6,ok\nEscola Z,,,ok\n")
    res = P.score_sheets(read_cells(spark, os.path.join(tmpdir_fresh, "*.csv")))
    got = {(r["Planilha"], r["Escola"]): (r["Media"], r["Valores_Utilizados"]) for r in res["scores"].collect()}
    assert got == {("plain.csv", "Escola X"): (8.0, 2), ("plain.csv", "Escola Y"): (6.0, 1),
                   ("hier.csv", "School A"): (71.375, 4), ("hier.csv", "School B"): (30.0, 2)}
    msgs = {r["file"]: r["message"] for r in res["messages"].collect()}
    assert msgs == {"plain.csv": "Arquivo plain.csv processado com sucesso - 2 escolas encontradas",
                    "hier.csv": "Arquivo hier.csv (hierárquica) processado - 2 escolas"}
    stats = {r["Planilha"]: r["escolas"] for r in res["sheet_stats"].collect()}
    assert stats == {"plain.csv": 2, "hier.csv": 2}
    m = res["engagement_matrix"].collect()
    assert {r["area_metrica"] for r in m} == {"Língua Portuguesa - Engajamento", "Língua Portuguesa - Acertos",
                                             "Matemática - Engajamento", "Matemática - Acertos"}



def _long_sheets(spark, tmp, rows=60):
    """A plain and a hierarchical sheet, each longer than several blocks of the tests below."""
    os.makedirs(os.path.join(tmp, "in"))
    _write_hier(os.path.join(tmp, "in", "hier.csv"))
    with open(os.path.join(tmp, "in", "hier.csv"), encoding="utf-8") as f:
        lines = list(csv.reader(f))
    lines[7:] = [[f"Escola {k}", str(k + 1), "", "", ""] for k in range(rows)] + [["", "9", "", "", ""]] + [["Escola Z", "7", "", "", ""], [""] * 5, ["Escola fora", "8", "", "", ""]]
    _sheet(os.path.join(tmp, "in", "hier.csv"), lines[0], lines[1:])
    _sheet(os.path.join(tmp, "in", "plain.csv"), ["Nome da Escola", "Nota 1", "Media Final"], [[f"Escola {k}", k, "" if k % 2 else k + 1] for k in range(rows)])
    return read_cells(spark, os.path.join(tmp, "in"), ("csv",)).localCheckpoint()


@pytest.fixture()
def no_broadcast(spark):
    """Facts as large as they would have to be before Spark deals them out."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]


def test_sheets_meet_their_facts_by_blocks(spark, tmpdir_fresh, no_broadcast, monkeypatch):
    """no join deals the rows of a whole sheet to one task, and blocks lose none."""
    monkeypatch.setattr(L, "BLOCK", 7, raising=False)
    cells = _long_sheets(spark, tmpdir_fresh)
    records = L.unpivot_scores(cells.filter(F.col("file") == "hier.csv"))
    dealt = _exchanges(records) + _exchanges(L.cell_sheet_scores(cells.filter(F.col("file") == "plain.csv")))
    assert dealt and not [x for x in dealt if "_block" not in x and "pos" not in x]
    hier, plain = L.split_by_kind(cells)
    assert {r["file"]: r["n"] for r in hier.groupBy("file").agg(F.countDistinct("pos").alias("n")).collect()} == {"hier.csv": 70}
    assert {r["file"]: r["n"] for r in plain.groupBy("file").agg(F.countDistinct("pos").alias("n")).collect()} == {"plain.csv": 60}
    got = {(r["Escola"], r["Metrica"]): r["Valor"] for r in records.filter("Area = 'Língua Portuguesa'").collect()}
    assert got == {("School A", "Engajamento"): 75.5, ("School B", "Engajamento"): 50.0, ("School A", "Acertos"): 70.0, ("Escola Z", "Engajamento"): 7.0,
                   **{(f"Escola {k}", "Engajamento"): k + 1.0 for k in range(60)}}
    scores = {r["Escola"]: (r["Media"], r["Valores_Utilizados"]) for r in L.cell_sheet_scores(plain).collect()}
    assert scores == {f"Escola {k}": (float(k), 1) if k % 2 else (k + 0.5, 2) for k in range(60)}


def test_hier_records_deals_no_whole_sheet(spark, no_broadcast):
    """the query's joins of cells go by blocks too."""
    records = QUERIES["hier_records"](spark, SF_SMALL)
    dealt = _exchanges(records)
    assert dealt and not [x for x in dealt if "_block" not in x]
    assert records.select("file").distinct().count() == 5


def test_scores_and_ranking_are_made_once(spark, tmpdir_fresh, monkeypatch):
    """every result of P1 reads one table of scores; the report takes the ranking."""
    written = []
    for module in (P, O):
        monkeypatch.setattr(module, "materialize", lambda df, label, real=module.materialize: written.append(label) or real(df, label))
    res = P.score_sheets(_long_sheets(spark, tmpdir_fresh))
    assert (written.count("scores"), written.count("buckets")) == (1, 1)
    ranks = {(r["Planilha"], r["Escola"]): r["rank"] for r in res["ranking"].collect()}
    assert len(ranks) == 123 and ranks[("plain.csv", "Escola 59")] == 1
    assert {(r["Planilha"], r["Escola"]): r["rank"] for r in res["report"].collect()} == ranks
    assert {r["Planilha"]: r["escolas"] for r in res["sheet_stats"].collect()} == {"plain.csv": 60, "hier.csv": 63}
