"""Every registered query of reports and compilers against its DuckDB statement, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from scriptorium.operators import evaluation, ranking
from scriptorium.plans import compilers, construction, oracles, queries
from scriptorium.plans import evaluation as reports

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted({*reports.QUERIES, *compilers.QUERIES, *construction.QUERIES, "loo_bm25", "corpus_bleu", "style_summary", "bm25_topk", "dense_topk", "gold_preferences"} - {"checkpoint_choice", "built_factors", "complementary_pairs"})


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) if isinstance(x, float) else x if isinstance(x, (bool, str)) else int(x) if hasattr(x, "__int__") else str(x)


@pytest.fixture(scope="module")
def duck():
    if not DATA.is_dir():
        pytest.skip("the driver's tables are not here")
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_statement(spark, duck, name):
    statements = oracles.oracle_sql() | reports.oracle_sql() | compilers.oracle_sql() | construction.oracle_sql()
    found = queries.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    answer = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({statements[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in answer), key=str)


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "id string, candidate_id string, pos int, type string, score double, label double")
    row = evaluation.ranking_report(none).first()
    assert row["queries"] == 0 and row["mrr"] == 0 and row["pearson_queries"] == 0
    assert ranking.summary(none, "score").first()["p90"] == 0
    assert evaluation.group_pairwise(none, "top_pairs").count() == 0


def test_resampled_means_scatter_as_those_of_drawn_rows(spark):
    rows = spark.createDataFrame([(str(i), float(i % 7)) for i in range(400)], "k string, v double")
    means = [r["v"] for r in ranking.bootstrap_means(rows, ("v",), "k", 800, "5").collect()]
    mean = sum(means) / len(means)
    values = [i % 7 for i in range(400)]
    center = sum(values) / 400
    deviation = math.sqrt(sum((v - center) ** 2 for v in values) / 400 / 400)
    assert len(means) == 800 and abs(mean - center) < 0.02
    assert abs(math.sqrt(sum((m - mean) ** 2 for m in means) / 800) / deviation - 1) < 0.1


def test_a_checkpoint_by_each_key(spark):
    epochs = spark.createDataFrame(
        [(0, 0.6, 0.5, 0.3, 0.9, 0.2), (1, 0.7, 0.6, 0.2, 0.8, 0.1), (2, 0.7, 0.4, 0.5, 0.7, 0.1), (3, 0.7, 0.4, 0.5, 0.7, 0.1)],
        "epoch int, pair_accuracy double, pair_loss double, accuracy double, loss double, regret double",
    )
    picked = {s: evaluation.checkpoint_choice(epochs, "listwise", s).first()["epoch"] for s in ("auto", "pair_accuracy", "group_accuracy", "listwise_kl")}
    assert picked == {"auto": 2, "pair_accuracy": 2, "group_accuracy": 2, "listwise_kl": 2}
    with pytest.raises(ValueError):
        evaluation.checkpoint_choice(epochs, "listwise", "luck")
