"""Queries do the whole job: compared with results counted by hand or from other queries' SQL."""

import os

import duckdb
import pytest

from lumenframe.operators import rules as V
from lumenframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_v1_index_scores_of_few_issues(spark):
    rows = [("a", "WARNING")] * 3 + [("a", "ERROR")] * 2 + [("b", "INFO")] + [("c", "ERROR")] * 99
    scored = V.v1_index(V.rollup(spark.createDataFrame(rows, "dataset string, severity string"), ["dataset"]))
    found = {r.dataset: (r.annotation_score, r.image_score, r.class_score, r.box_score, r.quality_index) for r in scored.collect()}
    assert found == {"a": (90.0, 90.0, 91.0, 92.0, 90.75), "b": (100.0,) * 5, "c": (0.0, 0.0, 100.0, 0.0, 25.0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_v1_index_covers_every_issue(spark):
    duck = duckdb.connect()
    for name in ("orders", "lineitem"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    rolled = duck.sql(f"SELECT dataset, n_warning, n_error, n_critical FROM ({catalogue.oracle_sql()['issue_rollup']})").fetchall()
    wanted = {d: [max(0.0, 100.0 - x) for x in (5 * e, 2 * (e + w), 3 * w, 4 * (e + c))] for d, w, e, c in rolled}
    found = catalogue.queries()["v1_index"](spark, SF).collect()
    assert {r.dataset: [r.annotation_score, r.image_score, r.class_score, r.box_score] for r in found} == wanted
    assert all(r.quality_index == round(sum(wanted[r.dataset]) / 4, 4) for r in found)
