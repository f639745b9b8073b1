import pytest

from corvane.operators import requests
from corvane.sources import records


def test_bounds_of_group_requests(spark):
    rows = [("q", None, None, None, None), ("", 1, "u", "f", "zavrsni"), ("é" * 500, 50, "u" * 100, "f" * 200, "diplomski"), ("q" * 501, 51, "u" * 101, "f" * 201, "doktorski"), (None, 0, "", "", None)]
    found = requests.group_requests(spark.createDataFrame(rows, "text string, top_k int, unit string, field string, kind string").coalesce(1)).collect()
    assert [(r["top_k"], [p.split(":")[0] for p in r["problems"]]) for r in found] == [(10, []), (1, ["text"]), (50, []), (51, ["text", "top_k", "unit", "field", "kind"]), (0, ["text", "top_k"])]


def test_item_requests_name_a_programme(spark):
    rows = [("q", None, "P", None), ("q", 3, None, 7), ("q", 3, "", None), ("q", 99, "P" * 51, 1)]
    checked = requests.item_requests(spark.createDataFrame(rows, "text string, top_k int, programme_code string, programme_id long"))
    good, bad = requests.answerable(checked)
    assert sorted(r["top_k"] for r in good.collect()) == [3, 12]
    assert sorted(tuple(p.split(":")[0] for p in r["problems"]) for r in bad.collect()) == [("programme",), ("top_k", "programme_code")]


def test_limit_counts_items_that_are_not_rejected(spark):
    found = spark.createDataFrame([(str(k), "deleted" if k % 2 else None) for k in range(20)], "identifier string, rejected string")
    assert [records.first_items(found, n).where("rejected IS NULL").count() for n in (0, 3, 99)] == [0, 3, 10]
    with pytest.raises(ValueError, match="limit"):
        records.first_items(found, -1)
