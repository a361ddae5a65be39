"""Rows of larger tables on which queries once differed from their SQL."""

import duckdb
import pytest

from paperloom.operators.catalogue_items import catalogue
from paperloom.sources.files import elements


def same_as_sql(spark, tmp_path, name, table, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    expected = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == expected
    return expected


@pytest.mark.parametrize(
    "body",
    [
        "<h1>the&amp;&amp;&amp</h1><p>one &am two & three</p>",
        "<h1>Head</h1><p>28.68.191.238 Den Rest.</p><p>Article 4</p><p>next &quot;one&quot; &amp;amp; two</p>",
    ],
)
def test_html_blocks(spark, tmp_path, body):
    page = f"<!DOCTYPE html><html><head><title>x &amp</title></head><body><article>{body}</article></body></html>"
    assert same_as_sql(spark, tmp_path, "html_blocks", "pages", [(1, page), (2, "<p>&middot; no head</p>".replace("&middot;", "."))], "page_id long, html string")


def test_elements_stay_lenient():
    assert elements("<p>a &amp b &amp;lt; c</p>") == [("text", "a & b < c")]
    assert elements("<p>a &amp b &amp;lt; c</p>", lenient=False) == [("text", "a &amp b &lt; c")]


def test_threshold_reparse(spark, tmp_path):
    """An amount that stands in a ratio only in its shortest form isn't grounded."""
    rows = [(1, 144051, 144050.59), (4, 12345, 2345.25), (0, 7, 1234.5), (2, 7, 1234.5)]
    assert same_as_sql(spark, tmp_path, "threshold_reparse", "orders", rows, "o_orderkey long, o_custkey long, o_totalprice double")
