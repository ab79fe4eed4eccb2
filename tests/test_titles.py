"""Titles whose character references are cut off, and paragraphs between wide spaces, against the SQL of the query."""

import unicodedata

import duckdb

from stratalens.plans.registry import ORACLES, QUERIES

TITLES = ["a&amp;&amp", "a&amp;&quot", "a &am", "&", "&amp;lt;", "&amp;amp;", "&lt;b&gt;&quot;&#39;&#x27;&nbsp;&amp;", "&LT;&AMP;&#38;&#X27;&eacute;&copy", "&lt&gt&#39&nbsp", ""]


def compared(spark, tmp_path, pages):
    rows = [(i, f"https://host.example/{i}", html) for i, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    result = db.execute(ORACLES["page_title_paragraphs"])
    names = [x[0] for x in result.description]
    want = sorted(result.fetchall())
    got = sorted(tuple(r) for r in QUERIES["page_title_paragraphs"](spark, str(tmp_path)).select(names).collect())
    assert got == want
    return [dict(zip(names, r, strict=True)) for r in got]


def test_cut_references(spark, tmp_path):
    got = compared(spark, tmp_path, [f"<html><title>{t}</title><p>{t}</p></html>" for t in TITLES])
    assert got[0]["title"] == "a&&amp"


def test_wide_spaces_around_paragraphs(spark, tmp_path):
    spaces = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs"]
    got = compared(spark, tmp_path, [f"<p>{c}<p>{c} a{c}b\n{c}</p>" for c in spaces])
    assert len(got) == 17 and {r["n_paragraphs"] for r in got} == {1}
