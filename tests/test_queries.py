"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from stratalens.plans.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    result = db.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want


def test_sequential_dedup(spark):
    from pyspark.sql import functions as F

    from stratalens.functions.text import content_hash
    from stratalens.plans.queries import documents

    rows = documents(spark, SF_DIR).select("id", "url", content_hash(F.col("clean_text")).alias("h")).orderBy("id").collect()
    urls, hashes, kept = set(), set(), []
    for r in rows:
        if r["url"] not in urls and r["h"] not in hashes:
            kept.append(r["id"])
            urls.add(r["url"])
            hashes.add(r["h"])
    assert sorted(r["seq"] for r in QUERIES["dedup_url_or_hash"](spark, SF_DIR).collect()) == kept


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    if SF_DIR.endswith("sf0.001"):
        assert entry.entry(spark).count() > 0
