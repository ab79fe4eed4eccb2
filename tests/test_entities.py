"""Character references against Python's own reader."""

import html
import os
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from stratalens.functions import text
from stratalens.sources import pages

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_names_and_numbers(spark):
    rnd = random.Random(2)
    texts = [f"a &{n} b" for n in html5] + [f"&{n}x;" for n in html5 if not n.endswith(";")]
    texts += [f"&#{n};&#x{n:x} &#X{n:X};" for n in [*range(0x120), 0x7F, 0x80, 0x99, 0x9F, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**7, 10**8, 10**12, 10**30]]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg;", "&amp;lt;", "&ampamp;", "&notit;", "&notin;", "&copy2024", "&nosuch;", "&#8217;&eacute;", "&#0038;lt;", "a&b=c&lt=d", "&a" * 40, "&" + "x" * 40 + ";", "😀&hearts;😀", "&lt;&#60;&LT&lt", "&#0000000000000000065;", "&#x000000000000041;", "&#12345678901234567890;"]
    parts = ["&", "#", "x", ";", "amp", "lt", "not", "in", "38", "3C", " ", "é", "\n", "copy"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["u"] for r in frame.select("t", text.unescape(F.col("t")).alias("u")).collect()}
    assert {t: u for t, u in got.items() if u != html.unescape(t)} == {}
    assert spark.createDataFrame([(None,)], "t string").select(text.unescape(F.col("t")).alias("u")).first()["u"] is None


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_page_titles(spark):
    rows = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("html", pages.title(F.col("html")).alias("title")).collect()
    for r in rows:
        found = re.search(r"(?is)<title[^>]*>(.*?)</title>", r["html"])
        assert r["title"] == (re.sub(r"\s+", " ", html.unescape(found[1])).strip() if found else "")
