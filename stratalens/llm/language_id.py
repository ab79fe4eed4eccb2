"""Language of web pages from fused evidence.

Each page has the likelihood of its text under byte-trigram models, a declared
markup language and an address suffix; its host gives a prior.  How likely a
declaration or a suffix is under each language is counted over all pages, by what their
texts say, without the page itself.  Host priors are smoothed towards their domain's, those
towards their suffix's and those towards the whole corpus's.  All counts are grouped
aggregations of (label, language, share) rows.  Everything is combined as a sum of
logarithms and normalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textnum

#: Labelled texts a model is fitted on, at most, for each language.
MAX_TEXTS = 2000
BINS = 1 << 14
#: A text's log-likelihood counts as that of so many trigrams at most: neighbouring trigrams are not independent.
EFFECTIVE = 40.0
#: Pseudo-counts with which a level's shares are drawn to the level above.
STRENGTH = 10.0


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of every byte trigram, letters in lower case, none across texts."""
    low = textnum._lower[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = row[:-2] == row[2:]
    return bins[same], row[:-2][same]


def fit(texts: DataFrame, max_texts: int = MAX_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of trigram bins, from (lang, text) rows.

    Every label counts.  The distinct texts of a language are thinned by their hash
    so that ``max_texts`` or a few more are left, each once however often it occurs.
    Bins are counted by grouped aggregation as (language, bin, n) rows; labels times bins
    numbers come to the driver.  Without any label there is one language, ``und``.
    """
    texts = texts.filter("lang is not null").withColumn("_h", F.xxhash64("text"))
    sizes = texts.groupBy("lang").agg(F.count_distinct("_h").alias("count")).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return ["und"], np.full((1, BINS), -np.log(BINS))
    number = {x: i for i, x in enumerate(langs)}
    share = texts.sparkSession.createDataFrame([(r["lang"], max_texts / r["count"]) for r in sizes], "lang string, share double")
    thinned = texts.join(F.broadcast(share), "lang").filter(F.pmod("_h", F.lit(1 << 20)) < F.col("share") * (1 << 20))  # a row for each language
    thinned = thinned.groupBy("lang", "_h").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((len(langs), BINS), np.int64)
        for rows, data, offsets in textnum.blocks(batches):
            bins, row = trigrams(data, offsets)
            lang = np.array([number[x] for x in rows.column("lang").to_pylist()])
            tally += np.bincount(lang[row] * BINS + bins, minlength=tally.size).reshape(tally.shape) if len(bins) else 0
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tally.ravel()[at])], ["at", "n"])

    counts = np.full(len(langs) * BINS, 0.5)
    got = thinned.select("lang", "text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("at").to_numpy()] += got.column("n").to_numpy()
    counts = counts.reshape(len(langs), BINS)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_likelihoods(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """Add ``loglik``: for each language, the text's mean log-likelihood times its effective length."""
    schema = pages.drop("text").schema.add("loglik", T.ArrayType(T.DoubleType()))
    names = [f.name for f in schema][:-1]
    sent = pages.sparkSession.sparkContext.broadcast(model)  # languages times bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in textnum.blocks(batches):
            bins, row = trigrams(data, offsets)
            n = np.bincount(row, minlength=rows.num_rows)
            weight = np.minimum(n, EFFECTIVE) / np.maximum(n, 1)
            total = np.stack([np.bincount(row, weights=m[bins], minlength=rows.num_rows) * weight for m in sent.value], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, total.shape[1]), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), lists], [*names, "loglik"])

    return pages.mapInArrow(run, schema)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, headers, footers, asides, comments and tags."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, domain, suffix) of pages; missing parts are empty."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(
        "page_id",
        visible_text(html).alias("text"),
        F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1)).alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
    )


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _normalise(logs: Column) -> Column:
    return F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))


def _shares(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def _constant(values: np.ndarray) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(" ".join(map(repr, map(float, values)))), " ").cast("array<double>")


def _sums(rows: DataFrame, keys: list[str], column: str = "soft") -> DataFrame:
    """(keys, s): arrays summed place by place, as rows of (keys, place, number)."""
    each = rows.select(*keys, F.posexplode(column).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda r: r["_x"])
    return each.groupBy(*keys).agg(held.alias("s"))


def _whole(sums: DataFrame, n: int) -> np.ndarray:
    """The sum of all arrays: one number for each language."""
    first = _sums(sums, [], "s").first()
    return np.zeros(n) if first is None or not first["s"] else np.array(first["s"])


def with_naming(rows: DataFrame, label: str, out: str, n: int) -> DataFrame:
    """Add ``out``: the log-probability of each row's ``label`` under each language, by what other rows' texts say.

    Counts are drawn to the label's share of the corpus, so that a rare label says little; an
    absent one says nothing.
    """
    counts = common.materialise(_sums(rows.filter(F.col(label) != ""), [label], "said"), "label-counts")
    whole = _whole(counts, n)
    total = float(whole.sum()) or 1.0
    sums = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    table = counts.select(F.col(label), F.col("s").alias("_s"), (sums / total).alias("_q"))
    own = F.zip_with("_s", "said", lambda c, x: F.greatest(c - x, F.lit(0.0)) + STRENGTH * F.col("_q"))
    left = F.zip_with(_constant(whole), "said", lambda c, x: F.greatest(c - x, F.lit(0.0)) + STRENGTH)
    # the table has a row for each label: it is broadcast where Spark finds it small
    joined = rows.join(table, label, "left")
    told = F.zip_with(own, left, lambda a, b: F.log(a / b))
    return joined.withColumn(out, F.coalesce(told, F.transform("said", lambda _: F.lit(0.0)))).drop("_s", "_q")


def host_priors(rows: DataFrame, n: int) -> DataFrame:
    """(host, own, prior): summed soft counts of each host, and what they are drawn to.

    ``rows`` have host, domain, suffix and ``soft`` (an array of ``n`` shares).
    Counts are combined before every shuffle, and each level is summed from the
    level below, so no group of pages is gathered.
    """

    def drawn(own: str, above: str) -> Column:
        total = F.aggregate(F.col(own), F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))

    hosts = common.materialise(_sums(rows, ["host", "domain", "suffix"]), "host-counts")
    domains = common.materialise(_sums(hosts, ["domain", "suffix"], "s"), "domain-counts")
    suffixes = _sums(domains, ["suffix"], "s")
    whole = _whole(domains, n) + 1.0
    suffixes = suffixes.withColumn("top", _constant(whole / whole.sum()))
    suffixes = suffixes.select("suffix", drawn("s", "top").alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", drawn("s", "p_suffix").alias("p_domain"))
    return hosts.join(domains, ["domain", "suffix"]).select("host", F.col("s").alias("own"), F.col("p_domain").alias("prior"))


def identify(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, confidence) of every page.

    A page's own share is taken out of its host's counts before they become its
    prior.  Without text, declaration or host the language is the corpus's most
    frequent; ties go to the first language in alphabetical order.  A hot host is
    a skewed key of one join with a small row on the other side, which adaptive
    execution splits.  Null urls and html count as empty; every row has a result of its
    own, equal rows equal ones; an empty table gives none.  A very long page is a block
    of its own; columns other than page_id, url and html aren't read.
    """
    n = len(langs)
    rows = text_likelihoods(evidence(pages), model)
    rows = common.materialise(rows.withColumn("said", _shares(_normalise(F.col("loglik")))), "page-texts")
    rows = with_naming(with_naming(rows, "declared", "by_declared", n), "suffix", "by_suffix", n)
    rows = rows.withColumn("evidence", _add(F.col("loglik"), _add(F.col("by_declared"), F.col("by_suffix")))).drop("by_declared", "by_suffix", "said")
    rows = rows.withColumn("soft", _shares(_normalise(F.col("evidence"))))
    rows = common.materialise(rows, "page-evidence")
    priors = host_priors(rows, n)
    joined = rows.join(priors.hint("merge"), "host")
    others = F.zip_with("own", "soft", lambda o, s: F.greatest(o - s, F.lit(0.0)))
    joined = joined.withColumn("others", others)
    total = F.aggregate("others", F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("mine", F.zip_with("others", "prior", lambda o, p: (o + STRENGTH * p) / (total + STRENGTH)))
    logs = _add(F.col("evidence"), F.transform("mine", lambda p: F.log(p)))
    joined = joined.withColumn("posterior", _shares(_normalise(logs)))
    names = F.split(F.lit("\x01".join(langs)), "\x01")
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return joined.select("page_id", "host", "declared", best(F.col("loglik")).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; text models come from the labelled documents."""
    langs, model = fit(common.table(spark, sf_dir, "documents").select("lang", "text"))
    return identify(common.table(spark, sf_dir, "pages"), langs, model)
