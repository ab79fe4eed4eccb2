"""Every registered corpus query over whole small tables: against its SQL, or against brute force."""

import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import llm_brute as brute
import numpy as np
import pytest
from test_llm_operators import brute_op4
from test_llm_passages import brute_cut

from stratalens.llm import edit_counts, language_id, quality, registry, tokens

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang").collect()]


def run(spark, name):
    return registry.QUERIES[name](spark, SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    frame = run(spark, name)
    result = con.execute(registry.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted((tuple(r) for r in frame.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_shards(spark, rows):
    out = run(spark, "op1_hilbert_shards").collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(by_id) == len(out) == len(rows)
    for i, t, _ in rows:
        raw, r = t.encode(), by_id[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_quality(spark, rows):
    out = {r["doc_id"]: r for r in run(spark, "op3_preference_quality").collect()}
    assert set(out) == {i for i, _, _ in rows}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in out.items())
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    held = [(out[r["doc_id"]]["predicted"], r["quality"]) for r in labels if r["doc_id"] in out and out[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_pair_loss_is_at_its_least():
    """The fitted weights are where the gradient of the pairs' logistic loss, counted pair by pair, vanishes."""
    rng = np.random.default_rng(3)
    x = rng.random((60, len(quality.NAMES)))
    y = (x[:, 0] + 0.3 * rng.random(60) > 0.6).astype(int)
    model = quality.fit(x, y)
    z = (quality.expand(x) - model.centre) / model.scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    first = np.repeat(few, quality.PAIRS_EACH)
    second = many[np.random.default_rng(11).integers(0, len(many), len(first))]
    gradient = 1.0 * model.weights
    for a, b in zip(first, second, strict=True):
        better, worse = (z[b], z[a]) if few is bad else (z[a], z[b])
        d = better - worse
        gradient = gradient - d / (1 + np.exp(d @ model.weights))
    assert np.abs(gradient).max() < 0.05


def test_fingerprints(spark, rows):
    out = [tuple(r) for r in run(spark, "op4_simhash").collect()]
    assert sorted(out) == sorted(brute_op4(spark, [(i, t) for i, t, _ in rows]))


def test_fingerprint_neighbours(spark, rows):
    from test_llm_operators import brute_fingerprint

    out = run(spark, "fingerprint_neighbours").collect()
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    first = {}
    for i in sorted(fps):
        first.setdefault(fps[i], i)
    values = {f: int.from_bytes(f) for f in first}
    near = defaultdict(list)
    for a in first:
        for b in first:
            if a != b and bin(values[a] ^ values[b]).count("1") <= 3:
                near[a].append(first[b])
    assert {r["doc_id"]: (r["class_id"], r["near"]) for r in out} == {i: (first[f], sorted(near[f])) for i, f in fps.items()}


def test_edit_counts(spark, rows):
    encode = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("byte_bpe_50k.tiktoken"))
    count = lambda t: len(encode.whole.encode(t, add_special_tokens=False).ids)

    def edited(t):
        n = len(t)
        a = t[: n // 2] + t[n // 2 + 16 :]
        b = a[: n // 3] + t[:24] + a[n // 3 :]
        return b[: n + 24] + "\nReviewed." + b[n + 24 :]

    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["edited_chars"], r["edited_tokens"]) for r in run(spark, "op5_edit_counts").collect()}
    assert got == {i: (len(t), count(t), len(edited(t)), count(edited(t))) for i, t, _ in rows}
    assert edit_counts.LEAF


def test_language_posteriors(spark, rows):
    """Priors and posteriors counted page by page in plain Python."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("lang", "text")
    langs, model = language_id.fit(docs)
    n = len(langs)
    texts = {lang: {t for _, t, x in rows if x == lang} for lang in langs}
    for k, lang in enumerate(langs):
        counts = np.full(language_id.BINS, 0.5)
        for t in texts[lang]:
            raw = t.encode()
            bins, _ = language_id.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            np.add.at(counts, bins, 1)
        assert np.allclose(model[k], np.log(counts / counts.sum()))
    pages = language_id.evidence(spark.read.parquet(f"{SF_DIR}/pages.parquet")).collect()
    loglik, said = {}, {}
    for p in pages:
        raw = p["text"].encode()
        bins, _ = language_id.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        logs = model[:, bins].sum(axis=1) * min(len(bins), language_id.EFFECTIVE) / max(len(bins), 1)
        e = np.exp(logs - logs.max())
        loglik[p["page_id"]], said[p["page_id"]] = logs, e / e.sum()
    own = dict(loglik)
    for kind in ("declared", "suffix"):
        counts = defaultdict(lambda: np.zeros(n))
        for p in pages:
            if p[kind]:
                counts[p[kind]] += said[p["page_id"]]
        whole = sum(counts.values(), np.zeros(n))
        for p in pages:
            if p[kind]:
                x, q = said[p["page_id"]], counts[p[kind]].sum() / whole.sum()
                own[p["page_id"]] = own[p["page_id"]] + np.log((np.maximum(counts[p[kind]] - x, 0) + language_id.STRENGTH * q) / (np.maximum(whole - x, 0) + language_id.STRENGTH))
    soft = {}
    for i, logs in own.items():
        e = np.exp(logs - logs.max())
        soft[i] = e / e.sum()
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    keys = lambda p: (p["host"], (p["domain"], p["suffix"]), p["suffix"], None)
    for p in pages:
        for s, k in zip(sums, keys(p), strict=True):
            s[k] += soft[p["page_id"]]
    draw = lambda x, prior: (x + language_id.STRENGTH * prior) / (x.sum() + language_id.STRENGTH)
    got = {r["page_id"]: r for r in run(spark, "op6_language_evidence").collect()}
    assert set(got) == {p["page_id"] for p in pages}
    for p in pages:
        host, domain, suffix, _ = keys(p)
        top = (sums[3][None] + 1) / (sums[3][None] + 1).sum()
        prior = draw(sums[1][domain], draw(sums[2][suffix], top))
        logs = own[p["page_id"]] + np.log(draw(np.maximum(sums[0][host] - soft[p["page_id"]], 0), prior))
        e = np.exp(logs - logs.max())
        posterior = e / e.sum()
        r = got[p["page_id"]]
        assert r["lang"] == langs[int(posterior.argmax())] and r["confidence"] == pytest.approx(posterior.max(), abs=1e-6)


def test_repeats_brute(spark, rows):
    out = {r["doc_id"]: r for r in run(spark, "op7_suffix_repeats").collect()}
    strings = brute.cut_repeats([t for _, t, _ in rows])
    both = brute_cut([t for _, t, _ in rows], 51)
    for (i, t, _), (n, gone, spans, kept), (repeated, passages, _) in zip(rows, strings, both, strict=True):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passages"], r["n_repeated"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest(), passages, repeated)


def test_packing(spark, rows):
    encode = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("byte_bpe_50k.tiktoken"))
    out = run(spark, "op10_cutting_stock").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, _ in rows:
        ids = [*encode.whole.encode(t, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
    assert used >= 0.9 * 1024 * len(sequences)
