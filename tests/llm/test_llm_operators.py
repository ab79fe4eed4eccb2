import hashlib
import io
import random
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import common, components, edit_counts, hilbert_shards, language_id, ngram_join, packing, phrase_index, quality, simhash, suffix_repeats, textnum, tokens, warc, zip_reader

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["tho", "ren", "ing", "sha", "é", "ble", "ont", "ere", "dal", "ku"]


def words(rnd, n):
    return [("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3)))).capitalize() if rnd.random() < 0.1 else "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n)]


def corpus(seed=3, n=60):
    """Texts of all sizes with copies, near copies, shared passages, nulls and repeated rows."""
    rnd = random.Random(seed)
    passage = " ".join(words(rnd, 120))
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.1:
            text = rnd.choice([None, "", "   \n", "one", "two Words", "É"])
        elif kind < 0.2 and out:
            text = rnd.choice(out)[1]
        elif kind < 0.45 and out:
            w = (rnd.choice(out)[1] or "x").split(" ")
            for _ in range(max(1, len(w) // rnd.choice([10, 40, 80]))):
                w[rnd.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind < 0.6:
            text = " ".join(words(rnd, rnd.randint(0, 40))) + " " + passage + "\n" + " ".join(words(rnd, rnd.randint(0, 40)))
        else:
            text = " ".join(words(rnd, rnd.randint(1, 300)))
        out.append((i * 3 % 97, text, rnd.choice(["en", "fr", None]), "hot" if rnd.random() < 0.4 else f"s{i % 5}", len(text or "")))
    out += [out[0], out[5]]  # rows that are fully repeated
    out += [(None, " ".join(words(rnd, 50)), None, None, None)]
    return out


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit(1) for c in ("rank", "shard", "score", "key", "seed", "chunk", "run", "digest", "length", "_n", "id", "root")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(tuple(r)[1:])
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_ranked_and_hot_groups(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).cast("int").alias("g"), "id", (F.col("id") % 3).alias("w"))
    for amount in (None, "w"):
        got = defaultdict(list)
        for r in common.ranked(df, "g", ["id"], amount, target=100).collect():
            got[r["g"]].append((r["rank"], r["w"] if amount else 1))
        for rows in got.values():
            rows.sort(key=lambda x: (x[0], x[1] > 0))
            at = 0
            for rank, weight in sorted(rows):
                assert rank <= at
                at = max(at, rank + weight)
            assert max(r + w for r, w in rows) == sum(w for _, w in rows)


def test_hilbert_curve_is_one_step_at_a_time(spark):
    for n, bits in ((2, 3), (3, 3)):
        df = spark.range(1 << (n * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"c{i}") for i in range(n)])
        rows = sorted(hilbert_shards.with_hilbert(df, [F.col(f"c{i}") for i in range(n)], bits).collect(), key=lambda r: r["hilbert"])
        assert [r["hilbert"] for r in rows] == list(range(len(rows)))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_hilbert_shards(docs, none, tmp_path):
    out = hilbert_shards.shard_documents(docs, 5)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    order = [r["hilbert"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert {(r["text_crc32"], r["bytes"]) for r in rows} == {(zlib.crc32((t[1] or "").encode()), len((t[1] or "").encode()) + 8) for t in ROWS}
    assert hilbert_shards.shard_documents(none, 5).count() == 0
    hilbert_shards.write_shards(out, str(tmp_path / "shards"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)
    made = hilbert_shards.manifest(out, ["dim2"])
    kept = {r["shard"] for r in hilbert_shards.prune(made, {"dim2": (10, 15)}).collect()}
    assert {r["shard"] for r in rows if r["dim2"] >= 10} <= kept
    made = hilbert_shards.manifest(out, ["dim0", "dim1", "dim2"])
    made = docs.sparkSession.createDataFrame(made.collect(), made.schema)
    for asked in ({"source": "hot"}, {"lang": "fr"}, {"chars": (100, 600)}, {"source": "s1", "lang": "en", "chars": (0, 50)}):
        kept = {r["shard"] for r in hilbert_shards.prune(made, hilbert_shards.cells_of(docs.sparkSession, **asked)).collect()}
        fits = lambda r, a=asked: all((r["chars"] or 0) >= v[0] and (r["chars"] or 0) <= v[1] if k == "chars" else r[k] == v for k, v in a.items())
        assert {r["shard"] for r in rows if fits(r)} <= kept


def test_ngram_join(docs, none):
    want = by_id(brute.near_components([(r[0], r[1]) for r in ROWS]))
    assert by_id(ngram_join.near_duplicates(docs).collect()) == want
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_on_a_large_group(spark):
    rnd = random.Random(9)
    base = words(rnd, 120)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 6, 9])):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id(got) == by_id(brute.near_components(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (200, 200), (9, 5)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3}


def test_quality_learns_and_defines_every_case(spark, docs, none):
    rnd = random.Random(1)
    rows = [(i, " ".join(words(rnd, 60)) if i % 3 else " ".join(w.upper() + "###" for w in words(rnd, 60))) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None), (10**6, 0)], "doc_id long, quality int")
    model = quality.train(texts, labels, 150)
    out = quality.score_documents(texts, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert held and sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.95
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.score_documents(none, model).count() == 0
    hashes = spark.range(100_000).select(F.shiftrightunsigned(F.xxhash64("id"), 4).alias("_h"))
    for most in (1, 5, 20, 1000, 100_000):
        taken = hashes.filter(F.col("_h") < quality.thin_below(hashes, most)).count()
        assert 0.1 * most <= taken <= most
    empty = quality.train(texts, labels.filter("false"))
    assert {r["predicted"] for r in quality.score_documents(texts, empty).collect()} == {1}


def brute_fingerprint(text):
    """Votes of a text's neighbouring words on 128 bits, one word pair at a time."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, row = textnum.words(data, np.array([0, len(data)]), textnum.SPACE)
    hashes = textnum.word_hashes(data, start, end)
    sizes = [min(int(e - s), simhash.MAX_WEIGHT // 2) for s, e in zip(start, end, strict=True)]
    if not len(start):
        return bytes(16)
    terms, _ = textnum.shingle_hashes(hashes, row, 2, 1)
    weights = [a + b for a, b in zip(sizes, sizes[1:], strict=False)] or [simhash.MAX_WEIGHT]
    votes = [0] * 128
    for t, w in zip(terms.tolist(), weights, strict=True):
        both = t.to_bytes(8, "little") + int(textnum.mix(np.array([t], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[0]).to_bytes(8, "little")
        for k in range(128):
            votes[k] += w if both[k // 8] >> (7 - k % 8) & 1 else -w
    return bytes(sum((votes[8 * i + j] > 0) << (7 - j) for j in range(8)) for i in range(16))


def brute_op4(spark, rows):
    """The contract's columns of op4 for (doc_id, text) rows."""
    frame = spark.createDataFrame([(t or "",) for _, t in rows], "t string").select(F.xxhash64("t"))
    keyed = [(i if i is not None else -(1 << 63), h[0], t or "", i) for (i, t), h in zip(rows, frame.collect(), strict=True)]
    order = sorted(keyed, key=lambda r: (-r[0], -r[1], r[2]))
    out = []
    for (_, _, t, i), (_, _, following, _) in zip(order, [*order[1:], *order[:1]], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        a, b, c = (brute_fingerprint(x) for x in (t, edited, following))
        like = lambda x, y: 1 - bin(int.from_bytes(x) ^ int.from_bytes(y)).count("1") / 128
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), like(a, b), like(a, c)))
    return out


@pytest.mark.parametrize("run_rows", [4, simhash.RUN_ROWS])
def test_simhash_query(spark, tmp_path, monkeypatch, run_rows):
    monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
    rows = [(r[0], r[1]) for r in ROWS] + [(None, None), (None, "a b"), (None, "c d e"), (55, "same id"), (55, "same id"), (55, "another"), (55, None)]
    for name, some in (("many", rows), ("one", rows[3:4]), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string").withColumn("run", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [tuple(r) for r in simhash.query(spark, f"{tmp_path}/{name}").collect()]
        assert sorted(got, key=repr) == sorted(brute_op4(spark, some), key=repr)


@pytest.mark.parametrize("hot", [simhash.HOT_BLOCK, 8, 2])
def test_simhash_near_pairs(spark, hot):
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 256, (30, 16), dtype=np.uint8)
    base[10:, :5] = base[0, :5]  # many share a block, some two
    base[20:, 5:9] = base[0, 5:9]
    fps = [b.tobytes() for b in base]
    for b in base[:15]:
        for flips in (1, 3, 4):
            bits = np.unpackbits(b)
            bits[rnd.choice(128, flips, replace=False)] ^= 1
            fps.append(np.packbits(bits).tobytes())
    want = {(a, b): n for a in set(fps) for b in set(fps) if a < b and (n := bin(int.from_bytes(a) ^ int.from_bytes(b)).count("1")) <= 3}
    frame = spark.createDataFrame([(bytearray(f),) for f in [*fps, *fps[:9]]] + [(None,)], "fingerprint binary").withColumn("key", F.lit(1))
    found = simhash.near_pairs(frame, 3, hot).collect()
    assert {(bytes(r["a"]), bytes(r["b"])): r["bits"] for r in found} == want and len(found) == len(want)
    assert simhash.near_pairs(frame.filter("false"), 3, hot).count() == 0


def test_token_ids_equal_the_library():
    encode = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("byte_bpe_50k.tiktoken"))
    rnd = random.Random(2)
    samples = [r[1] or "" for r in ROWS] + ["", " ", "a b", "x<|endoftext|>y", "漢字 and 🙂", "don't  stop\n\n now", "½ cup", "\x1c\x1d tab\t", "“quoted” – dash"]
    odd = ["a", " ", "  ", "я", "漢", "٣", "Ⅷ", "\u00a0", "\u3000", "\u0085", "\x1c", "🙂", "\u0301", "ß", "!", "'s", "<", "<|endoftext|>", "|>", "\n", "ﬁ", "١a", "\ufeff", "\u200d"]
    samples += ["".join(rnd.choice(odd) for _ in range(30)) for _ in range(300)]
    samples += ["".join(rnd.choice(["a", " ", "\n", "'s", "1", "é", "!", "\t"]) for _ in range(60)) for _ in range(100)]
    for text in samples:
        want = encode.whole.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(encode.ids(text), "<u4")) == want, text


def test_edit_counts(spark, docs, none):
    encode = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("byte_bpe_50k.tiktoken"))
    rnd = random.Random(5)
    plain = ["a", "b", " ", "  ", "\n", "'s", "'", "12", "!", "é", "the ", "\n\n", " x"]
    odd = [*plain, "я", "漢字", "🙂", "\u00a0", "<|endoftext|>", "<|", "endoftext", "|>", "<", "\u0301", " \u3000"]
    for t in range(800):
        parts = plain if t < 300 else odd
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(300 if t % 5 == 0 else 30)))
        tree = edit_counts.CountTree(encode, text)
        for _ in range(4):
            at, gone = rnd.randrange(len(text) + 1), rnd.randrange(200 if rnd.random() < 0.2 else 6)
            new = "".join(rnd.choice(parts) for _ in range(rnd.randrange(6)))
            text = text[:at] + new + text[at + gone :]
            tree.replace(at, gone, new)
            assert "".join(w for w, _ in tree.words()) == text
            assert tree.total == len(encode.whole.encode(text, add_special_tokens=False).ids)
    long = " ".join(words(rnd, 5000))
    tree = edit_counts.CountTree(encode, long)
    tree.replace(9000, 3, "zz")
    assert tree.encoded < 100
    # an edit of a stored tree encodes nothing of the old text
    stored = edit_counts.build_trees(spark.createDataFrame([(1, long, "x"), (2, None, "y"), (3, "<|endoftext", "z")], "doc_id long, text string, lang string"))
    steps = F.expr("array(struct(9000L AS start, 3L AS removed, if(doc_id = 3, '|>', 'zz') AS inserted))")
    kept = {r["doc_id"]: r for r in edit_counts.apply_edits(stored.withColumn("edits", steps), keep=True).collect()}
    assert kept[1]["encoded_chars"] < 100 and kept[2]["text"] == "zz" and kept[3]["edited_tokens"] == 1
    again = spark.createDataFrame([kept[1]]).select("doc_id", "text", F.col("lengths").cast("array<int>"), F.col("counts").cast("array<int>"), F.lit(None).cast("array<struct<start:long,removed:long,inserted:string>>").alias("edits"))
    r = edit_counts.apply_edits(again).first()
    assert r["n_tokens"] == r["edited_tokens"] == len(encode.ids(kept[1]["text"])) // 4 and r["encoded_chars"] == 0
    got = edit_counts.count_edits(edit_counts.with_edits(docs)).collect()
    count = lambda t: len(encode.ids(t)) // 4
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], count(r[1] or "")) for r in ROWS)

    def edited(t):
        n = len(t)
        a = t[: n // 2] + t[n // 2 + 16 :]
        b = a[: n // 3] + t[:24] + a[n // 3 :]
        return b[: n + 24] + "\nReviewed." + b[n + 24 :]

    assert Counter((r["doc_id"], r["edited_tokens"]) for r in got) == Counter((r[0], count(edited(r[1] or ""))) for r in ROWS)
    assert edit_counts.count_edits(edit_counts.with_edits(none)).count() == 0


def test_language_evidence(spark):
    rnd = random.Random(6)
    vocab = {"en": ["the", "and", "with", "shall"], "de": ["und", "der", "nicht", "schön"], "fr": ["les", "que", "avec", "été"]}
    say = lambda x, n: " ".join(rnd.choice(vocab[x]) for _ in range(n))
    texts = spark.createDataFrame([(x, say(x, 40)) for x in vocab for _ in range(30)] + [(None, "zz"), ("en", None)], "lang string, text string")
    langs, model = language_id.fit(texts)
    assert langs == ["de", "en", "fr"]
    page = lambda x, declared, n: f'<html lang="{declared}"><script>{say("en", 50)}</script><nav>{say("en", 30)}</nav><p>{say(x, n)}</p></html>'
    rows = [(i, f"https://a{i % 4}.example.de/x", page("de", "de", 30)) for i in range(20)]
    rows += [(100 + i, "http://b.example.com/", page("fr", "en", 40)) for i in range(10)]
    rows += [(200, "https://a1.example.de/short", "<p></p>"), (201, None, None), (202, "", ""), (None, "nonsense", page("en", "en", 30)), (203, "http://b.example.com/", page("fr", "fr", 40) * 300), (203, "http://b.example.com/", page("fr", "fr", 40))]
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)), langs, model).collect()
    lang = defaultdict(list)
    for r in got:
        lang[r["page_id"]].append(r["lang"])
        assert 0 < r["confidence"] <= 1
    assert len(got) == len(rows)
    assert all(lang[i] == ["de"] for i in range(20)) and all(lang[100 + i] == ["fr"] for i in range(10))
    assert lang[200] == ["de"] and lang[None] == ["en"] and lang[203] == ["fr", "fr"]
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.identify(nothing, langs, model).count() == 0
    assert language_id.fit(texts.filter("false"))[0] == ["und"]
    many = spark.range(80).select(F.concat(F.lit("l"), "id").alias("lang"), F.repeat(F.concat(F.lit("word"), "id"), 9).alias("text"))
    hot = spark.createDataFrame([("l0", "a hot text")], "lang string, text string").crossJoin(spark.range(5000)).drop("id")
    langs, once = language_id.fit(many, 2)
    assert len(langs) == 80
    found = language_id.identify(many.select(F.substring("lang", 2, 9).cast("long").alias("page_id"), F.lit("http://h.example/").alias("url"), F.concat(F.lit('<html lang="xx">'), "text").alias("html")), langs, once).collect()
    assert sum(r["lang"] == f"l{r['page_id']}" for r in found) > 70  # as many languages as pages
    assert np.allclose(language_id.fit(many.unionByName(hot), 10**6)[1][0], language_id.fit(many.unionByName(hot.limit(1)), 10**6)[1][0])


@pytest.mark.parametrize("hot", [suffix_repeats.HOT, 2])
def test_suffix_repeats(docs, none, hot):
    want = {hashlib.md5((r[1] or "").encode()).digest(): cut for r, cut in zip(ROWS, brute.cut_repeats([r[1] for r in ROWS]), strict=True)}
    got = {bytes(r["digest"]): (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_repeats.remove_repeats(docs, hot).collect()}
    assert got == want
    assert suffix_repeats.remove_repeats(none, hot).count() == 0


def test_suffix_repeats_within_one_text(spark):
    rnd = random.Random(8)
    part = "".join(rnd.choice("abcdé ") for _ in range(450))
    rows = [(1, part + "x" * 3 + part), (2, "ab" * 600), (3, "z" * 399), (4, "y" * 401), (5, part[:399]), (6, "q" + part[10:420])]
    want = brute.cut_repeats([t for _, t in rows])
    got = {bytes(r["digest"]): (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {hashlib.md5(t.encode()).digest(): w for (_, t), w in zip(rows, want, strict=True)}


def test_maximal_repeats_of_a_suffix_group():
    right = [b"aaaab", b"aaaac", b"aaaad", b"aabcd"]
    left = [b"xy", b"xy", b"xz", b"xy"]
    r, rs = suffix_repeats.matrix(suffix_repeats.pa.array(right), 5)
    f, fs = suffix_repeats.matrix(suffix_repeats.pa.array(left), 2)
    got = {(back, ahead, tuple(sorted(m.tolist()))) for back, ahead, m in suffix_repeats.repeats(r, rs, f, fs, 4)}
    assert got == {(2, 4, (0, 1)), (1, 4, (0, 1, 2)), (2, 2, (0, 1, 3))}


@pytest.mark.parametrize("block", [phrase_index.BLOCK_WORDS, 20])
def test_phrase_index(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", block)
    rnd = random.Random(12)
    items = [(1, " ".join((ROWS[7][1] or "x y").split()[:40])), (2, "one"), (3, "TWO words"), (4, None), (5, " , "), (6, " ".join(words(rnd, 30))), (7, " ".join((ROWS[20][1] or "").split()[-16:])), (None, "two words"), (1, "ont ere")]
    found = brute.windows([(i, t) for i, t in items if i is not None])
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    want = by_id([(r[0], *brute.contamination(r[1], found)) for r in ROWS])
    index = phrase_index.build_index(docs)
    assert phrase_index.find_phrases(index, frame, block_words=block).count() > 0
    assert by_id(phrase_index.contamination(docs, frame).collect()) == want
    assert phrase_index.contamination(none, frame).count() == 0
    assert {r["n_hit"] for r in phrase_index.contamination(docs, frame.filter("false")).collect()} == {0}


def test_proximity(spark):
    rows = [(1, "alpha x x beta x gamma"), (2, "alpha x x x x x x beta gamma"), (3, "beta alpha gamma"), (4, "alpha"), (5, "beta gamma. Alpha beta! gamma")]
    index = phrase_index.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"] for r in phrase_index.find_near(index, ["alpha", "beta", "gamma"], 3).collect()}
    assert got == {3, 5}
    assert phrase_index.find_near(index, ["missing", "alpha"], 3).count() == 0


def test_zip_reader(tmp_path):
    for wide in (False, True):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as z:
            for name in ("a.txt", "dir/é.bin", "empty"):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                    f.write(name.encode() * (0 if name == "empty" else 500))
            z.comment = b"PK\x05\x06 is no directory end"
        raw = made.getvalue()
        if wide:  # the same archive with a ZIP64 end and entry fields that overflow
            raw = _as_zip64(raw)
        read = lambda at, n: raw[at : at + n]  # noqa: B023, E731
        found = {m.name: m for m in zip_reader.members(read, len(raw))}
        assert set(found) == {"a.txt", "dir/é.bin", "empty"}
        for name, m in found.items():
            at = zip_reader.data_place(read, m)
            assert raw[at : at + m.size] == name.encode() * (0 if name == "empty" else 500)
    with pytest.raises(ValueError):
        zip_reader.members(lambda at, n: b"nothing"[at : at + n], 7)


def _as_zip64(raw):
    at = raw.rindex(b"PK\x05\x06", 0, raw.rindex(b"PK\x05\x06"))
    n, size, offset = struct.unpack_from("<HII", raw, at + 10)
    entries, out, k = raw[offset : offset + size], b"", 0
    for _ in range(n):
        head = bytearray(entries[k : k + 46])
        packed, whole, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", head, 20)
        (where,) = struct.unpack_from("<I", head, 42)
        extra = struct.pack("<HHQQQ", 1, 24, whole, packed, where)
        struct.pack_into("<II", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<H", head, 30, len(extra))
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        out += bytes(head) + entries[k + 46 : k + 46 + name_n] + extra
        k += 46 + name_n + extra_n + comment_n
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(out), offset)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, offset + len(out), 1)
    last = bytearray(raw[at:])
    struct.pack_into("<HHII", last, 8, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
    return raw[:offset] + out + end + locator + bytes(last)


def test_warc_round_trip(spark, tmp_path):
    big, odd = "<p>" + "x" * 1200, "<p>\r\n\r\nWARC/1.1 é" + "y" * 5000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://a/\r\nX: y", odd), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "u", big), (9, "u", big), (None, "u", big), (8, "u", odd), (10, "u", "z" * 1000), (11, "u", "z" * 1000), (12, "u", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    manifest = warc.write_packages(warc.plan_records(pages), f"file://{tmp_path}/warc", 2000)
    assert manifest.count() > 1
    got = by_id(warc.read_packages(manifest).collect())
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = largest.get(h) if len(raw) >= 1000 and largest.get(h) != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == by_id(want)
    assert warc.read_packages(warc.write_packages(warc.plan_records(pages.filter("false")), f"file://{tmp_path}/none")).count() == 0


def test_packing(docs, none):
    encode = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("byte_bpe_50k.tiktoken"))
    rows = packing.pack_documents(docs).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    want = Counter()
    for i, t, *_ in ROWS:
        ids = np.append(np.array(encode.whole.encode(t or "", add_special_tokens=False).ids, "<u4"), np.array([0], "<u4"))
        for k in range(0, len(ids), 1024):
            part = ids[k : k + 1024]
            want[i, k, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def test_cutting_stock_is_near_its_bound():
    rnd = np.random.default_rng(0)
    counts = np.bincount(rnd.integers(1, 100, 20_000), minlength=100)
    counts[37] += 9000
    histogram = {i: int(c) for i, c in enumerate(counts) if c} | {128: 5}
    made = packing.plan(histogram, 128)
    used = Counter()
    for length, first, n, *_ in made.runs:
        used[length] += n
    assert used == histogram
    whole = sum(k * v for k, v in histogram.items())
    assert made.sequences >= whole / 128
    value, pattern = packing.price(np.array([3, 5, 7]), np.array([3.0, 5.5, 7.1]), 13)
    assert value == pytest.approx(3 + 5.5 * 2) and pattern == {0: 1, 1: 2}
    patterns, x = packing.cutting_stock(np.array([3, 5, 7]), np.array([30, 50, 20]), 15, gap=1e-9)
    cover = np.zeros(3)
    for p, t in zip(patterns, x, strict=True):
        for i, c in p.items():
            cover[i] += c * t
    assert (cover >= np.array([30, 50, 20]) - 1e-6).all() and x.sum() == pytest.approx(480 / 15, abs=0.7)
