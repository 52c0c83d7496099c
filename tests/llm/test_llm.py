"""The training-data operators against brute force, and on awkward tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlight.llm import common, fingerprints, jaccard, langid, media, mixing, packing, quality, registry, substrings, toxicity, wavelet
from barlight.llm.tokens import Encoder, default_tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = "the of and river stone bright walk under seven light house green paper cloud quiet music winter summer road field".split()


def prose(seed, n, words=WORDS):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        out.append(str(rng.choice(words)) + (". " if i % 7 == 6 else " "))
    return "".join(out).strip()


def awkward(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, odd signs, and clashing columns."""
    same = prose(1, 60)
    rows = [
        (1, same, "en", "src0", 5),
        (1, same, "en", "src0", 5),
        (1, prose(2, 40), None, "src10", None),
        (2, None, "en", None, None),
        (None, same, "de", "src1", 3),
        (None, None, None, None, None),
        (3, "", "fr", "src2", 0),
        (4, "   \n\t ", "fr", "src2", 0),
        (5, "### $$$ 123 <|endoftext|> a", "en", "src2", 9),
        (6, prose(3, 30_000), "en", "src0", 1),
        (7, "É" * 3 + " straße İx ́ \U0001f600 don't", "de", "src3", 1),
        (8, same + " " + prose(4, 5), "en", "src4", 1),
        (-9, "one", "es", "src5", 1),
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    extra = ["tag", "key", "ids", "score", "features", "prediction", "raw", "removed", "tokens", "bucket", "epoch", "domain", "x"]
    extra += ["__id", "__tag", "__t", "__taken", "__hash", "__x", "__p", "__raw", "held", "null", "level0", "of", "whole", "gone", "_id"]
    return frame.selectExpr("*", *[f"'z' as {c}" for c in extra])


def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def label_rows(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 1), (5, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


def test_encoder_equals_tokenizer(encoder):
    texts = ["a<|endoftext|>b c", "", "  x\ty\r\nİST é \x1c z", "don't we'll 123 ###!!", "ÀÉ×÷ªº²¼", "é Σας", "a\x85b\xa0c", prose(1, 50)]
    assert encoder(texts) == [encoder.plain(t) + encoder.end for t in texts]


def check_pieces(pieces, texts, encoder):
    """Every id of every text lies in one piece; sequences are gapless, short and little padded."""
    ids = [encoder([t])[0] for t in texts]
    sequences = collections.defaultdict(list)
    held = collections.Counter()
    for p in pieces:
        held[p.doc_tokens] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    for n, total in held.items():
        assert total == n * sum(len(i) // 4 == n for i in ids)
    assert sum(held.values()) == sum(len(i) // 4 for i in ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_op1(spark, encoder):
    docs = awkward(spark)
    pieces = packing.pack_documents(docs, block_tokens=5_000).collect()
    texts = [r.text for r in docs.collect()]
    assert check_pieces(pieces, texts, encoder) <= 2048 * 4
    whole = {t: encoder([t])[0] for t in texts}
    assert all(any(bytes(p.ids) == i[4 * p.start : 4 * (p.start + p.length)] for i in whole.values()) for p in pieces)
    assert packing.pack_documents(nothing(spark)).count() == 0


def test_op1_query(spark, encoder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = packing.op1_packing(spark, SF).collect()
    assert check_pieces(pieces, list(docs.values()), encoder) <= 4096
    for p in pieces:
        part = encoder([docs[p.doc_id]])[0][4 * p.start : 4 * (p.start + p.length)]
        assert zlib.crc32(part) == p.ids_crc32


def test_pack_fills_windows_and_balances_steps():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 5000, 400).tolist()
    windows, rest = packing.pack(lengths, last=False)
    assert all(sum(p[2] for p in w) == tier for tier, w in windows)
    assert sum(sum(p[2] for p in w) for _, w in windows) + sum(r[2] for r in rest) == sum(lengths)
    groups = packing.balanced([t for t, _ in windows], 1 << 16)
    totals = np.bincount(groups, [t for t, _ in windows])
    assert totals.max() - totals.min() <= 2048


def test_wavelet_rank_select():
    ids = np.random.default_rng(0).integers(0, 500, 9_000) * 90
    docs, lengths, m = wavelet.from_bytes(wavelet.to_bytes([3, None], [4000, 5000], wavelet.WaveletMatrix.build(ids, 16)))
    assert docs == [3, None] and lengths == [4000, 5000] and (m.decode() == ids).all()
    assert (m.access(np.arange(9_000)) == ids).all()
    for symbol in (int(ids[0]), int(ids[77]), 1):
        at = np.flatnonzero(ids == symbol)
        assert m.count(symbol) == len(at) and [m.select(symbol, k) for k in range(len(at))] == at.tolist()
        assert m.count(symbol, 100, 8000) == ((at >= 100) & (at < 8000)).sum()
    with pytest.raises(IndexError):
        m.select(1, 0)
    assert wavelet.WaveletMatrix.build(np.zeros(0, int), 16).count(5) == 0


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, wavelet.CHUNK, wavelet.CHUNK + 1, 400_003])
def test_stored_wavelet_by_brute_force(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(int)
    docs, lengths, m = wavelet.from_bytes(wavelet.to_bytes([3, None], [n // 2, n - n // 2], wavelet.WaveletMatrix.build(ids, 16)))
    assert docs == [3, None] and lengths == [n // 2, n - n // 2] and (m.decode() == ids).all()
    some = rng.integers(0, n, 200) if n else np.zeros(0, int)
    assert (m.access(some) == ids[some]).all()
    for symbol in {*ids[:1].tolist(), *ids[-1:].tolist(), 0, 1, 2, 48_999, 70_000}:
        at = np.flatnonzero(ids == symbol)
        begin, end = sorted(rng.integers(0, n + 1, 2).tolist())
        inside = at[(at >= begin) & (at < end)]
        assert m.count(symbol) == len(at) and m.count(symbol, begin, end) == len(inside)
        assert (m.occurrences(symbol) == at).all() and (m.occurrences(symbol, begin, end) == inside).all()
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert m.select(symbol, k) == at[k]


def test_stored_wavelet_inflates_what_is_asked_for():
    n = 40 * wavelet.CHUNK
    ids = np.random.default_rng(1).integers(0, 1 << 16, n)
    blob = wavelet.to_bytes([1], [n], wavelet.WaveletMatrix.build(ids, 16))
    chunk = wavelet.CHUNK // 8 + 2 * (wavelet.CHUNK // wavelet.BLOCK + 1)

    def inflated(ask):
        m = wavelet.opened(blob)[1]
        ask(m)
        return max(p.inflated for p in m.planes) / chunk, sum(p.inflated for p in m.planes)

    assert inflated(lambda m: None) == (0, 0)
    assert inflated(lambda m: m.access(np.array([n // 2])))[0] <= 1
    assert inflated(lambda m: m.count(int(ids[5])))[0] <= 2
    assert inflated(lambda m: m.select(int(ids[5]), 0))[0] <= 3  # two of the range, one on the way up
    assert inflated(lambda m: m.count(int(ids[5]), 1000, n - 1000))[1] < len(blob) / 10


def test_op2_ids_are_counted_and_found_in_stored_shards(spark, encoder, tmp_path):
    docs = awkward(spark)
    wavelet.write_shards(docs, str(tmp_path / "a"), shard_tokens=500, partitions=3)
    all_ids = [(r.doc_id, np.frombuffer(encoder([r.text])[0], "<u4").tolist()) for r in docs.collect()]
    wanted = sorted({1, all_ids[0][1][0], *max((i for _, i in all_ids), key=len)[:40:7], 48_998})
    found = collections.Counter((i, d, p) for d, ids in all_ids for p, i in enumerate(ids) if i in wanted)
    assert collections.Counter(tuple(r) for r in wavelet.find_ids(spark, str(tmp_path / "a"), wanted).collect()) == found
    counts = {i: sum(v for k, v in found.items() if k[0] == i) for i in wanted}
    assert {r.id: r.n for r in wavelet.count_ids(spark, str(tmp_path / "a"), wanted + wanted).collect()} == counts
    wavelet.write_shards(nothing(spark), str(tmp_path / "b"))
    assert wavelet.find_ids(spark, str(tmp_path / "b"), [1]).count() == 0
    assert [tuple(r) for r in wavelet.count_ids(spark, str(tmp_path / "b"), [1]).collect()] == [(1, 0)]


def test_op2(spark, encoder, tmp_path):
    docs = awkward(spark)
    wavelet.write_shards(docs, str(tmp_path / "a"), shard_tokens=500, partitions=3)
    got = sorted(wavelet.read_shards(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    at = 0
    for g, r in zip(got, docs.orderBy(*order).collect(), strict=True):
        want = encoder([r.text])[0]
        assert (g.doc_id, g.start, g.n_tokens, bytes(g.ids)) == (r.doc_id, at, len(want) // 4, want)
        at += g.n_tokens
    wavelet.write_shards(nothing(spark), str(tmp_path / "b"))
    assert wavelet.read_shards(spark, str(tmp_path / "b")).count() == 0


def test_op2_much_repeated_id_is_dealt_to_several_ranges(spark, tmp_path):
    rows = [(7, f"text {i % 40}") for i in range(400)] + [(None, "same")] * 200 + [(9, "z")]
    wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path / "a"), partitions=6)
    got = wavelet.read_shards(spark, str(tmp_path / "a")).collect()
    parts = spark.read.parquet(str(tmp_path / "a")).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(parts) == 6 and max(p.n for p in parts) < sum(p.n for p in parts) / 3
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 200 + [7] * 400 + [9]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_op2_query(spark, encoder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in wavelet.op2_wavelet_shards(spark, SF).collect()}
    at = 0
    for d, text in docs:
        ids = encoder([text])[0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert len(got) == len(docs)


def test_op3(spark):
    got = langid.op3_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth)
    assert len(both) == len(truth) and (both[both.held_out].lang == both[both.held_out].lang_pred).mean() > 0.98
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    model = langid.learn(awkward(spark).filter("text is not null and lang is not null").select("text", "lang"))
    rows = langid.identify(awkward(spark), model).collect()
    assert len(rows) == 13 and sum(r.lang_pred == "und" for r in rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    empty = langid.learn(nothing(spark).select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(awkward(spark), empty).collect()} == {"und"}
    assert langid.identify(nothing(spark), model).count() == 0


def plain_language(rows, texts, words, grams):
    """Backoff scores by a second, plain implementation: dictionaries of counts, no arrays."""
    langs = sorted({lang for _, lang in rows})
    seen = {lang: collections.Counter() for lang in langs}
    for text, lang in rows:
        seen[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    total = {lang: max(sum(seen[lang].values()), 1) for lang in langs}
    pieces = {lang: collections.Counter() for lang in langs}
    for lang in langs:
        for w, n in seen[lang].items():
            p = f"<{w}>"
            for size in (5, 4, 3, 2, 1):
                for i in range(len(p) - size + 1):
                    pieces[lang][p[i : i + size]] += n

    def kept(counts, most):
        tops = {x: sorted(((n, w) for w, n in c.items() if n >= 2), key=lambda t: (-t[0], t[1]))[:most] for x, c in counts.items()}
        known = {w for top in tops.values() for _, w in top}
        held = {x: dict((w, n) for n, w in top) for x, top in tops.items()}
        return {w: [math.log(max(held[x].get(w, 0) / total[x], 1e-7)) for x in langs] for w in known}

    whole, part = kept(seen, words), kept(pieces, grams)
    out = []
    for text in texts:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            out.append(("und", 0.0))
            continue
        sums = [0.0] * len(langs)
        for w in found:
            if w in whole:
                row = whole[w]
            else:
                p, at, rows_ = f"<{w}>", 0, []
                while at < len(p):
                    size = next((n for n in (5, 4, 3, 2, 1) if at + n <= len(p) and p[at : at + n] in part), 0)
                    rows_.append(part[p[at : at + size]] if size else [math.log(1e-7)] * len(langs))
                    at += max(1, size - 1)
                row = [sum(r[i] for r in rows_) / len(rows_) for i in range(len(langs))]
            sums = [a + b for a, b in zip(sums, row, strict=True)]
        sums = [x / math.sqrt(len(found)) for x in sums]
        share = [math.exp(x - max(sums)) for x in sums]
        best = share.index(max(share))
        out.append((langs[best], share[best] / sum(share)))
    return out


@pytest.mark.parametrize(("words", "grams_kept"), [(60_000, 20_000), (30, 50)])
def test_op3_against_plain_scores(spark, words, grams_kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 0 and length(text) < 5000").limit(60)
    rows = [(r.text, r.lang) for r in docs.collect()]
    texts = [t for t, _ in rows[:20]] + ["zzxq wört", "le chat", "", None, "123", "² ½ 12", "Ⅷ ③ x²y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"), words=words, grams=grams_kept)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, model).collect()}
    plain = [None if t is None else "".join(c if c.isalpha() else " " for c in t) for t in texts]
    for i, want in enumerate(plain_language(rows, plain, words, grams_kept)):
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-4, (texts[i], got[i], want)
    assert got[25] == ("und", 0.0) and got[26][0] != "und"


def test_op3_bounds(spark):
    rows = spark.createDataFrame([("alpha beta", "en"), ("gamma", "de")], "text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(rows, languages=1)
    model = langid.learn(rows, 0, 0, 0, 0, 1)
    assert set(model.words) == {"alpha", "beta", "gamma"} and "<gamm" in model.grams


def grams(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset([("", text or "")])


def brute_classes(rows):
    """(class, links) of (id, text) rows by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def near_group(n, seed=9):
    rng = np.random.default_rng(seed)
    base = prose(seed, 120, [f"w{i}" for i in range(400)]).split()
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words[at] = f"x{rng.integers(1000)}"
        out.append(" ".join(words))
    return out


def test_op4(spark, monkeypatch):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.class_id, r.links) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == brute_classes(rows)
    assert jaccard.jaccard_classes(nothing(spark)).count() == 0
    texts = near_group(60) + [prose(s, 80, [f"v{i}" for i in range(500)]) for s in range(20)] + near_group(5, 10)
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    many = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.links) for r in jaccard.jaccard_classes(many).collect()), key=str)
    assert got == brute_classes(rows)


def test_op4_query_loses_no_link_of_all_pairs(spark):
    """Links and classes of the query on sf0.01 against all pairs; recall over links is measured."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    sets = [grams(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = collections.Counter()  # every pair with a common run of words, so every pair that could be linked
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                shared[h[y], h[x]] += 1
    links = collections.Counter()
    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            links[rows[i][0]] += 1
            links[rows[j][0]] += 1
    got = {r.doc_id: r.links for r in jaccard.op4_jaccard_join(spark, folder).collect()}
    assert len(got) == len(rows) and sum(links.values()) > 100
    found = sum(min(links[d], n) for d, n in got.items())
    assert found / sum(links.values()) >= 0.999 and all(n <= links[d] for d, n in got.items())


def test_banding_meets_recall():
    bands, rows = jaccard.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_op5(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 20)
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id", ascending=False).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in fingerprints.op5_fingerprints(spark, SF).collect()}
    prints = {}
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)]
        m = len(text) // 3
        edited = text[: len(text) - m] + following.text[:m]
        g = got[d]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, g.fingerprint) == g.fingerprint
        a, b = grams(text), grams(edited)
        if len(a | b) < 128:  # sketches are exact
            assert abs(g.near_edited - len(a & b) / len(a | b)) < 1e-9
        assert abs(g.near_edited - len(a & b) / len(a | b)) < 0.25 and 0 <= g.near_next <= 1
    assert len(got) == len(rows)


def test_op5_buckets_of_clustered_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)
    monkeypatch.setattr(fingerprints, "FAN", 4)
    ids = [*range(60), *[10**12 + i for i in range(60)], *[77] * 60, *[None] * 30]
    docs = spark.createDataFrame([(d, f"text number {i} of many in a row") for i, d in enumerate(ids)], "doc_id long, text string")
    sizes = [r["count"] for r in fingerprints._bucketed(docs)[0].groupBy("__bucket").count().collect()]
    assert sum(sizes) == 210 and max(sizes) <= 20
    rows = docs.withColumn("t", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), F.desc("t")).collect()
    want = collections.Counter()
    for a, b in zip(rows, [*rows[1:], rows[0]], strict=True):
        m = len(a.text) // 3
        want[a.doc_id, hashlib.sha256((a.text[: len(a.text) - m] + b.text[:m]).encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.edited_sha256) for r in fingerprints.fingerprints(docs).collect())
    assert got == want


def test_op5_awkward(spark):
    from pyspark.sql import functions as F

    got = fingerprints.fingerprints(awkward(spark)).collect()
    assert len(got) == 13 and all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.fingerprints(nothing(spark)).count() == 0
    single = fingerprints.fingerprints(spark.createDataFrame([(1, "")], "doc_id long, text string")).first()
    assert (single.n_chars, single.near_edited, single.near_next) == (0, 1.0, 1.0)
    pair = spark.createDataFrame([(prose(1, 900, [f"a{i}" for i in range(9999)]), prose(1, 300, [f"a{i}" for i in range(9999)]))], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    row = pair.select(
        fingerprints.containment(b, a).alias("c"),
        fingerprints.distinct_count(a).alias("n"),
        (fingerprints.from_text(fingerprints.as_text(a)) == a).alias("back"),
    ).first()
    assert row.c > 0.7 and abs(row.n - 896) < 250 and row.back


def test_op5_sketches_of_parts_merge(spark):
    from pyspark.sql import functions as F

    words = [f"w{i % 700}" for i in range(1500)]
    parts = [words[a : a + 504] for a in range(0, 1500, 500)]  # neighbours share four words, so no shingle is lost
    made = spark.createDataFrame([(" ".join(words), [" ".join(p) for p in parts])], "whole string, parts array<string>")
    each = F.array(*[fingerprints.sketch(F.col("parts")[i]) for i in range(3)])
    row = made.select(fingerprints.merged(each).alias("m"), fingerprints.sketch(F.col("whole")).alias("w")).first()
    assert len(row.w) == fingerprints.K and row.m == row.w


def test_op5_likeness_to_the_next_document(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(7 * i, " ".join(words[i : i + 40 - i % 3])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(found, reverse=True)
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        a, b = set(found[d].sketch), set(found[after].sketch)
        union = set(sorted(a | b)[: fingerprints.K])
        assert abs(found[d].near_next - len(a & b & union) / len(union)) < 1e-12


def sentences(seed, n, words, each=9):
    """n sentences of `each` invented words."""
    rng = np.random.default_rng(seed)
    return [" ".join(str(w) for w in rng.choice(words, each)).capitalize() + "." for _ in range(n)]


def test_op6(spark):
    passage = " ".join(sentences(5, 6, [f"p{i}" for i in range(900)]))
    rows = [
        (1, " ".join(sentences(6, 8, [f"a{i}" for i in range(900)])) + " " + passage),
        (2, "Begin here " + passage + " and go on. " + " ".join(sentences(7, 8, [f"b{i}" for i in range(900)]))),
        (3, " ".join(sentences(8, 11, [f"c{i}" for i in range(900)]))),
        (4, "\n".join([" ".join(sentences(9, 4, [f"d{i}" for i in range(900)]))] * 3)),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.without_repeats(frame).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    inner = ". ".join(passage.split(". ")[1:-1])
    assert inner in rows[1][1] and inner not in got[2].text and got[2].text.endswith(rows[1][1][-60:])
    assert got[4].text.count("d") < rows[3][1].count("d") / 2
    text, ends = rows[1][1], [(x.start, x.end) for x in got[2]["__removed"]]
    kept = "".join(text[a:b] for a, b in zip([0, *[e for _, e in ends]], [*[b for b, _ in ends], len(text)], strict=True))
    assert kept.rstrip() == got[2].text
    docs = awkward(spark)
    out = substrings.without_repeats(docs)
    assert out.count() == 13 and set(docs.columns) < set(out.columns)
    by = {(r.doc_id, r.lang): r.text for r in out.collect()}
    assert by[1, "en"] == prose(1, 60) and by[None, "de"] != prose(1, 60) and by[2, "en"] is None
    assert substrings.without_repeats(nothing(spark)).count() == 0


def test_op6_null_and_repeated_ids_are_kept_apart(spark):
    passage = " ".join(sentences(5, 6, [f"p{i}" for i in range(900)]))
    own = [" ".join(sentences(20 + i, 5, [f"q{j}" for j in range(900)])) for i in range(6)]
    texts = [passage + " " + o for o in own]
    rows = [(None, t, i) for i, t in enumerate(texts[:3])] + [(5, t, 9) for t in texts[3:]] + [(5, texts[3], 9)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, id long")).collect()
    assert len(got) == 7 and got[0].__fields__[:2] == ["doc_id", "id"]
    whole = [r for r in got if passage in r.text]
    # the passage stays in one document of the least id, in both of its equal rows if these are it
    assert {r.doc_id for r in whole} == {5} and len({r.text for r in whole}) == 1 and len(whole) <= 2
    for r in got:
        assert any(r.text.endswith(o) for o in own)
        assert r in whole or passage[20:200] not in r.text


def test_op6_long_unpunctuated_and_unspaced_texts(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"u{i}" for i in rng.integers(0, 5000, 90))
    letters = "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 3000, 400))
    rows = [(1, "one two " + passage), (2, "three " + passage + " four"), (3, "始" + letters), (4, "又" + letters + "终")]
    got = {r.doc_id: r.text for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert len(got[2].split()) < 45 and len(got[4]) < 120


def test_op6_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = {}
    for d in sorted(docs):
        for h, _, _ in substrings.spans(docs[d]):
            first.setdefault(h, d)
    cut = 0
    for r in substrings.op6_substrings(spark, SF).collect():
        text, gone, seen = docs[r.doc_id], set(), set()
        for h, a, b in substrings.spans(text):
            if first[h] != r.doc_id or h in seen:
                gone.update(range(a, b))
            seen.add(h)
        kept = "".join(c for i, c in enumerate(text) if i not in gone)
        assert r.text == (kept.rstrip() if gone else text)
        cut += bool(gone)
    assert cut > 5


def test_op6_recall_and_false_removals(spark):
    """Runs of 50 words that other documents share, found by brute force on sf0.01."""
    folder = "/root/testdata/sf0.01"
    docs = dict(sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()))
    words = {d: [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t)] for d, t in docs.items()}
    holders = collections.defaultdict(list)
    for d, ws in words.items():
        for i in range(len(ws) - 49):
            holders[hash(tuple(w for w, _, _ in ws[i : i + 50]))].append((d, i))
    shared = {d for h in holders.values() if len({d for d, _ in h}) > 1 for d, _ in h}
    later = {(d, i) for h in holders.values() for d, i in h if d != h[0][0]}
    later = {(d, i) for d, i in later if len({w for w, _, _ in words[d][i : i + 50]}) >= 20}  # no chains of one word
    starts = [(d, i) for d, i in later if (d, i - 1) not in later]
    got = {r.doc_id: [(x.start, x.end) for x in r.removed] for r in substrings.op6_substrings(spark, folder).collect()}
    hit = sum(any(a < words[d][i + 49][2] and b > words[d][i][1] for a, b in got[d]) for d, i in starts)
    clean = [d for d in docs if d not in shared]
    alone = sum(not got[d] for d in clean)
    # documents that repeat passages of their own are cut by design
    own = sum(len({h for h, _, _ in s}) < len(s) for s in (substrings.spans(docs[d]) for d in clean))
    assert len(starts) > 50 and hit / len(starts) > 0.95, (hit, len(starts))
    assert (alone + own) / len(clean) > 0.95, (alone, own, len(clean))


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    texts, grades, names = [], [], ["low", "mid", "high"]
    for i in range(300):
        g = i % 3
        texts.append(" ".join(rng.choice([names[g], names[min(g + 1, 2)], "x", "y", "z"], 12)))
        grades.append(float(g))
    rows = [quality.hashed(t) for t in texts]
    model = quality.fit(rows, grades, 120)
    scores = np.array([(model.weights[slots] * times).sum() * value for slots, times, value in rows])
    tails = model.tails(scores)
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(model.thresholds) > 0).all()
    expected = tails.sum(axis=1)
    means = [expected[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] + 0.2 < means[1] < means[2] - 0.2, means


def test_op7(spark):
    got = quality.op7_quality(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(truth)
    assert len(got) == 1000 and (both.keep == (both.quality == 1)).mean() > 0.9
    ratings = label_rows(spark).selectExpr("doc_id", "quality as grade")
    assert quality.grade(awkward(spark), quality.learn(awkward(spark), ratings)).count() == 13
    none = quality.learn(nothing(spark), ratings)
    assert quality.grade(awkward(spark), none).filter("size(tails) = 0").count() == 13


def test_op5_merged_sketches_are_that_of_the_whole(spark):
    words = [f"w{i}" for i in range(900)]
    parts = [" ".join(words[:400]), " ".join(words[396:700]), " ".join(words[696:])]  # neighbours share the words of a seam
    frame = spark.createDataFrame([(*parts, " ".join(words))], "a string, b string, c string, whole string")
    sketches = F.array(*map(fingerprints.sketch, ("a", "b", "c")))
    assert frame.select(fingerprints.merged(sketches) == fingerprints.sketch("whole")).first()[0]
    assert frame.select(fingerprints.merged(F.array(fingerprints.sketch("a"), fingerprints.sketch("c"))) == fingerprints.sketch("whole")).first()[0] is False


def test_op7_learns_from_large_counts_as_they_are(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda rows, grades: taken.extend(rows))
    text = " ".join(f"w{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    quality.learn(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int"))
    want = quality.hashed(text)
    assert taken[0][1].max() == want[1].max() > 65_535 and (taken[0][0] == want[0]).all() and (taken[0][1] == want[1]).all()


def test_op3_without_a_bound_of_languages(spark):
    rows = spark.createDataFrame([(f"{w} {w} common", w) for w in ("un", "deux", "trois", "quatre")] * 2, "text string, lang string")
    assert langid.learn(rows, languages=0, least=1).langs == ["deux", "quatre", "trois", "un"]


def test_one_row_each_tells_maps_apart(spark):
    rows = spark.sql("select 1 as k, map('a', 1) as m, named_struct('x', map('b', 2)) as s union all select 1, map('a', 2), named_struct('x', map('b', 3))")
    found = [common.one_row_each(r, ["k"]).collect() for r in (rows, rows.orderBy(F.desc(F.element_at("m", "a"))).coalesce(1))]
    assert found[0] == found[1] and len(found[0]) == 1


def test_op7_against_plain_scores(spark):
    """Expected grades and tails of a small model by a second, plain implementation, token by token."""
    ratings = spark.createDataFrame([(i, float(i % 3)) for i in range(40)], "doc_id long, grade double")
    names = ["low", "mid", "high"]
    texts = [(i, " ".join([names[i % 3], names[min(i % 3 + i % 2, 2)], f"x{i % 7}", "y-2", "Z9"])) for i in range(40)]
    docs = spark.createDataFrame([*texts, (90, None), (91, ""), (92, "high! high LOW")], "doc_id long, text string")
    model = quality.learn(docs, ratings)
    assert model.grades == [0.0, 1.0, 2.0] and (np.diff(model.thresholds) > 0).all()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.grade(docs, model).collect():
        tokens = (texts[r.doc_id] or "").split()
        total = sum(float(model.weights[s]) for t in sorted(set(tokens)) for s in quality.token_slots(t))
        total += sum(float(model.weights[s]) for s in quality.text_slots(tokens))
        score = total / math.sqrt(max(len(set(tokens)), 1) + 1)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert all(abs(a - b) < 1e-5 for a, b in zip(r.tails, tails, strict=True)) and tails[0] > tails[1]
        assert abs(r.expected_grade - sum(tails)) < 1e-5


def test_op7_fit_reaches_the_likelihood_of_plain_steps(spark):
    """The gradient of the fit against differences of the likelihood, by many small steps on the same rows."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], 4)) for _ in range(60)]
    grades = [float(t.split().count("a") > 0) + float(t.split().count("b") > 1) for t in texts]
    rows = [quality.hashed(t) for t in texts]

    def loss(model):
        out = 0.0
        for (slots, times, value), g in zip(rows, grades, strict=True):
            score = float((model.weights[slots] * times).sum() * value)
            below = [1 / (1 + math.exp(score - t)) for t in model.thresholds]
            edges = [0.0, *below, 1.0]
            k = model.grades.index(g)
            out -= math.log(max(edges[k + 1] - edges[k], 1e-12))
        return out / len(rows)

    model = quality.fit(rows, grades, 400)
    best = loss(model)
    for slot in np.unique(np.concatenate([r[0] for r in rows]))[:12]:
        for step in (-0.5, 0.5):
            other = quality.Model(model.weights.copy(), model.thresholds, model.grades)
            other.weights[slot] += step
            assert loss(other) > best - 1e-3


def test_op8_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = mixing.op8_mixing(spark, SF).orderBy("doc_id", "epoch").collect()
    want = con.sql(mixing.oracle_sql() + " ORDER BY doc_id, epoch").fetchall()
    assert [tuple(r[c] for c in ("doc_id", "domain", "lang", "source", "tokens", "epoch", "begin", "taken")) for r in got] == want


def test_op8_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)]
    leaves = spark.createDataFrame(rows, "d string, l string, tokens long")
    from pyspark.sql import functions as F

    got = {(r.d, r.l): r.budget for r in mixing.budgets(leaves, F.lit(800), ("d", "l"), {}, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 390, ("b", "x"): 200, ("b", "y"): 200}
    short = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 1000)], "d string, l string, tokens long")
    got = {(r.d, r.l): r.budget for r in mixing.budgets(short, F.lit(500), ("d", "l"), {}, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 470}


def test_op8_awkward(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 2)
    docs = awkward(spark)
    docs = docs.withColumn("domain", mixing.domain_of(docs.source))
    chosen = mixing.mix(docs, share=0.5)
    total = sum(r.taken for r in chosen.collect())
    tokens = docs.dropDuplicates(["doc_id", "text", "lang", "source"]).select(mixing.tokens(docs.text).alias("t")).toPandas().t.sum()
    assert abs(total - tokens * 0.5) <= 12
    out = mixing.mixed_documents(docs, chosen)
    assert out.columns == docs.columns
    # the text that comes out holds the tokens of the budget: repeated rows are given back once
    assert sum(len((r.text or "").split()) for r in out.collect()) == total
    empty = nothing(spark)
    assert mixing.mix(empty.withColumn("domain", mixing.domain_of(empty.source))).count() == 0


def test_op8_rows_of_one_text_in_two_sources(spark):
    rows = [(1, "a b c d", "en", "src0"), (1, "a b c d", "en", "src0"), (1, "a b c d", "en", "src11"), (None, "e f", None, None), (None, "e f", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("domain", mixing.domain_of(docs.source)).withColumns({c: F.lit("z") for c in ("__id", "__tag", "taken", "null", "level0")})
    chosen = mixing.mix(docs, share=1.0, epochs=1)
    out = mixing.mixed_documents(docs, chosen)
    assert chosen.count() == 3 and out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.source or "") for r in out.collect()) == [(0, ""), (1, "src0"), (1, "src11")]


def test_op8_domains_come_from_a_mapping(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "source string")
    found = rows.select(mixing.domain_of(F.col("source"), {"a": "x", "b": "y"}, "rest").alias("d")).collect()
    assert [r.d for r in found] == ["x", "y", "rest", "rest"]


def test_op9(spark):
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    both = got.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas())
    out = both[both.held_out]
    rank = out.score.rank()
    bad = out.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert len(got) == 1000 and auc > 0.9 and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_op9_awkward(spark):
    model = toxicity.learn(awkward(spark), label_rows(spark))
    assert model.score(awkward(spark), awkward(spark).columns).count() == 13
    none = toxicity.learn(awkward(spark), label_rows(spark).filter("toxic = 0"))
    assert {r["__score"] for r in none.score(awkward(spark)).collect()} == {0.0}
    assert none.score(nothing(spark)).count() == 0
    read = toxicity.Reader(({"vile": 2.0}, {}))
    plain, hidden = read("you are an idiot"), read("you are an 1d10t")
    assert plain[1] > 0 and plain[15] > 0 and hidden[10] > 0 and read(None) == read("")


def plain_features(text, words, begins):
    """The features of a text by a second, plain implementation: one token after the other."""
    tokens = re.findall(r"\S+", text or "")
    n, chars = max(len(tokens), 1), max(len(text or ""), 1)
    total = collections.Counter()
    marked, you, strength = [], [], 0.0
    for i, token in enumerate(tokens):
        runs = [w.lower() for w in re.findall(r"[^\W\d_]+", token)]
        insult = sum(w in toxicity.INSULTS for w in runs)
        learned = [words[w] for w in runs if w in words]
        begun = [begins[w[:5]] for w in runs if len(w) > 5 and w[:5] in begins]
        obscured = toxicity.INNER.search(token) is not None
        hidden = 0
        if obscured or re.search(r"(.)\1\1", token):
            w = toxicity.plain_word(token)
            hidden = int((w in toxicity.INSULTS or w in words) and w not in runs)
        total.update(
            insult=insult, learned=len(learned), learned_sum=sum(learned), begun=len(begun), begun_sum=sum(begun), obscured=obscured,
            hidden=hidden, capital=any(len(w) > 1 and w.isupper() for w in re.findall(r"[^\W\d_]+", token)),
            sign=sum(not c.isalnum() for c in token), strong=toxicity.SIGNS.search(token) is not None,
        )
        if insult or learned or begun or hidden:
            marked.append(i)
        if any(w in toxicity.YOU for w in runs):
            you.append(i)
        strength = max([strength, *learned, *begun])
    close = sum(any(abs(i - j) <= 4 for j in you) for i in marked)
    log = math.log1p
    return [
        log(n), total["insult"] / n, log(total["insult"]), total["learned"] / n, log(total["learned"]), total["learned_sum"] / n,
        total["begun"] / n, log(total["begun"]), total["begun_sum"] / n, total["obscured"] / n, log(total["hidden"]), total["capital"] / n,
        total["sign"] / chars, total["strong"] / n, len(you) / n, close / n, log(close), sum(c.isupper() for c in text or "") / chars,
        strength, log(len(marked)),
    ]


def test_op9_features_against_plain_ones(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    seen = [w for t in texts[:5] for w in re.findall(r"[^\W\d_]+", t.lower())]
    words, begins = {w: 1.0 + i / 7 for i, w in enumerate(seen[:40])}, {w[:5]: 0.5 for w in seen[40:80] if len(w) > 5}
    texts += ["", None, "You IDIOT!! u 1d10t, looooser... a you b c d e idiot", "É ß. ǅ @#$ x-y trash-can you,", " \x1c a\x85b "]
    read = toxicity.Reader((words, begins), 400 * 200)  # a small memory, cleared on the way
    for t in texts:
        assert np.allclose(read(t), plain_features(t, words, begins)), t


def test_op9_calibration_against_pooled_violators(spark):
    """Isotonic steps by pooling adjacent violators, on the trees' scores grouped as the model groups them."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    bounds, steps = list(model.steps.boundaries), list(model.steps.predictions)
    assert all(a <= b for a, b in zip(steps, steps[1:], strict=False)) and len(steps) >= 2
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id").withColumn("held", toxicity._part("calibrate", 4) == 0)
    held = known.filter("held")
    halves = [
        toxicity.features(held.filter(toxicity._part("half", 2) == h), toxicity.lexicon_of(known.filter(toxicity._part("half", 2) != h)), ["toxic"])
        for h in (0, 1)
    ]
    rows = model._raw(halves[0].unionByName(halves[1])).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["__raw"]].append(r.toxic)
    pools = []
    for raw in sorted(groups):
        pools.append([sum(groups[raw]), len(groups[raw]), raw])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            good, n, _ = pools.pop()
            pools[-1][0] += good
            pools[-1][1] += n
    want = {raw: next(p[0] / p[1] for p in reversed(pools) if p[2] <= raw) for raw in groups}
    got = {raw: float(np.interp(raw, bounds, steps)) for raw in groups}
    assert all(abs(want[r] - got[r]) < 1e-9 for r in groups)


def test_op10(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = media.op10_media(spark, SF).collect()
    assert len(got) == len(texts)
    for g in got:
        raw = texts[g.doc_id].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = b"P5\n192 %d\n255\n" % (len(payload) // 192) + payload
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (g.tail_crc32, g.media_bytes, g.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert g.position == g.n_items - 1


def test_op10_awkward(spark, tmp_path):
    for name, make, n in (("a", awkward, 13), ("b", nothing, 0)):
        make(spark).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = media.op10_media(spark, str(tmp_path / name)).collect()
        assert len(got) == n
        for r in got:
            assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(r.n_bytes, 192) and r.media_sha256
        assert len({r.payload_sha256 for r in got if r.n_bytes == 0}) <= 1


def test_op10_pages(spark, tmp_path):
    html = '<p>one <b>two</b></p><figure><img src="sha256:aa"><figcaption>the <i>cap</i></figcaption></figure>three<script>no</script><img src="sha256:bb" alt="alt"/>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (1, html), (None, "<p>x")], "page_id long, html string")
    rows = media.sequences(pages).collect()
    assert [(e.kind, e.text, e.ref, e.caption) for e in rows[0].sequence] == [
        ("text", "one two", None, None),
        ("media", None, "sha256:aa", "the cap"),
        ("text", "three", None, None),
        ("media", None, "sha256:bb", "alt"),
    ]
    assert [e.position for e in rows[0].sequence] == [0, 1, 2, 3] and rows[1].sequence == [] and rows[2].sequence == []
    items = spark.createDataFrame([("aa", b"y" * 192), ("aa", b"y" * 192)], "digest string, payload binary")
    media.store(items, str(tmp_path / "m"))
    got = media.interleaved(media.sequences(pages), media.resolved(spark, str(tmp_path / "m"))).collect()
    assert sorted((r.page_id, r.position, r.caption, r.payload_bytes) for r in got) == [(1, 1, "the cap", 192)] * 2 + [(1, 3, "alt", None)] * 2
    with pytest.raises(ValueError):
        media.samples(b"P6\n1 1\n255\nx")


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    label_rows(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for make in (awkward, nothing):
        docs = make(spark)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == columns, name
            path = str(tmp_path / f"{make.__name__}-{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (packing_rows := corpus_pipeline.packing(spark, docs, str(tmp_path)).count()) >= docs.count()
        assert (packing_rows == 0) == (make is nothing)


def test_pipeline_dedup_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(d for d, c, _ in brute_classes(rows) if d == c)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == want


def test_pipeline_leaves_one_row_of_each_class(spark):
    a, b = near_group(1, 30)[0], prose(31, 90, [f"k{i}" for i in range(400)])
    edited = " ".join([*a.split()[:-1], "zz"])
    rows = [(None, a, 1), (None, edited, 2), (7, b, 3), (7, b + " end", 4), (7, b, 5), (8, "other words entirely in here now", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 7, 8] and got[0].__fields__ == docs.columns
    again = corpus_pipeline.near_copies(spark, docs.repartition(3), SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pipeline_mixing_keeps_nine_tenths_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.mixing(spark, docs, SF).collect()
    before = {r.doc_id: r.text for r in docs.collect()}
    n = sum(len((t or "").split()) for t in before.values())
    leaves = docs.select("lang", "source").distinct().count()  # each drops a part of a token
    assert len({r.doc_id for r in out}) == len(out) and 0 <= n * 0.9 - sum(len((r.text or "").split()) for r in out) <= leaves
    assert all((before[r.doc_id] or "").startswith(r.text or "") and r.n_chars == len(r.text) for r in out)


def test_registry_has_a_query_per_operator():
    numbers = sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES if re.match(r"op\d+_", q))
    assert numbers == list(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)


def test_op8_cut_text_holds_the_tokens_taken(spark):
    texts = {1: " foo bar baz", 2: "foo bar baz", 3: "\n\t foo\n bar baz", 4: "  foo bar", 5: " foo bar"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), mixing.tokens(F.col("text")).alias("tokens"))
    taken = F.when(F.col("doc_id") == 4, 1).when(F.col("doc_id") == 5, 0).otherwise(2).cast("long")
    got = {r.doc_id: r.text for r in mixing.mixed_documents(docs, rows.withColumn("taken", taken), ()).collect()}
    assert {d: t.split() for d, t in got.items()} == {1: ["foo", "bar"], 2: ["foo", "bar"], 3: ["foo", "bar"], 4: ["foo"], 5: []}
    assert all(texts[d].startswith(t) for d, t in got.items())
