"""Operators 11 to 13 against brute force, SQL, and on awkward tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm import SF, awkward, nothing

from barlight.llm import manifest, metric, registry, runs


def slow_runs(words):
    """All runs by comparing each word with the one a period later."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        begin = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                begin = i if begin is None else begin
            elif begin is not None:
                if i + q - begin >= max(24, 3 * q):
                    found.setdefault((begin, i + q), q)
                begin = None
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    n, kinds = rng.randint(0, 250), rng.choice([1, 2, 3, 5, 50, 1000])
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 30 else 0):
        a, p = rng.randrange(n), rng.randint(1, 60)
        words[a:a] = words[a : a + p] * rng.randint(2, 6)
    return words * (rng.randint(1, 4) if rng.random() < 0.3 else 1)


def test_op11_runs_equal_brute_force():
    rng, seen = random.Random(5), 0
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        want = [slow_runs(t) for t in texts]
        assert runs.runs_in(texts) == want
        seen += sum(map(len, want))
    assert seen > 200


def test_op11_known_runs():
    a, abc = [b"a"], [b"a", b"b", b"c"]
    nested = ([b"x", b"x", b"y"] * 8 + [b"z"]) * 3
    assert runs.runs_in([a * 23, a * 24, abc * 8, abc * 7 + [b"a", b"b"]]) == [[], [(0, 24, 1)], [(0, 24, 3)], []]
    assert runs.runs_in([nested])[0] == [(0, 24, 3), (0, 75, 25), (25, 24, 3), (50, 24, 3)]
    assert runs.runs_in([[b"%d" % i for i in range(700)] * 3])[0] == [(0, 2100, 700)]
    assert runs.runs_in([a * 200_000])[0] == [(0, 200_000, 1)]


def test_op11_grammar_gives_the_words_back():
    rng = random.Random(1)
    words = np.array([rng.randrange(3) for _ in range(2_000)])
    g = runs.Grammar(words, 3)

    def spelled(s):
        return [s] if s < 3 else spelled(g.left[s - 3]) + spelled(g.right[s - 3])

    assert [w for s in g.seq.tolist() for w in spelled(s)] == words.tolist() and len(g.seq) < 1_000
    for rule, place in zip(*g.places(24), strict=True):
        assert spelled(rule + 3) == words[place : place + g.sizes[rule + 3]].tolist()
        assert g.sizes[rule + 3] == len(spelled(rule + 3))


def test_op11_awkward(spark):
    rows = awkward(spark).unionByName(spark.createDataFrame([(20, "la " * 30), (20, "la " * 30), (None, "la\x85 " * 30)], "doc_id long, text string"), allowMissingColumns=True)
    got = runs.periodic_runs(rows).collect()
    assert len(got) == rows.count() and got[0].__fields__[: len(rows.columns)] == rows.columns
    for r in got:
        words = (r.text or "").encode().split()
        want = slow_runs(words) if len(words) < 5_000 else []
        assert [tuple(x) for x in r.runs] == want
        cut = set().union(*(range(s + q, s + n) for s, n, q in want))
        assert bytes(r.collapsed) == b" ".join(w for i, w in enumerate(words) if i not in cut)
    assert sum(len(r.runs) for r in got) == 3
    assert runs.periodic_runs(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(rows.withColumnRenamed("tag", "Runs"))


def test_op11_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    planted = 0
    for r in runs.op11_runs(spark, SF).collect():
        words = docs[r.doc_id].encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
            planted += 1
        want = slow_runs(words) if n < 1_500 else [tuple(x) for x in runs.runs_in([words])[0]]
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        if want:
            s, length, q = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, length, q, 1000 * length // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert planted > 5


def families(seed, sizes, alone=150, width=16, spread=0.03):
    """Vectors in tight groups of some sizes, and others by themselves, of two labels."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=width) for _ in range(alone)]
    for n in sizes:
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        rows += [centre + rng.normal(size=width) * spread for _ in range(n)]
    return [(int(i), (v * rng.uniform(0.1, 9)).tolist(), int(i % 3 > 0)) for i, v in enumerate(rows)]


def slow_near(rows, cosine=0.98):
    """All pairs, and components by merging."""
    ids, label = [r[0] for r in rows], [r[2] for r in rows]
    fine = [r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None for r in rows]
    links, group = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and label[i] == label[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    a, b = group[i], group[j]
                    group = [b if g == a else g for g in group]
    least = [min((ids[k] for k in range(len(rows)) if group[k] == group[i] and ids[k] is not None), default=None) for i in range(len(rows))]
    return sorted(((a, n, c, a == c) for a, n, c in zip(ids, links, least, strict=True)), key=str)


def near_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.fixture
def joins_decided_late(spark):
    """Joins planned with exchanges that Spark turns into broadcasts as it runs, as on tables of some size."""
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1m")
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("cell", [8, 40])
def test_op12_equals_all_pairs(spark, monkeypatch, joins_decided_late, cell):
    for name, value in {"CELL": cell, "PER_PIVOT": max(2, cell // 4), "SALT_ROWS": 50, "BLOCK": 16}.items():
        monkeypatch.setattr(metric, name, value)
    rows = families(cell, [2, 3, 40, 120])
    got = near_rows(metric.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert got == slow_near(rows) and sum(r[1] for r in got) > 5_000


def test_op12_cells_meet_each_near_pair_once(spark, monkeypatch):
    for name, value in {"CELL": 20, "PER_PIVOT": 10, "GAIN": 2.0, "ROUNDS": 2}.items():
        monkeypatch.setattr(metric, name, value)
    rows = families(3, [30, 5], alone=300, width=4)
    nodes = spark.createDataFrame([(b"%d" % i, "0", 1, np.array(v, "<f8").tobytes()) for i, v, _ in rows], "node binary, cell string, copies long, vec binary")
    met, held = {}, {}
    for r in metric.cells(nodes, "<f8", float(np.arccos(0.98))).collect():
        held.setdefault(r.cell, []).append((int(bytes(r.node)), r.home))
    for members in held.values():
        for a, home in members:
            for b, other in members:
                if a != b and home and (not other or a < b):
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    x = metric.units([np.array(v, "<f8").tobytes() for _, v, _ in rows], "<f8")
    near = {(i, j) for j in range(len(rows)) for i in range(j) if x[i] @ x[j] >= 0.98}
    assert len(held) > 10 and max(met.values()) == 1 and near <= set(met) and len(met) < 0.6 * len(rows) ** 2 / 2


def test_op12_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [2.0, 0.0], 0), (5, [1e-300, 0.0], 0), (6, [1e300, 1e299], 0), (7, [1.0, 0.0, 0.0], 0),
        (8, None, 0), (9, [], 0), (10, [0.0, 0.0], 0), (11, [nan, 1.0], 0), (12, [inf, 1.0], 0), (13, [None, 1.0], 0), (14, [1.0, 0.0], None),
        (14, [1.0, 0.0], 1), (15, [1.0, 0.25], 0), (None, [0.0, 1.0], 0), (None, [0.0, 1.0], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'z' as node", "1 as cell", "0 as kept", "1 as copies")
    want = [(a, n, c, True if a is None and c is None else bool(k)) for a, n, c, k in slow_near(rows)]
    assert near_rows(metric.near_vectors(table)) == sorted(want, key=str)
    assert metric.near_vectors(table.limit(0)).count() == 0


def test_op12_float_vectors_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    near = rows.withColumns({"vec_id": F.col("vec_id") + 1_000, "embedding": F.expr("transform(embedding, (x, i) -> cast(x * 3 + if(i < 4, 0.05, 0) as float))")})
    both = rows.unionByName(near.filter("vec_id % 2 = 0"))
    assert near_rows(metric.near_vectors(both)) == slow_near([(r.vec_id, r.embedding, r.label) for r in both.collect()])


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_trees(rows):
    """rows(doc_id, source, lang, n_chars, text) to leaf, subroot, root, siblings of each, in plain Python."""

    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        """Root and each node's steps."""
        steps, owner = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, o in enumerate(owner):
                run = nodes[o // 3 * 3 : o // 3 * 3 + 3]
                steps[i].append(("".join(run[: o % 3]), "".join(run[o % 3 + 1 :])))
                owner[i] = o // 3
            nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        return nodes[0], steps

    leaves = [digest(*map(told, r)) for r in rows]
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r[1], []).append(i)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in groups:
        by[s].sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
    low = {s: tree([leaves[i] for i in by[s]]) for s in groups}
    root, high = tree([low[s][0] for s in groups])
    out = {}
    for g, s in enumerate(groups):
        for k, i in enumerate(by[s]):
            out[i] = (leaves[i], low[s][0], root, low[s][1][k] + high[g])
    return [out[i] for i in range(len(rows))]


def test_op13_awkward(spark):
    rows = awkward(spark)
    rows = rows.unionByName(spark.createDataFrame([(i, "a\n\nb", None, "é" if i % 7 else None, i) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars int"), allowMissingColumns=True)
    fields = [F.col(c) for c in manifest.FIELDS]
    got = manifest.manifest(rows, fields, F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "tag": F.col("tag")}).collect()
    given = [tuple(r[c] for c in manifest.FIELDS) for r in rows.collect()]
    want = [(leaf, sub, root, steps) for leaf, sub, root, steps in slow_trees(given)]
    assert sorted((r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got) == sorted(want)
    assert manifest.manifest(nothing(spark), fields, F.col("source"), [F.col("doc_id")], {}).count() == 0
    one = manifest.manifest(rows.limit(1), fields, F.col("source"), [F.col("doc_id")], {}).collect()[0]
    assert one.leaf == one.subroot == one.root and one.path == []


@pytest.mark.parametrize("levels", [1, 2])
def test_op13_passes_of_few_levels(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "CHUNK", 3**levels)
    rows = [(i, f"s{i % 5 if i < 60 else 0}", "en", i, f"t{i}") for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    got = manifest.manifest(table, [F.col(c) for c in manifest.FIELDS], F.col("source"), [F.col("doc_id")], {})
    want = [(leaf, sub, root, steps) for leaf, sub, root, steps in slow_trees(rows)]
    assert sorted((r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got.collect()) == sorted(want)
    again = got.select(manifest.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    assert {r[0] for r in again.collect()} == {True}


def test_op13_tampering_is_found(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = manifest.op13_manifest(spark, SF).collect()
    for r in found:
        hit = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in docs[r.doc_id]
        assert r.verified == (not hit) == (r.folded_root == r.root)
    assert {r.verified for r in found} == {True, False} and len({r.root for r in found}) == 1


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if n != "op8_mixing"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want, got = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    order = sorted(want.columns)
    assert sorted(got.columns) == order and len(got) == len(want) > 0
    frames = [f[order].sort_values(order).reset_index(drop=True) for f in (got, want)]
    pd.testing.assert_frame_equal(*frames, check_dtype=False)
