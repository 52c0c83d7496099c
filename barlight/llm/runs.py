"""Periodic runs of words, found in a grammar of the words (operator 11)."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import columns_added, free_name, mix64

#: A run has at least LEAST words and TIMES periods. So it shows GRAM words again one period later, and at one
#: side of any place inside it NEAR words; GRAM words where the period is FAR or more.
LEAST, TIMES = 24, 3
GRAM, NEAR, FAR = 16, 4, 32
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def four_times(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of 4k words from those of k words."""
    out = np.zeros(max(0, len(h) - 3 * k), np.uint64)
    for part in range(4):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[part * k : part * k + len(out)])
    return out


def repeated(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marks the words that lie in GRAM words which their text has twice: all words of all runs, and few others.

    h has the hashes of the words of several texts, one after another, sizes their numbers of words.
    """
    g = four_times(four_times(h, 1), 4)
    marks = np.zeros(len(h) + 1, np.int64)
    if len(g):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        g = g + mix64(owner[: len(g)].astype(np.uint64) + np.uint64(1))
        whole = np.flatnonzero(owner[: len(g)] == owner[GRAM - 1 :])
        g = g[whole]
        ordered = np.sort(g)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = whole[twice[np.minimum(np.searchsorted(twice, g), len(twice) - 1)] == g]
            marks[at] += 1
            np.subtract.at(marks, at + GRAM, 1)
    return np.cumsum(marks[:-1]) > 0


class Grammar:
    """Re-Pair of a sequence of symbols, in rounds.

    A round replaces every pair that occurs more often than the pairs it overlaps (ties by a hash of the
    pair), where it does so at least twice; the most frequent pair always is among them. Symbols from
    `terminals` on are rules (left, right); first tells where a rule's words stand first. seq and
    pos are what is left in the end: symbols and the places where their words begin.
    """

    def __init__(self, words: np.ndarray, terminals: int) -> None:
        seq, pos = words.astype(np.int64), np.arange(len(words))
        self.terminals, self.rounds = terminals, [terminals]
        size, left, right, first = ([np.ones(terminals, np.int64)], [], [], [])
        sizes = size[0]
        while len(seq) > 1:
            n = self.rounds[-1]
            pair, at = np.unique(seq[:-1] * n + seq[1:], return_inverse=True)
            # stretches of one pair that overlaps itself count, and are replaced, at every other place
            new = np.concatenate([[True], at[1:] != at[:-1]])
            begin = np.flatnonzero(new)
            end = np.concatenate([begin[1:], [len(at)]]) - 1
            stretch = at[begin]
            count = np.bincount(stretch, (end - begin) // 2 + 1, minlength=len(pair)).astype(np.int64)
            rank = np.empty(len(pair), np.int64)
            rank[np.lexsort((mix64(pair.astype(np.uint64)), count))] = np.arange(len(pair))
            rank[count < 2] = -1
            of = np.concatenate([[-1], rank[stretch], [-1]])
            good = (of[1:-1] >= 0) & (of[1:-1] > of[:-2]) & (of[1:-1] > of[2:])
            here = np.cumsum(new) - 1
            chosen = np.flatnonzero(good[here] & ((np.arange(len(at)) - begin[here]) % 2 == 0))
            chosen = chosen[np.bincount(at[chosen], minlength=len(pair))[at[chosen]] >= 2]
            if not len(chosen):
                break
            used, where, number = np.unique(at[chosen], return_index=True, return_inverse=True)
            left.append(pair[used] // n)
            right.append(pair[used] % n)
            first.append(pos[chosen[where]])
            size.append(sizes[left[-1]] + sizes[right[-1]])
            sizes = np.concatenate(size)
            self.rounds.append(n + len(used))
            seq[chosen] = n + number
            keep = np.ones(len(seq), bool)
            keep[chosen + 1] = False
            seq, pos = seq[keep], pos[keep]
        none = [np.zeros(0, np.int64)]
        self.seq, self.pos, self.sizes = seq, pos, sizes
        self.left, self.right, self.first = (np.concatenate(x or none) for x in (left, right, first))

    def places(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """All nodes of the derivation that are rules of at least `least` words: rules and their places, by rule."""
        t = self.terminals
        rule, pos = self.seq - t, self.pos
        found = []
        for begin in reversed(self.rounds[:-1]):
            long = (rule >= 0) & (self.sizes[np.maximum(rule, 0) + t] >= least)
            rule, pos = rule[long], pos[long]
            now = rule >= begin - t
            found.append((rule[now], pos[now]))
            left, right = self.left[rule[now]], self.right[rule[now]]
            rest = (rule[~now], left - t, right - t)
            pos = np.concatenate([pos[~now], pos[now], pos[now] + self.sizes[left]])
            rule = np.concatenate(rest)
        rules, places = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        order = np.argsort(rules, kind="stable")
        return rules[order], places[order]


class Likeness:
    """How far two places of a sequence agree, forwards and backwards, by hashes of 1, 4, 16, .. words."""

    def __init__(self, words: np.ndarray) -> None:
        self.levels = {1: mix64(words.astype(np.uint64) + np.uint64(1))}
        k = 1
        while 8 * k <= len(words):
            self.levels[4 * k] = four_times(self.levels[k], k)
            k *= 4

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Equal words from i and j on (back: before them), at most `most`."""
        done = np.zeros(len(i), np.int64)
        for k in sorted(self.levels, reverse=True):
            h = self.levels[k]
            active = np.flatnonzero(done + k <= most)
            while len(active):
                a, b = (x[active] + (-done[active] - k if back else done[active]) for x in (i, j))
                active = active[h[a] == h[b]]
                done[active] += k
                active = active[done[active] + k <= most[active]]
        return done


def _seeds(like: Likeness, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of a boundary, place, period): places whose words are those of a period before, at both sides of boundaries.

    A run over a boundary has half its words or more at one side, so that words next to the boundary are
    seen again a period away: NEAR of them, and GRAM for periods of FAR or more.
    """
    out = []
    near, n = like.levels[NEAR], np.arange(len(b))
    for q in range(1, FAR):
        for at, shown in ((b - NEAR, b - 1), (b + q, b + q)):
            fits = n[(at - q >= lo) & (at + NEAR <= hi)]
            fits = fits[near[at[fits]] == near[at[fits] - q]]
            out.append((fits, shown[fits], np.full(len(fits), q)))
    far = like.levels.get(GRAM)
    if far is not None:
        order = np.argsort(far, kind="stable")
        rank = np.empty(len(far), np.int64)
        rank[order] = np.arange(len(far))
        group = np.cumsum(np.concatenate([[True], far[order][1:] != far[order][:-1]])) - 1
        width = len(far) + 1
        keys = group * width + order  # ascending: by gram, then place
        for side in (-1, 1):
            at = b - GRAM if side < 0 else b
            fits = n[(at >= lo) & (at + GRAM <= hi)]
            own = group[rank[at[fits]]] * width
            if side < 0:
                begin, end = np.searchsorted(keys, own + lo[fits]), np.searchsorted(keys, own + at[fits] - FAR, side="right")
            else:
                begin, end = np.searchsorted(keys, own + at[fits] + FAR), np.searchsorted(keys, own + hi[fits] - GRAM, side="right")
            many = np.maximum(end - begin, 0)
            who = np.repeat(fits, many)
            other = order[np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            out.append((who, b[who] - 1 if side < 0 else other, np.abs(at[who] - other)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs_of(words: np.ndarray, terminals: int, parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in words: numbers below `terminals`, those that end a part occurring once.

    parts: where each part begins, and the length of all. Runs over the boundary inside a rule are found
    once, where the rule stands first, and told at all places of the rule; those over boundaries of what
    is left of the sequence where they are. What is cut at a rule's end is part of a longer run that
    a larger rule, or the sequence, has. Every run is compared word by word in the end.
    """
    if len(words) < LEAST:
        return []
    g, like = Grammar(words, terminals), Likeness(words)
    rule = np.flatnonzero(g.sizes[g.terminals :] >= LEAST)
    cut = g.pos[1:]
    part = np.searchsorted(parts, cut, side="right")
    lo = np.concatenate([g.first[rule], parts[part - 1]])
    b = np.concatenate([g.first[rule] + g.sizes[g.left[rule]], cut])
    hi = np.concatenate([g.first[rule] + g.sizes[rule + g.terminals], parts[np.minimum(part, len(parts) - 1)]])
    rule = np.concatenate([rule, np.full(len(cut), -1)])
    who, at, q = _seeds(like, b, lo, hi)
    start = at - like.common(at, at - q, at - q - lo[who], back=True) - q
    end = at + like.common(at, at - q, hi[who] - at)
    held = (end - start >= np.maximum(LEAST, TIMES * q)) & (start < b[who]) & (end > b[who])
    # tell them at all places: rows are (rule, start, length, period)
    rows = np.unique(np.stack([rule[who], start - np.where(rule[who] < 0, 0, lo[who]), end - start, q], axis=1)[held], axis=0)
    rules, places = g.places(LEAST)
    begin, finish = np.searchsorted(rules, rows[:, 0]), np.searchsorted(rules, rows[:, 0], side="right")
    many = np.where(rows[:, 0] < 0, 1, finish - begin)
    each = np.repeat(np.arange(len(rows)), many)
    which = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    base = np.where(rows[each, 0] < 0, 0, places[np.minimum(which, max(len(places) - 1, 0))] if len(places) else 0)
    found = np.unique(np.stack([rows[each, 3], base + rows[each, 1], base + rows[each, 1] + rows[each, 2]], axis=1), axis=0)
    # merge pieces of one period that overlap by a period: ends so far, by period
    best: dict[tuple[int, int], int] = {}
    at_q, s, e = -1, 0, -1
    for q, x, y in [*found.tolist(), (-2, 0, 0)]:
        if q == at_q and x + q <= e:
            e = max(e, y)
            continue
        if at_q > 0:
            if not (words[s : e - at_q] == words[s + at_q : e]).all():
                raise ValueError("two runs of words have one hash")
            best[s, e] = min(at_q, best.get((s, e), at_q))  # an interval counts with its least period
        at_q, s, e = q, x, y
    return [(s, e - s, q) for (s, e), q in sorted(best.items(), key=lambda r: (r[0][0], r[1]))]


def runs_in(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as words, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, total).view(np.uint64)
    zone = repeated(hashes, sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not zone.any():
        return found
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = zone & ~np.concatenate([[False], zone[:-1] & (owner[1:] == owner[:-1])])
    at = np.flatnonzero(zone)
    inside = zip(owner[at].tolist(), (at - begins[owner[at]]).tolist(), strict=True)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(texts[t][i], len(number)) for t, i in inside), np.int64, len(at))
    # each part (zone) is followed by a number of its own
    part = np.cumsum(first[at]) - 1
    n_parts = int(part[-1]) + 1
    words = np.empty(len(at) + n_parts, np.int64)
    origin = np.zeros(len(words), np.int64)
    place = np.arange(len(at)) + part
    words[place], origin[place] = ids, at
    last = np.setdiff1d(np.arange(len(words)), place)
    words[last] = len(number) + np.arange(n_parts)
    parts = np.concatenate([[0], last + 1])
    for s, length, q in runs_of(words, len(number) + n_parts, parts):
        where = int(origin[s])
        found[owner[where]].append((where - int(begins[owner[where]]), length, q))
    return found


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stay).tolist()]


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, rewrite: Rewrite | None = None) -> DataFrame:
    """The columns `keep` of docs(doc_id, text), with `runs` and `collapsed`: a row a row, without a shuffle.

    Words are what stands between ASCII blanks. A run is a stretch of words with a least period q and at
    least LEAST words and TIMES periods that no neighbour goes on with; they come by start, then
    period. `collapsed` is the text (UTF-8) with one blank between words, every run cut to its
    first period. `rewrite` may change the words of a text before. Null, empty and blank texts have no
    words; repeated rows and null ids have a row each; an empty table gives none; a very long
    text takes memory in proportion to its words. Columns of other names are passed on as they are.

    All texts of an Arrow batch have one grammar: of the words that stand in GRAM words which their text
    repeats, as no others can be in a run.
    """
    keep = docs.columns if keep is None else keep
    names = ("runs", "collapsed")
    if {c.lower() for c in keep} & set(names):
        raise ValueError(f"keep must not have columns named {names}")
    raw, number = free_name(docs.columns, "raw"), free_name([*docs.columns, "raw"], "number")

    def made() -> Callable[..., dict[str, list]]:
        def fn(texts: list[bytes | None], ids: list[int | None]) -> dict[str, list]:
            words = [(t or b"").split() for t in texts]  # of bytes: ASCII blanks only
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
            found = runs_in(words)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            return {"runs": rows, "collapsed": [b" ".join(kept(w, r)) for w, r in zip(words, found, strict=True)]}

        return fn

    given = docs.select("*", F.col("text").cast("binary").alias(raw), F.col("doc_id").alias(number))
    return columns_added(given, keep, made, f"runs {RUNS}, collapsed binary", (raw, number))


def repeats_planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of a tenth of the texts the end becomes a repeated passage; which, where and how long follows from the id.

    A null id has no digits: its text stays.
    """
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _best(runs: Column) -> Column:
    """The run with the greatest length per period; runs come by start, then period, and the first of equals stays."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its runs, the strongest of them and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, ["doc_id"], repeats_planted)
    told = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", _best(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of the decimal doc_id in SQL: byte by byte, bit by bit (fixed values: its polynomial and first value).
CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)
  ))"""


def oracle_sql() -> str:
    """Runs as islands of words that equal the word a period later; pairs of equal words up to a third of a text apart."""
    return f"""
with split as (
  select doc_id, {CRC32} as h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents
), sized as (select *, len(words) as n, h // 10 as g from split),
planted as (
  select doc_id, n, words, case when h % 10 = 0 and n > 0 then g % n end as a, 3 + g % 8 as d from sized
), w as (
  select doc_id, i, words[1 + case when i >= a then a + (i - a) % (1 + (n - a) // d) else i end] as word
  from (select *, unnest(range(n)) as i from planted)
), pairs as (
  select x.doc_id, x.i, y.i - x.i as q from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i
  join sized s on s.doc_id = x.doc_id where 3 * (y.i - x.i) <= s.n
), islands as (
  select doc_id, q, min(i) as start, count(*) + q as length
  from (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs)
  group by doc_id, q, island having count(*) + q >= greatest({LEAST}, {TIMES} * q)
), runs as (select doc_id, start, length, min(q) as period from islands group by all),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text from w
  where not exists (select 1 from runs r where r.doc_id = w.doc_id and w.i >= r.start + r.period and w.i < r.start + r.length)
  group by doc_id
), told as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id
), best as (
  select * from runs qualify row_number() over (partition by doc_id order by length::decimal(38, 18) / period desc, start, period) = 1
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d left join told t on t.doc_id = d.doc_id left join best b on b.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""
