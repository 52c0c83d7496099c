"""Removal of repeated passages by sliding spans of consecutive sentences (operator 6)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import WORD, columns_added, free_name, written

#: Sentences end at these signs before white space, at those of scripts without it, or at a line's end.
END = re.compile(r"[.!?…][^\w\s]*\s+|[。！？｡।॥۔؟][^\w\s]*\s*|\n")
#: In scripts without blanks between words every letter counts as a word.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
MIXED_WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
SENTENCES = 3
WORDS = 30
#: Sentences of more than LONG words are cut after words chosen by hash, one in CUT.
LONG = 16
CUT = 8
LAST = (1 << 63) - 1
SPAN = "struct<h:bigint,start:int,end:int>"


def parts_of(text: str) -> list[tuple[int, int, list[str]]]:
    """Bounds (without gaps) and words of a text's sentences, and of the pieces of long ones.

    Where a long sentence is cut depends on the word before the cut alone, so a passage is cut
    in the same places wherever it stands. What has no word goes with the part before it.
    """
    word = MIXED_WORD if HAS_UNSPACED.search(text) else WORD
    out: list[tuple[int, int, list[str]]] = []

    def add(begin: int, end: int, words: list[str]) -> None:
        if out and not (words and out[-1][2]):  # one of the two has no word
            begin, _, before = out.pop()
            words = before or words
        out.append((begin, end, words))

    begin = 0
    ends = [m.end() for m in END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    for end in ends:
        words = word.findall(text[begin:end].lower())
        if len(words) <= LONG:
            add(begin, end, words)
        else:
            held: list[str] = []
            at = begin
            for m in word.finditer(text, begin, end):
                w = m.group().lower()
                if held and zlib.crc32(held[-1].encode("utf-8", "surrogatepass")) % CUT == 0:
                    add(at, m.start(), held)
                    at, held = m.start(), []
                held.append(w)
            add(at, end, held)
        begin = end
    return out


def spans(text: str, sentences: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, int]]:
    """The spans of a text: (hash, start, end), bounds in code points.

    From each part on, a span takes as few parts as give `sentences` parts and `words` words;
    case, signs and white space don't count.
    """
    from xxhash import xxh3_64_intdigest

    parts = parts_of(text)
    sizes = [len(p[2]) for p in parts]
    plain = [" ".join(p[2]).encode("utf-8", "surrogatepass") for p in parts]
    whole = b" ".join(plain)
    begin = [0]
    for p in plain:
        begin.append(begin[-1] + len(p) + 1)
    found, end, held = [], 0, 0
    for i in range(len(parts)):
        while end < len(parts) and (held < words or end - i < sentences):
            held += sizes[end]
            end += 1
        if held < words or end - i < sentences:
            break
        h = xxh3_64_intdigest(whole[begin[i] : begin[end] - 1])
        found.append((h - (1 << 64) if h >> 63 else h, parts[i][0], parts[end - 1][1]))
        held -= sizes[i]
    return found


def merged(bounds: list[dict]) -> list[dict]:
    """Disjoint ascending intervals that cover the given ones."""
    out: list[dict] = []
    for a, b in sorted((x["start"], x["end"]) for x in bounds):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def without(text: str, gone: list[dict]) -> str:
    """The text without these disjoint intervals, and without white space at its end if any went."""
    begins, ends = [0, *(x["end"] for x in gone)], [*(x["start"] for x in gone), len(text)]
    kept = "".join(text[a:b] for a, b in zip(begins, ends, strict=True))
    return kept.rstrip() if gone else kept


def key_of(doc_id: str = "doc_id") -> tuple[Column, Column]:
    """A document is an id and a hash of the text; null ids come last."""
    return F.coalesce(doc_id, F.lit(LAST)), F.xxhash64("text")


def _spans(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """id, tag, first: the first place of each span of a document; again: where it repeats inside."""

    def made() -> Callable[[list], dict[str, list]]:
        def found(texts: list[str | None]) -> dict[str, list]:
            first, again = [], []
            for text in texts:
                seen: dict[int, dict] = {}
                more = []
                for h, start, end in spans(text or "", sentences, words):
                    if h in seen:
                        more.append({"start": start, "end": end})
                    else:
                        seen[h] = {"h": h, "start": start, "end": end}
                first.append(list(seen.values()))
                again.append(more)
            return {"first": first, "again": again}

        return found

    of, tag = key_of()
    keyed = docs.select(of.alias("id"), tag.alias("tag"), "text")
    schema = f"first array<{SPAN}>, again array<struct<start:int,end:int>>"
    return written(columns_added(keyed, ["id", "tag"], made, schema), "spans")


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, name: str = "__removed") -> DataFrame:
    """docs with repeated passages removed from `text`, and column `name`: bounds of what went.

    A span stays in the first document that has it, at its first place there; sentences that any
    other copy of a span covers go. Documents come in the order of doc_id, null ids last; those
    that share an id, null too, in the order of a hash of the text. Rows that repeat id and text
    are one document: all keep or lose the same. Null and empty texts stay as they are, long ones
    are read whole. All other columns of docs, whatever their names but `name`, are kept; n_chars,
    if there is one, is not changed here. An empty table gives no rows.

    Texts are read for spans once; the table of spans holds numbers only. Hashes are counted with
    map-side partial results and the repeated ones written, so that the join with a very common
    one is two plain exchanges, of which AQE splits the large partitions. What is gathered
    per document is bounded by its own spans.
    """
    found = _spans(docs, sentences, words)
    rows = found.select("id", "tag", F.explode("first").alias("s")).select("id", "tag", "s.*")
    counted = rows.groupBy("h").agg(F.min(F.struct("id", "tag")).alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = written(counted.filter("n > 1").select("h", "least"), "repeated")
    hits = rows.join(repeated, "h").filter(F.struct("id", "tag") > F.col("least")).select("id", "tag", "start", "end")
    inner = found.filter(F.size("again") > 0).select("id", "tag", F.explode("again").alias("s")).select("id", "tag", "s.*")
    hits = hits.unionByName(inner).groupBy("id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("gone"))

    of, tag = key_of()
    names = {c: free_name(docs.columns, c) for c in ("id", "tag", "gone")}
    keyed = docs.withColumns({names["id"]: of, names["tag"]: tag})
    joined = keyed.join(hits.select(*[F.col(c).alias(n) for c, n in names.items()]), [names["id"], names["tag"]], "left")
    others = [c for c in docs.columns if c not in ("text", name)]

    def made() -> Callable[[list, list], dict[str, list]]:
        def cut(texts: list[str | None], gone: list[list[dict] | None]) -> dict[str, list]:
            removed = [merged(g or []) for g in gone]
            return {
                "text": [without(t, g) if t else t for t, g in zip(texts, removed, strict=True)],
                name: removed,
            }

        return cut

    schema = f"text string, `{name}` array<struct<start:int,end:int>>"
    return columns_added(joined, others, made, schema, ("text", names["gone"]))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text and the bounds of what was removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = without_repeats(docs, name="removed")
    return found.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"))
