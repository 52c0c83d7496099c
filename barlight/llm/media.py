"""Interleaved text and media of web pages, media being stored apart by digest (operator 10)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import arrow_map, shared_dir, written

WIDTH = 192
#: The elements of HTML that end a run of text, hold none, or refer to media.
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section table td th title tr ul".split()
)
SILENT = frozenset("script style template noscript".split())
MEDIA = frozenset("img audio video source embed".split())
ELEMENT = "struct<position:int,kind:string,text:string,ref:string,caption:string,n_bytes:bigint>"


class Page(HTMLParser):
    """Collects the elements of one page in reading order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.figure: int | None = None  # first element of the open figure
        self.caption: list[str] | None = None

    def end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self._add("text", text=text)

    def _add(self, kind: str, **values: object) -> None:
        empty = {"text": None, "ref": None, "caption": None, "n_bytes": None}
        self.elements.append({"position": len(self.elements), "kind": kind} | empty | values)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in MEDIA:
            found = dict(attrs)
            if ref := found.get("src"):
                self.end_run()
                size = found.get("data-bytes") or ""
                self._add("media", ref=ref, caption=found.get("alt") or None, n_bytes=int(size) if size.isdecimal() else None)
        elif tag in BLOCKS:
            self.end_run()
            if tag == "figure":
                self.figure = len(self.elements)
            elif tag == "figcaption":
                self.caption = []

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for e in self.elements[self.figure if self.figure is not None else -1 :]:
                if e["kind"] == "media" and text:
                    e["caption"] = text
        elif tag in BLOCKS:
            self.end_run()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[dict]:
    """Ordered text and media elements of a page; none for a null or empty one."""
    page = Page()
    page.feed(html or "")
    page.close()
    page.end_run()
    return page.elements


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages(key, html) to (key, sequence): ordered structs of text and media references.

    A figure's caption goes to its media, else their alternative text; scripts and styles are
    left out. A null page has an empty sequence; repeated rows give repeated sequences.
    """
    kind = dict(pages.dtypes)[key]

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        for batch in batches:
            yield {key: batch[key], "sequence": [elements(h) for h in batch["html"]]}

    return arrow_map(pages.select(key, "html"), rows, f"`{key}` {kind}, sequence array<{ELEMENT}>")


def store(items: DataFrame, path: str) -> None:
    """Write items(digest, payload) as grey images (PGM, WIDTH samples a row), one a row.

    A payload's length must be a multiple of WIDTH. Rows that repeat a digest are stored as they
    come; reading drops the repeats after their features are known, when rows are small.
    """
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.length("payload") / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    items.select("digest", F.concat(F.encode(head, "UTF-8"), F.col("payload")).alias("stored")).write.option(
        "compression", "zstd"
    ).parquet(path)


def samples(stored: bytes) -> bytes:
    """The samples of a stored image."""
    magic, size, depth, data = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit grey image")
    return data


def feature(data: bytes) -> str:
    """Sixteen shares of sample values (of 255) and a 64-bit hash of brightness steps, as hex."""
    x = np.frombuffer(data, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 255 // max(len(x), 1)
    edges = np.linspace(0, len(x), 66).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[edges]
    means = np.diff(sums) / np.maximum(np.diff(edges), 1)
    return (np.packbits(np.diff(means) > 0).tobytes() + shares.astype(np.uint8).tobytes()).hex()


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """One row per digest of a media store, computed from the bytes read back.

    Rows that repeat a digest are told once; an empty store gives no rows; a payload that is no
    whole image is an error. The table is written, so that a join with it is of plain exchanges.
    """

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, object]]:
        for batch in batches:
            data = [samples(b) for b in batch["stored"]]
            yield {
                "digest": batch["digest"],
                "payload_bytes": [len(d) for d in data],
                "payload_sha256": [hashlib.sha256(d).hexdigest() for d in data],
                "tail_crc32": [zlib.crc32(d[-16:]) for d in data],
                "media_bytes": [len(b) for b in batch["stored"]],
                "media_sha256": [hashlib.sha256(b).hexdigest() for b in batch["stored"]],
                "feature": [feature(d) for d in data],
            }

    schema = (
        "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return written(arrow_map(spark.read.parquet(path), rows, schema).dropDuplicates(["digest"]), "resolved")


def interleaved(sequences: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """A row per media reference (`sha256:` digests) with its position, caption and resolved media.

    References that nothing resolves stay, with null media columns; pages without references,
    null ones too, have no rows; repeated pages and references, and null keys, have rows each;
    empty tables give none. The digest of one very common item is a skewed join key of small
    rows, which AQE splits.
    """
    items = F.size("sequence").alias("n_items")
    refs = sequences.select(F.col(key), items, F.explode(F.filter("sequence", lambda e: e["kind"] == "media")).alias("e"))
    refs = refs.select(
        key,
        "n_items",
        F.col("e.position").alias("position"),
        F.col("e.caption").alias("caption"),
        F.col("e.n_bytes").alias("n_bytes"),
        F.regexp_replace("e.ref", "^sha256:", "").alias("digest"),
    )
    return refs.join(media, "digest", "left")


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text and blanks up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    blanks = F.greatest(F.ceil(size / WIDTH), F.lit(1)) * WIDTH - size
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), blanks.cast("int")), "UTF-8"))


def pages_of(docs: DataFrame) -> DataFrame:
    """A page per document: its lines as paragraphs and its bytes as a figure's image."""
    text = F.coalesce("text", F.lit(""))
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    paragraphs = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    figure = F.format_string(
        '<figure><img src="sha256:%s" data-bytes="%d"><figcaption>%d bytes of text</figcaption></figure>',
        F.sha2(payload_of(F.col("text")), 256),
        F.octet_length(text),
        F.octet_length(text),
    )
    return docs.select("doc_id", F.concat(F.lit("<article>"), paragraphs, figure, F.lit("</article>")).alias("html"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image and resolved from its page; a row per document.

    Null texts are empty ones; repeated rows and null ids have a row each; equal texts have equal
    values; an empty table gives no rows; other columns aren't read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark, "media")
    payload = payload_of(F.col("text"))
    store(docs.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")), path)
    found = interleaved(sequences(pages_of(docs), "doc_id"), resolved(spark, path), "doc_id")
    return found.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "position",
        "caption",
        "n_items",
    )
