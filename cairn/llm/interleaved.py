"""Interleaved document sequences with media resolved by digest (operator 4).

`media_store` keeps payloads as media: rows of 64 RGB pixels of 8-bit samples behind a binary portable-pixmap header, so
192 payload bytes are one row of pixels and nothing is lost; the header's comment holds the bytes before padding, and a
media's name is the SHA-256 of these. `sequences` parses HTML into ordered structs of text and media references, with the
caption of each reference at its place. `resolve` joins references and media by digest: one row of the media for each
digest, positions and captions untouched. `assembled` brings the parts of each page together as one array of structs.

Cases: a null text or HTML is the empty one; empty payloads are padded to one row of pixels; a reference without a stored
payload stays, with null media columns; very long texts are one part, in a batch with few others; rows that share an id, null ones
too, are pages of their own; repeated rows and ties give rows of their own, since the join has one media row for each digest; an
empty table gives an empty table; other columns are not read. Text outside elements is text; the content of script and
style is dropped. A digest that many references share makes a skewed join; media are stored before it, so Spark splits it.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_map, discard, documents, stored

ROW = 192  # bytes: 64 pixels of three samples
SCHEME = "media:"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and the bytes before padding."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw)), len(raw)


def encode_media(payload: bytes, n_bytes: int) -> bytes:
    """A pixmap of a padded payload; n_bytes: how many of its bytes are not padding."""
    if not payload or len(payload) % ROW or not 0 <= n_bytes <= len(payload):
        raise ValueError(f"a payload is a positive multiple of {ROW} bytes")
    return b"P6\n# %d bytes\n%d %d\n255\n" % (n_bytes, ROW // 3, len(payload) // ROW) + payload


def decode_media(media: bytes) -> tuple[np.ndarray, int]:
    """The pixels, rows x 64 x 3 samples, and the bytes before padding."""
    kind, said, size, depth, samples = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if kind != b"P6" or depth != b"255" or len(samples) != width * height * 3 or not said.startswith(b"# "):
        raise ValueError("not a pixmap of 8-bit samples")
    return np.frombuffer(samples, np.uint8).reshape(height, width, 3), int(said.split()[1])


def feature_of(pixels: np.ndarray) -> str:
    """Size, mean of each channel, entropy of all samples and mean change between neighbours in a row of pixels."""
    counts = np.bincount(pixels.reshape(-1), minlength=256)
    share = counts[counts > 0] / pixels.size
    means = " ".join(f"{x:.4f}" for x in pixels.reshape(-1, 3).mean(0))
    change = np.abs(np.diff(pixels.astype(np.int16), axis=1)).mean()
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean {means} entropy {abs(float(-(share * np.log2(share)).sum())):.4f} change {change:.4f}"


class _Sequence(HTMLParser):
    """Ordered parts: (kind, text, digest, caption). The caption is the figure's, or else the reference's alt text."""

    SKIP, BLOCK = {"script", "style"}, {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "article", "figure", "figcaption", "section", "tr", "table", "ul", "ol", "body", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.text, self.skip = [], [], 0
        self.caption = self.figure = self.figure_caption = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.parts.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.figure, self.figure_caption = len(self.parts), None
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag == "img":
            self.flush()
            named = dict(attrs)
            source = named.get("src") or ""
            digest = source[len(SCHEME) :].lower() if source.startswith(SCHEME) else hashlib.sha256(source.encode()).hexdigest()
            inside = None if self.figure is None else self.figure_caption
            self.parts.append(["media", None, digest, named.get("alt") if inside is None else inside])

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            self.figure_caption = caption
            for part in self.parts[self.figure :]:
                if part[0] == "media":
                    part[3] = caption
        if tag == "figure":
            self.figure = None
        if tag in self.BLOCK:
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(source: str | None) -> list[list]:
    parser = _Sequence()
    parser.feed(source or "")
    parser.close()
    parser.flush()
    return parser.parts


def sequences(pages: DataFrame, id_column: str, html_column: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """A row for each part: id, position (from 0), kind (text or media), text, digest, caption, and kept columns (long) of its page."""
    names = ["id", "position", "kind", "text", "digest", "caption", *kept]

    def step(columns: dict) -> dict:
        out: dict = {n: [] for n in names}
        for row_id, source, *rest in zip(columns["id"], columns["html"], *(columns[c] for c in kept), strict=True):
            for position, part in enumerate(parse_sequence(source)):
                for n, v in zip(names, (row_id, position, *part, *rest), strict=True):
                    out[n].append(v)
        return out

    source = pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).alias("html"), *kept)
    schema = "id long, position int, kind string, text string, digest string, caption string" + "".join(f", {c} long" for c in kept)
    return arrow_map(source, lambda: step, schema, names, 64)


def media_store(texts: DataFrame) -> DataFrame:
    """digest, media (the stored form) of every row of texts (text); repeated payloads repeat until `resolve`."""

    def step(columns: dict) -> dict:
        digests = [hashlib.sha256((text or "").encode()).hexdigest() for text in columns["text"]]
        return {"digest": digests, "media": [encode_media(*payload_of(text)) for text in columns["text"]]}

    return arrow_map(texts.select("text"), lambda: step, "digest string, media binary", ["digest", "media"], 64)


def media_features(store: DataFrame) -> DataFrame:
    """What the stored bytes, read back, say; no payload leaves the task that reads it."""
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def step(columns: dict) -> dict:
        out: dict = {n: [] for n in names}
        for digest, media in zip(columns["digest"], columns["media"], strict=True):
            pixels, n_bytes = decode_media(media)
            payload = pixels.tobytes()
            row = (digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pixels))
            for n, v in zip(names, row, strict=True):
                out[n].append(v)
        return out

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(store, lambda: step, schema, names, 64)


def one_of_each(media: DataFrame) -> DataFrame:
    """media with one row, the least, for each digest."""
    rest = [c for c in media.columns if c != "digest"]
    return media.groupBy("digest").agg(F.min(F.struct(*rest)).alias("m")).select("digest", *(F.col(f"m.{c}") for c in rest))


def resolve(parts: DataFrame, media: DataFrame) -> DataFrame:
    """parts with the media columns of their digest. media may repeat a digest, with other columns equal or not."""
    return parts.join(one_of_each(media), "digest", "left")


def assembled(parts: DataFrame, media: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, sequence: the parts of each id in order, as structs with the media columns of their digests (null for
    text). parts and media are stored tables, media with one row for each digest; only references are joined, and texts
    travel once."""
    rest = [c for c in media.columns if c != "digest"]
    references = parts.where("kind = 'media'").join(media, "digest", "left").select(*parts.columns, *rest)
    texts = parts.where("kind <> 'media'").select(*parts.columns, *(F.lit(None).cast(media.schema[c].dataType).alias(c) for c in rest))
    part = [c for c in parts.columns if c not in ("id", "position", *kept)]
    return references.union(texts).groupBy("id", *kept).agg(F.array_sort(F.collect_list(F.struct("position", *part, *rest))).alias("sequence"))


def escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def page_of_document(doc_id, text, source):
    """A document as a page: its source as a captioned reference, the first half of its text (to a blank), its payload as a captioned
    reference, the rest of its text."""
    text, source = F.coalesce(text, F.lit("")), F.coalesce(source, F.lit(""))
    middle = F.floor(F.char_length(text) / 2).cast("int")
    blank = F.call_function("locate", F.lit(" "), text, middle + 1)
    at = F.when(blank > 0, blank).otherwise(F.char_length(text))
    figure = lambda of, what, caption: F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(of, 256), F.lit(f'" alt="{what}"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    paragraph = lambda part: F.concat(F.lit("<p>"), escaped(part), F.lit("</p>"))
    first, rest = F.substr(text, F.lit(1), at), F.substr(text, at + 1)
    named = F.concat(F.lit("document "), F.coalesce(doc_id.cast("string"), F.lit("without id")))
    return F.concat(F.lit("<article>"), figure(source, "source", F.concat(F.lit("source "), escaped(source))), paragraph(first), figure(text, "payload", named), paragraph(rest), F.lit("</article>"))


def document_sequences(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, sequence: every document as a page with its text around two references, resolved. The last reference is the
    document's own payload. digests: structs have text_chars and text_crc32 in place of text, which then stays where it is parsed."""
    texts = docs.select("text").union(docs.groupBy("source").count().select("source"))
    store = stored(media_store(texts), "media")
    media = stored(one_of_each(media_features(store)), "features")
    discard(store)
    pages = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), page_of_document(F.col("doc_id"), F.col("text"), F.col("source")).alias("html"))
    parts = sequences(pages, "row", "html", ("doc_id",))
    if digests:
        told = F.char_length("text").cast("long").alias("text_chars"), F.crc32("text").alias("text_crc32")
        parts = parts.select("id", "position", "kind", *told, "digest", "caption", "doc_id")
    parts = stored(parts, "parts")  # a row keeps its number once it is stored
    return assembled(parts, media, ("doc_id",)).select("doc_id", "sequence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequence, its texts as digests, and what the store says of the payload that its last reference names."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = document_sequences(documents(spark, sf_dir), digests=True)
    own = F.element_at(F.filter("sequence", lambda part: part["kind"] == "media"), -1)
    return rows.select("doc_id", *(own[n].alias(n) for n in names), "sequence")
