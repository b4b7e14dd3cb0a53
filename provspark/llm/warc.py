"""WARC derivatives: each HTTP response gives a metadata record and a plain-text conversion record that point back to it.

Records are rows (see RECORD); `to_bytes` and `read_records` are their WARC/1.1 form. A derivative carries WARC-Refers-To (the response's id), the response's target URI and date,
and keeps the response's own headers and payload digest: the metadata record inside its JSON block, the conversion record as WARC-Source-* headers, so that either
can be traced without the response. Ids are made from what they name, so reruns agree.

Text: tags split lines where they end a block; scripts, styles, templates, comments and everything in the head but the title are left out, nothing else; the head ends
at </head> or at the first tag or text that can't stand in one; the content of a textarea is text as it is; character references are read; white space is collapsed within
lines and empty lines dropped. The title of a drawing is text, and not the page's title.

Defined results: a null html is an empty payload; its conversion has an empty block; a null url gives an empty target URI; rows that repeat each other give records
with the same ids; other columns are ignored; no rows give no rows. Unclosed comments and scripts reach to the end of the page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_arrow

#: Date of responses whose source gives none.
DATE = "1970-01-01T00:00:00Z"
SOFTWARE = "provspark-derivatives/1"
RECORD = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, headers map<string,string>, "
    "content_length long, block_digest string, payload_digest string, block binary"
)
NAMES = re.findall(r"(\w+) \w+(?:<[^>]*>)?(?:, |$)", RECORD)
KINDS = [pa.int64(), *[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.string(), pa.binary()]
#: Elements that end a line, and elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
SILENT = frozenset("script style template".split())
#: Elements that may begin in a head.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src", "embed": "src", "form": "action"}
_NAME_END = re.compile(r"[\s/>]")
_MARKS = re.compile("[>\"']")
_AREA_END = re.compile(r"</textarea\s*>", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the customary WARC label


def record_id(*parts: object) -> str:
    h = hashlib.sha256("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}>"


class Tags:
    """Where the tags of a page end, in time that grows with the page and no faster, however many tags are never closed.

    A tag ends at the first `>` behind its name that no pair of quotes encloses. Which one that is depends on the first mark (`>` or a quote) only, so what one unclosed
    tag has found out holds for all that come to the same marks.
    """

    def __init__(self, page: str):
        self.page, self.last, self.name_end = page, page.rfind(">"), -1
        self.marks: list[int] | None = None
        self.quotes: dict[str, list[int]] = {}
        self.ends: dict[int, int] = {}

    def at(self, lt: int) -> tuple[bool, str, int, int] | None:
        """(closing, name, where its attributes begin, where its `>` stands) of the tag at a `<`, or None for a stray one."""
        page, closing = self.page, self.page.startswith("/", lt + 1)
        start = lt + 1 + closing
        if lt > self.last or not (page[start : start + 1].isascii() and page[start : start + 1].isalpha()):
            return None
        if self.name_end <= start:
            m = _NAME_END.search(page, start)
            self.name_end = m.start() if m else len(page)
        gt = self._end(self.name_end)
        return None if gt < 0 else (closing, page[start : self.name_end].lower(), self.name_end, gt)

    def _end(self, behind: int) -> int:
        if self.marks is None:
            self.marks = [m.start() for m in _MARKS.finditer(self.page)]
            self.quotes = {q: [i for i in self.marks if self.page[i] == q] for q in "\"'"}
        path, found = [], -1
        k = bisect_left(self.marks, behind)
        while k < len(self.marks):
            mark = self.marks[k]
            if mark in self.ends:
                found = self.ends[mark]
                break
            path.append(mark)
            if self.page[mark] == ">":
                found = mark
                break
            same = self.quotes[self.page[mark]]
            close = bisect_left(same, mark + 1)
            if close == len(same):
                break
            k = bisect_left(self.marks, same[close] + 1)
        self.ends.update(dict.fromkeys(path, found))
        return found


def read_page(page: str, base: str = "") -> tuple[str, str, list[tuple[str, str]], list[tuple[str, str]]]:
    """(text, title, [(element@attribute, absolute url)], [(meta name, content)]) in one pass from left to right."""
    at, out, title, links, metas = 0, [], [], [], []
    in_head = in_title = False
    drawings, tags = 0, Tags(page)
    while at < len(page):
        lt = page.find("<", at)
        data = page[at : lt if lt >= 0 else len(page)]
        if data:
            if in_title:
                title.append(data)
            elif data.strip():
                in_head = False
            if in_title or not in_head:
                out.append(data.replace("\n", " "))
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else len(page)
            continue
        tag = tags.at(lt)
        if not tag:
            in_head = in_head and in_title
            out.append("<")
            at = lt + 1
            continue
        closing, name, begun, gt = tag
        at, empty = gt + 1, page[gt - 1] == "/" and gt > begun
        if name in BLOCKS:
            out.append("\n")
        if name == "head":
            in_head = not closing
        elif name == "title" and not drawings:
            in_title = not closing
        elif name == "svg" and not empty:
            drawings = max(0, drawings + (-1 if closing else 1))
        if name == "body" or not (closing or in_title or name in HEAD):
            in_head = False
        if closing:
            continue
        if name in LINKS or name == "meta":
            attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(page, begun, gt)}
            if name == "meta":
                if label := attrs.get("name") or attrs.get("property"):
                    metas.append((label, attrs.get("content", "")))
            elif url := attrs.get(LINKS[name], "").strip():
                try:
                    url = urljoin(base, url)
                except ValueError:
                    pass
                links.append((f"{name}@{LINKS[name]}", url))
        if name in SILENT and not empty:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name == "textarea":
            end = _AREA_END.search(page, at)
            out.append(page[at : end.start() if end else len(page)].replace("\n", " "))
            at = end.end() if end else len(page)
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(html.unescape("".join(title)).split()), links, metas


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html), one a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = (page or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                paid = digest(payload)
                rows.append((page_id, "response", record_id("response", page_id, url, paid), None, url or "", DATE, "application/http; msgtype=response", [], len(head) + len(payload), digest(head + payload), paid, head + payload))
            yield _batch(rows)

    return in_arrow(pages.selectExpr("cast(page_id as long) page_id", "url", "html"), work, RECORD)


def derive(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response record; other records are left out. One pass, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows += derivatives(r)
            yield _batch(rows)

    return in_arrow(source.filter("warc_type = 'response'").select(*NAMES), work, RECORD)


def derivatives(r: dict) -> list[tuple]:
    head, _, payload = (r["block"] or b"").partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = dict(x.partition(":")[::2] for x in lines if ":" in x)
    http = {k.strip(): v.strip() for k, v in http.items()}
    kind = http.get("Content-Type", "")
    charset = kind.partition("charset=")[2].split(";")[0].strip() or "utf-8"
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    is_html = kind.split(";")[0].strip().lower() in ("text/html", "application/xhtml+xml")
    text, title, links, metas = read_page(page, r["target_uri"]) if is_html else (page if kind.startswith("text/") else "", "", [], [])
    envelope = {
        "WARC-Record-ID": r["record_id"], "WARC-Type": r["warc_type"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["warc_date"], "Content-Type": r["content_type"],
        "Content-Length": r["content_length"], "WARC-Block-Digest": r["block_digest"], "WARC-Payload-Digest": r["payload_digest"], **dict(r["headers"] or []),
    }
    page_data = {"Title": title, "Metas": [{"name": n, "content": c} for n, c in metas], "Links": [{"path": p, "url": u} for p, u in links]}
    meta = {"Envelope": envelope, "HTTP-Response": {"Status": status, "Headers": http, "Payload-Length": len(payload)}, "HTML": page_data}
    came = [("WARC-Source-Content-Type", kind), ("WARC-Source-Content-Length", str(r["content_length"])), ("WARC-Source-Block-Digest", r["block_digest"]), ("WARC-Source-Payload-Digest", r["payload_digest"]), ("WARC-Source-Status", status)]
    came += [("Software", SOFTWARE)]
    out = []
    for warc_type, content_type, block in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"))):
        out.append((r["page_id"], warc_type, record_id(warc_type, r["record_id"]), r["record_id"], r["target_uri"], r["warc_date"], content_type, came, len(block), digest(block), r["payload_digest"], block))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(KINDS), KINDS, strict=True)], NAMES)


def to_bytes(r: dict) -> bytes:
    """A record in WARC/1.1."""
    fields = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["warc_date"]), ("Content-Type", r["content_type"]), ("WARC-Block-Digest", r["block_digest"])]
    if r["warc_type"] == "response":
        fields.append(("WARC-Payload-Digest", r["payload_digest"]))
    fields += [*sorted(dict(r["headers"] or []).items()), ("Content-Length", r["content_length"])]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v not in (None, "")) + "\r\n"
    return head.encode() + r["block"] + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file's bytes, plain or gzipped by record."""
    f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            fields[k] = v
        block = f.read(int(fields["Content-Length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends with two line breaks")
        yield {"fields": fields, "block": block}


def packed(records: DataFrame) -> DataFrame:
    """(page_id, warc_type, member): each record as a gzip member of its own; members in a row make a .warc.gz file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = [gzip.compress(to_bytes(r), mtime=0) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(members, pa.binary())], ["page_id", "warc_type", "member"])

    return in_arrow(records.select(*NAMES), work, "page_id long, warc_type string, member binary")


def derivative_rows(pages: DataFrame) -> DataFrame:
    """The derivatives of pages with their blocks as text and their further headers as JSON."""
    out = derive(responses(pages))
    return out.withColumns({"headers": F.to_json("headers"), "block": F.col("block").cast("string")})
