"""What a file is, by its content first; and its text, for the formats that need no library."""

from __future__ import annotations

import bz2
import csv
import email
import email.policy
import gzip
import html
import io
import json
import lzma
import re
import sqlite3
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

#: Leading bytes that tell formats.
MAGIC = [
    (b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"),
    (b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\x1f\x8b", "gzip"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"Rar!\x1a\x07", "rar"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"),
    (b"SQLite format 3\x00", "sqlite"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole"), (b"{\\rtf", "rtf"), (b"ID3", "mp3"), (b"OggS", "ogg"), (b"fLaC", "flac"), (b"RIFF", "riff"),
    (b"PAR1", "parquet"), (b"!BDN", "pst"),
]
FAMILIES = {
    "pdf": "document", "docx": "document", "odt": "document", "rtf": "document", "xlsx": "spreadsheet", "ods": "spreadsheet", "csv": "spreadsheet", "pptx": "presentation", "odp": "presentation",
    "json": "data", "xml": "data", "sqlite": "database", "parquet": "database", "html": "web", "eml": "mail", "mbox": "mail", "pst": "mail", "ics": "calendar", "text": "text", "epub": "book",
    "zip": "archive", "tar": "archive", "gzip": "archive", "7z": "archive", "rar": "archive", "bzip2": "archive", "xz": "archive",
    "png": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tiff": "image", "mp3": "audio", "ogg": "audio", "flac": "audio", "riff": "media", "ole": "legacy",
}
#: Limits under which archives are opened.
MAX_DEPTH, MAX_FILES, MAX_BYTES, MAX_RATIO = 8, 10_000, 2 << 30, 500


@dataclass(frozen=True)
class Format:
    """The kind, its family, and whether the file's extension says otherwise."""

    kind: str
    family: str
    mismatch: bool


def _zip_kind(data: bytes) -> str:
    try:
        names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    except zipfile.BadZipFile:
        return "zip"
    for entry, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")):
        if entry in names:
            return kind
    if "mimetype" in names:
        told = zipfile.ZipFile(io.BytesIO(data)).read("mimetype").decode("ascii", "replace")
        for end, kind in (("opendocument.text", "odt"), ("opendocument.spreadsheet", "ods"), ("opendocument.presentation", "odp"), ("epub+zip", "epub")):
            if told.strip().endswith(end):
                return kind
    return "zip"


def identify(data: bytes, name: str = "") -> Format:
    """The format by content; the extension only tells texts apart."""
    kind = next((k for magic, k in MAGIC if data.startswith(magic)), "")
    if kind == "zip":
        kind = _zip_kind(data)
    elif not kind and data[257:262] == b"ustar":
        kind = "tar"
    ending = name.rpartition(".")[2].lower() if "." in name else ""
    if not kind:
        kind = _text_kind(data, ending)
    alias = {"htm": "html", "txt": "text", "md": "text", "log": "text", "jpg": "jpeg", "tif": "tiff", "gz": "gzip", "db": "sqlite", "tgz": "gzip", "wav": "riff", "avi": "riff"}
    told = alias.get(ending, ending)
    return Format(kind, FAMILIES.get(kind, "unknown"), bool(told) and told in FAMILIES and told != kind)


def _text_kind(data: bytes, ending: str) -> str:
    head = data[:4096]
    if b"\x00" in head and not head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "binary"
    text = decode(head).lstrip()
    low = text[:512].lower()
    if low.startswith(("<!doctype html", "<html")) or "<html" in low:
        return "html"
    if low.startswith("<?xml") or re.match(r"<[a-z][\w:.-]*[\s>/]", low):
        return "xml"
    if low.startswith("begin:vcalendar"):
        return "ics"
    if text.startswith("From ") and "\nSubject:" in text:
        return "mbox"
    if re.match(r"(?:[A-Za-z-]+:.*\r?\n)+", text) and re.search(r"(?m)^(From|Subject|Message-ID):", text):
        return "eml"
    if text[:1] in "{[" and text:
        return "json"
    return ending if ending in ("csv", "json", "xml", "ics", "eml", "mbox") else "text"


def decode(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8, else Latin-1, which never fails."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as wrong:
        if wrong.start >= len(data) - 3:  # a character cut at the end of a sample
            return data[: wrong.start].decode("utf-8")
        return data.decode("latin-1")


def _plain_html(text: str) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", text)
    text = re.sub(r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n", text)
    return html.unescape(re.sub(r"<[^>]+>", "", text))


def _table(data: bytes) -> str:
    """Rows of delimited text, cells parted by tabs; the delimiter is told from a sample."""
    text = decode(data)
    try:
        dialect = csv.Sniffer().sniff(text[:8192], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    return "\n".join("\t".join(r) for r in csv.reader(io.StringIO(text), dialect))


def _xml_text(data: bytes) -> str:
    return "\n".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _flow(element: ElementTree.Element, breaks: frozenset[str], only: frozenset[str] | None) -> Iterator[str]:
    """The text of an element in document order, what follows its children too; a line ends
    behind each element of ``breaks``. ``only``: elements whose own text counts, else all."""
    name = _local(element)
    if name in ("script", "style", "head", "instrText", "delText"):
        return
    if element.text and (only is None or name in only):
        yield element.text
    for child in element:
        if _local(child) in ("tab", "s"):
            yield "\t" if _local(child) == "tab" else " " * int(next((v for k, v in child.attrib.items() if k.endswith("}c")), 1))
        elif _local(child) in ("br", "cr", "line-break"):
            yield "\n"
        yield from _flow(child, breaks, only)
        if child.tail and (only is None or name in only):
            yield child.tail
    if name in breaks:
        yield "\n"


def _parts(z: zipfile.ZipFile, wanted: str) -> list[str]:
    """Members that match, in the order of their numbers."""
    return sorted((n for n in z.namelist() if re.fullmatch(wanted, n)), key=lambda n: (len(n), n))


def _office(data: bytes, wanted: str, breaks: str, only: str | None = None) -> str:
    """The running text of an office file's or e-book's parts."""
    kept = frozenset(only.split()) if only else None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = ["".join(_flow(ElementTree.fromstring(_limited(z, n)), frozenset(breaks.split()), kept)) for n in _parts(z, wanted)]
    return re.sub(r"[ \t]*\n\s*", "\n", "\n".join(pages)).strip()


def _sheet(data: bytes) -> str:
    """Rows of a workbook's sheets, cells parted by tabs in their columns: shared and inline
    strings, truth values, numbers and formulas' last values."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        of = lambda element, name: [x for x in element.iter() if _local(x) == name]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in of(si, "t")) for si in of(ElementTree.fromstring(_limited(z, "xl/sharedStrings.xml")), "si")]
        for name in _parts(z, r"xl/worksheets/sheet\d+\.xml"):
            for row in of(ElementTree.fromstring(_limited(z, name)), "row"):
                cells: list[str] = []
                for c in of(row, "c"):
                    column = column_number(re.sub(r"\d", "", c.get("r", ""))) or len(cells) + 1
                    cells += [""] * (column - 1 - len(cells))
                    value = "".join(v.text or "" for v in of(c, "v"))
                    kind = c.get("t", "n")
                    if kind == "s":
                        value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in of(c, "t"))
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    cells.append(value)
                out.append("\t".join(cells).rstrip("\t"))
    return "\n".join(x for x in out if x)


def column_letter(number: int) -> str:
    """A spreadsheet column's name: 1 is A, 27 is AA."""
    name = ""
    while number > 0:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def column_number(name: str) -> int:
    """The reverse of ``column_letter``; 0 for no letters."""
    out = 0
    for c in name.upper():
        out = 26 * out + ord(c) - 64
    return out


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    """A literal PDF string without its parentheses, escapes undone."""
    put = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
    data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", put, raw, flags=re.S)
    return data.decode("utf-16", "replace") if data.startswith((b"\xfe\xff", b"\xff\xfe")) else data.decode("cp1252", "replace")


def _pdf(data: bytes) -> str:
    """The text layer of a PDF with plain or deflated content streams and simple encodings.

    Encrypted files, and those whose pages show glyph numbers only, fail: that they have no
    readable text layer isn't an empty text.
    """
    if re.search(rb"/Encrypt\s", data):
        raise ValueError("encrypted")
    out, shown = [], 0
    if b"endstream" not in data:
        raise ValueError("no content")
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body, MAX_BYTES)
        except zlib.error:
            if b"/Filter" in data[max(0, m.start() - 300) : m.start()].rpartition(b"obj")[2]:
                continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            for piece in re.finditer(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<([0-9A-Fa-f\s]+)>|(-?\d+(?:\.\d+)?)(?=[^\[\]]*\]\s*TJ)|\b(T\*|(?:Td|TD|Tm)\b)|(')", block, re.S):
                token = piece[0]
                if token.startswith(b"("):
                    out.append(_pdf_string(token[1:-1]))
                    shown += 1
                elif piece[1]:
                    shown += 1
                elif piece[2]:
                    if float(piece[2]) < -180:  # a wide step back between glyphs stands for a space
                        out.append(" ")
                elif out and not out[-1].endswith("\n"):
                    out.append("\n")
            out.append("\n")
    text = re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()
    if shown and not text:
        raise ValueError("the text layer has glyph numbers only")
    return text


def _mail(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(preferencelist=("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_subtype() == "html":
        text = _plain_html(text)
    head = "\n".join(f"{k}: {m[k]}" for k in ("From", "To", "Date", "Subject") if m[k])
    return f"{head}\n\n{text}".strip()


def _calendar(text: str) -> str:
    lines = re.sub(r"\r?\n[ \t]", "", text).splitlines()
    return "\n".join(x for x in lines if x.partition(":")[0].partition(";")[0] in ("SUMMARY", "DESCRIPTION", "LOCATION", "DTSTART", "DTEND"))


def _rtf(text: str) -> str:
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|{[^{}]*})*}", "", text)
    return re.sub(r"\\par[d]?\b ?", "\n", text).translate({123: None, 125: None}) if "\\" not in text else re.sub(r"[{}]|\\[a-z]+-?\d* ?", "", re.sub(r"\\par\b ?", "\n", text)).strip()


def _database(data: bytes, rows: int = 20) -> str:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    out = []
    for name, sql in con.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' ORDER BY name"):
        out.append(sql)
        quoted = name.replace('"', '""')
        out += ["\t".join(map(str, r)) for r in con.execute(f'SELECT * FROM "{quoted}" LIMIT {rows}')]
    return "\n".join(out)


READERS: dict[str, Callable[[bytes], str]] = {
    "text": decode, "csv": _table,
    "json": lambda d: json.dumps(json.loads(decode(d)), ensure_ascii=False, indent=1), "xml": _xml_text, "html": lambda d: _plain_html(decode(d)),
    "eml": _mail, "ics": lambda d: _calendar(decode(d)), "rtf": lambda d: _rtf(decode(d)), "sqlite": _database,
    "docx": lambda d: _office(d, r"word/(document|footnotes|endnotes|header\d*|footer\d*)\.xml", "p", "t"), "xlsx": _sheet,
    "pptx": lambda d: _office(d, r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", "p", "t"), "odt": lambda d: _office(d, r"content\.xml", "p h"),
    "ods": lambda d: _office(d, r"content\.xml", "p table-row"), "odp": lambda d: _office(d, r"content\.xml", "p"), "pdf": _pdf,
    "epub": lambda d: _office(d, r".*\.x?html?", "p h1 h2 h3 h4 h5 h6 li div tr blockquote title"),
}


class UnsafeArchive(ValueError):
    """An archive beyond the limits, or with names that leave its folder."""


@dataclass
class Budget:
    """What may still be unpacked, over all levels of one file."""

    files: int = MAX_FILES
    bytes: int = MAX_BYTES

    def take(self, size: int) -> None:
        self.files, self.bytes = self.files - 1, self.bytes - size
        if self.files < 0 or self.bytes < 0:
            raise UnsafeArchive("too many files or too large")


def _limited(z: zipfile.ZipFile, name: str, most: int = MAX_BYTES) -> bytes:
    """A member's content; what it really holds is bounded, whatever its header says."""
    with z.open(name) as f:
        out = f.read(most + 1)
    if len(out) > most or len(out) > MAX_RATIO * max(1024, z.getinfo(name).compress_size):
        raise UnsafeArchive("too large or packed too tightly")
    return out


def members(data: bytes, kind: str, name: str = "", budget: Budget | None = None) -> Iterator[tuple[str, bytes]]:
    """An archive's files, name and content, within the budget."""
    budget = Budget() if budget is None else budget

    def checked(path: str, content: bytes) -> tuple[str, bytes]:
        if path.startswith("/") or ".." in path.replace("\\", "/").split("/"):
            raise UnsafeArchive(f"{path!r} leaves the archive")
        budget.take(len(content))
        return path, content

    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield checked(info.filename, _limited(z, info.filename, budget.bytes))
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    yield checked(info.name, t.extractfile(info).read(budget.bytes + 1))
    else:
        with {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}[kind](io.BytesIO(data)) as g:
            inner = g.read(min(budget.bytes, MAX_RATIO * max(1024, len(data))) + 1)
        if len(inner) > MAX_RATIO * max(1024, len(data)):
            raise UnsafeArchive("packed too tightly")
        yield checked(re.sub(r"\.(gz|bz2|xz)$", "", name) or "content", inner)


def read(data: bytes, name: str, depth: int = 0, budget: Budget | None = None) -> Iterator[tuple[str, str, str, str]]:
    """Path, kind, status and text of a file, and of what an archive or mailbox holds.

    Status: complete, unsupported, or failed with the reason; a failure isn't an empty text.
    """
    found, budget = identify(data, name), Budget() if budget is None else budget
    try:
        if found.family == "archive" and found.kind in ("zip", "tar", "gzip", "bzip2", "xz"):
            if depth >= MAX_DEPTH:
                raise UnsafeArchive("nested too deeply")
            yield name, found.kind, "complete", ""
            for inner, content in members(data, found.kind, name.rpartition("/")[2], budget):
                yield from read(content, f"{name}::{inner}", depth + 1, budget)
        elif found.kind == "mbox":
            for i, part in enumerate(re.split(rb"(?m)^From .*\r?\n", data)[1:]):
                yield f"{name}::{i}", "eml", "complete", _mail(part)
        elif found.kind in READERS:
            yield name, found.kind, "complete", READERS[found.kind](data)
        else:
            yield name, found.kind, "unsupported", ""
    except Exception as wrong:  # one bad file mustn't end the scan; the reason is kept as its status
        yield name, found.kind, f"failed: {type(wrong).__name__}: {wrong}"[:300], ""
