"""Text out of files: plain, HTML, RTF, DOCX, EPUB; external tools where present."""

from __future__ import annotations

import html
import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

TEXT_SUFFIXES = (".txt", ".text", ".md", ".markdown", ".rst", ".adoc", ".asciidoc")
HTML_SUFFIXES = (".html", ".htm", ".xhtml")
EBOOK_SUFFIXES = (".mobi", ".azw", ".azw3")
SUFFIXES = (".pdf", ".epub", ".docx", ".rtf", *TEXT_SUFFIXES, *HTML_SUFFIXES, *EBOOK_SUFFIXES)
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


class ExtractionError(ValueError):
    """A file can't be read as what it claims to be."""


def sniff(data: bytes, suffix: str) -> str:
    """The suffix, or for unknown ones the format that the first bytes show."""
    if suffix in SUFFIXES:
        return suffix
    if data.startswith(b"%PDF"):
        return ".pdf"
    if data.startswith(b"PK"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
                if "mimetype" in names and b"epub" in z.read("mimetype"):
                    return ".epub"
                if "word/document.xml" in names:
                    return ".docx"
        except zipfile.BadZipFile:
            pass
    raise ExtractionError(f"unsupported format: {suffix or 'none'}")


def decode(data: bytes) -> str:
    """By byte order mark (32 before 16 bits), else UTF-8, Windows-1252, Latin-1."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data.decode(name)
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


_HIDDEN = {"head", "script", "style"}
_CELLS = {"td", "th"}
_BLOCKS = set(
    "p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr pre blockquote section article aside nav main header footer hgroup figure figcaption form fieldset details address".split()
)


class _Blocks(HTMLParser):
    """Text with a line break between blocks and a tab between cells.  A break is
    held back until text follows; a line break outranks a tab."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.due = ""

    def _break(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.due = "\n"
        elif tag in _CELLS:
            self.due = self.due or "\t"

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        self._break(tag)

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        else:
            self._break(tag)

    def handle_data(self, data):
        if self.hidden or (self.due and not data.strip()):
            return
        if self.due and self.out:
            self.out.append(self.due)
        self.due = ""
        self.out.append(data)


def from_html(text: str) -> str:
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    return "".join(parser.out)


_RTF_HIDDEN = set(
    "info stylesheet colortbl fonttbl listtable listoverridetable revtbl rsidtbl filetbl xmlnstbl pgptbl protusertbl themedata colorschememapping datastore latentstyles userprops docvar pict objdata bkmkstart bkmkend".split()
)
_RTF_TOKEN = re.compile(r"\\u(-?\d+) ?\??|\\'[0-9a-fA-F]{2}|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)|(\\)")


def from_rtf(text: str, keep_all: bool = False) -> str:
    """Body text of RTF.  Groups of document data and groups marked as ignorable are
    dropped whole; if such a group never ends, all groups are kept instead."""
    out: list[str] = []
    depth = hidden = 0
    fresh = False  # just behind an opening brace
    for m in _RTF_TOKEN.finditer(text):
        code, word, _, sign, brace, plain, _ = m.groups()
        if brace == "{":
            depth += 1
            fresh = True
            continue
        if brace == "}":
            if hidden and depth == hidden:
                hidden = 0
            depth -= 1
            fresh = False
            continue
        if fresh and not hidden and not keep_all and (sign == "*" or (word and word in _RTF_HIDDEN)):
            hidden = depth
        fresh = False
        if hidden:
            continue
        if code is not None:
            n = int(code) % 65536
            if n and not 0xD800 <= n <= 0xDFFF:
                out.append(chr(n))
        elif m.group().startswith("\\'"):
            out.append(" ")
        elif word is not None:
            if word in ("par", "pard"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
        elif sign is not None:
            if sign in "{}\\":
                out.append(sign)
        elif plain is not None:
            out.append(plain.replace("\r", "").replace("\n", ""))
    if hidden:
        return from_rtf(text, keep_all=True)
    return html.unescape("".join(out))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def check_office_xml(z: zipfile.ZipFile) -> None:
    """Refuses document types and entities in any part, in any usual encoding."""
    for name in z.namelist():
        if name.endswith((".xml", ".rels")):
            data = z.read(name)
            for encoding in ("utf-8", "utf-16", "utf-16le", "utf-16be", "utf-32"):
                upper = data.decode(encoding, errors="ignore").upper()
                if "<!ENTITY" in upper or "<!DOCTYPE" in upper:
                    raise ExtractionError(f"{name} declares a document type or an entity")


def _runs(element) -> str:
    return "".join(t.text for t in element.iter(f"{_W}t") if t.text)


def _office_blocks(element) -> list[str]:
    """Paragraphs and table rows (cells joined by tabs) in document order."""
    out: list[str] = []
    for child in element:
        if child.tag == f"{_W}p":
            out.append(_runs(child))
        elif child.tag == f"{_W}tbl":
            for row in child.iter(f"{_W}tr"):
                cells = [_runs(c).strip() for c in row.iter(f"{_W}tc")]
                out.append("\t".join(cells) if any(cells) else "")
        else:
            out += _office_blocks(child)
    return [x for x in out if x]


def from_docx(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            check_office_xml(z)
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ExtractionError(f"not a readable document: {e}") from e
    body = root.find(f"{_W}body")
    return "\n".join(_office_blocks(root if body is None else body))


def from_epub(data: bytes) -> str:
    """Parts in spine order, then other HTML parts of the manifest, else all HTML
    parts by name; joined by blank lines."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            container = decode(z.read("META-INF/container.xml")) if "META-INF/container.xml" in names else ""
            m = re.search(r'full-path="([^"]+)"', container)
            opf = m.group(1) if m and m.group(1) in names else next((n for n in names if n.endswith(".opf")), None)
            ordered: list[str] = []
            if opf:
                text = decode(z.read(opf))
                folder = opf.rpartition("/")[0]
                items = {}
                for tag in re.findall(r"<item\b[^>]*>", text):
                    attrs = dict(re.findall(r'([\w:-]+)="([^"]*)"', tag))
                    items[attrs.get("id")] = (f"{folder}/" if folder else "") + html.unescape(attrs.get("href", ""))
                spine = [items[i] for i in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', text) if i in items]
                ordered = [*spine, *(p for p in items.values() if p not in spine and p.lower().endswith(HTML_SUFFIXES))]
            ordered = [p for p in ordered if p in names] or sorted(n for n in names if n.lower().endswith(HTML_SUFFIXES))
            parts = [from_html(decode(z.read(p))).strip() for p in ordered]
    except zipfile.BadZipFile as e:
        raise ExtractionError(f"not a readable book: {e}") from e
    return "\n\n".join(p for p in parts if p)


def epub_chapters(data: bytes) -> int:
    """Items of the reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = next((n for n in z.namelist() if n.endswith(".opf")), None)
        return len(re.findall(r"<itemref\b", decode(z.read(opf)))) if opf else 0


def _tool(command: list[str], data: bytes, suffix: str, out: str | None, seconds: int) -> str:
    """Runs an external program on a file of its own."""
    if not shutil.which(command[0]):
        raise ExtractionError(f"{command[0]} is not installed")
    with tempfile.TemporaryDirectory() as d:
        source = f"{d}/in{suffix}"
        with open(source, "wb") as f:
            f.write(data)
        target = f"{d}/out.txt"
        done = subprocess.run([c.format(source=source, target=target) for c in command], capture_output=True, timeout=seconds)
        if done.returncode:
            raise ExtractionError(f"{command[0]} failed")
        if out is None:
            return done.stdout.decode("utf-8", "replace")
        with open(target, "rb") as f:
            return decode(f.read())


def _by_pypdf(data: bytes) -> list[str]:
    import io

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def _by_pdfminer(data: bytes) -> list[str]:
    import io

    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(data)).split("\f")


def _by_docling(data: bytes) -> list[str]:
    import io

    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    return [DocumentConverter().convert(DocumentStream(name="source.pdf", stream=io.BytesIO(data))).document.export_to_markdown()]


def from_pdf(data: bytes, technical: bool = False) -> str:
    """Text of a PDF by the first way that gives any: for technical content the
    layout converter, then ``pdftotext``, then the Python readers.  Ways that
    aren't installed are passed over; if none works, that is the error."""
    ways = [
        *([("docling", lambda: _by_docling(data))] if technical else []), ("pdftotext", lambda: _tool(["pdftotext", "-layout", "{source}", "-"], data, ".pdf", None, 120).split("\f")),
        ("pypdf", lambda: _by_pypdf(data)), ("pdfminer", lambda: _by_pdfminer(data)),
    ]
    failed = []
    for name, way in ways:
        try:
            pages = way()
        except Exception as e:  # noqa: BLE001 - the next way may work
            failed.append(f"{name}: {type(e).__name__}")
            continue
        if any(p.strip() for p in pages):
            return clean_pages("\f".join(pages))
        failed.append(f"{name}: no text")
    raise ExtractionError("; ".join(failed))


def pdf_pages(data: bytes) -> int:
    """Number of pages, by ``pdfinfo`` or a Python reader; 0 if neither works."""
    try:
        m = re.search(r"(?m)^Pages:\s+(\d+)", _tool(["pdfinfo", "{source}"], data, ".pdf", None, 60))
        if m:
            return int(m.group(1))
    except Exception:  # noqa: BLE001
        pass
    try:
        return len(_by_pypdf(data))
    except Exception:  # noqa: BLE001
        return 0


def from_ebook(data: bytes, suffix: str) -> str:
    return _tool(["ebook-convert", "{source}", "{target}"], data, suffix, "target", 300)


_PAGE_NUMBER = re.compile(r"(?i)(?:\d{1,4}|[ivxlcdm]{1,7})")


def clean_pages(text: str) -> str:
    """PDF text without running heads and page numbers, broken words joined.

    With three pages or more (blank ones count), a line that stands first or last
    on pages more often than half of them goes wherever it stands; a bare number,
    Arabic or Roman, goes where it is the first or last line of its page.
    """
    pages = [p.split("\n") for p in text.split("\f")]
    if len(pages) >= 3:
        ends = []
        times: dict[str, int] = {}
        for page in pages:
            full = [i for i, x in enumerate(page) if x.strip()]
            ends.append({full[0], full[-1]} if full else set())
            for i in (full[0], full[-1]) if full else ():
                times[page[i].strip()] = times.get(page[i].strip(), 0) + 1
        repeated = {line for line, n in times.items() if n > len(pages) / 2}
        for page, own in zip(pages, ends, strict=True):
            page[:] = [x for i, x in enumerate(page) if x.strip() not in repeated and not (i in own and _PAGE_NUMBER.fullmatch(x.strip()))]
    return re.sub(r"(\w)-\n(\w)", r"\1\2", "\n".join("\n".join(p) for p in pages))


def extract(data: bytes, suffix: str) -> str:
    """Text of a file by format; raises :class:`ExtractionError`."""
    kind = sniff(data, suffix)
    if kind == ".docx":
        return from_docx(data)
    if kind == ".epub":
        return from_epub(data)
    if kind == ".pdf":
        return from_pdf(data)
    if kind in EBOOK_SUFFIXES:
        return from_ebook(data, kind)
    text = decode(data)
    if kind in HTML_SUFFIXES:
        return from_html(text)
    return from_rtf(text) if kind == ".rtf" else text
