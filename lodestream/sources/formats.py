"""File formats to Markdown, after their public specifications: HTML, CSV, DOCX, EPUB, RTF, MediaWiki text, PDF, notes, code.

extract() chooses by extension and never raises: what its format cannot read is read as plain text, with a warning.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
import zlib
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree


@dataclass
class Document:
    markdown: str | None = ""
    title: str | None = None
    tags: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def decoded(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8, else Windows-1252; line ends become \\n."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            text = data[len(mark) :].decode(name, "replace")
            break
    else:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            text = data.decode("cp1252", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


# -- notes -------------------------------------------------------------------

_LINK = re.compile(r"(!?)\[\[([^\]\[|#]*)(#[^\]\[|]*)?(?:\|([^\]\[]*))?\]\]")
_TAG = re.compile(r"(?<![\w/#&])#([^\W\d_][\w/-]*)")


def scalar(text: str) -> str:
    """A YAML scalar without its quotes and its comment."""
    text = text.strip()
    if text[:1] in "\"'" and text[:1]:
        end = text.find(text[0], 1)
        return text[1:end] if end > 0 else text[1:]
    return re.sub(r"(?:^|\s)#.*$", "", text).strip()


def front_matter(text: str) -> tuple[dict[str, list[str]], str]:
    """The leading block between --- lines, keys to lists of scalars, and the text behind it. Flat YAML: scalars and lists."""
    found = re.match(r"---[ \t]*\n(.*?)(?:^|\n)(?:---|\.\.\.)[ \t]*(?:\n|\Z)", text, re.S)
    if not found:
        return {}, text
    out: dict[str, list[str]] = {}
    key = None
    for line in found[1].split("\n"):
        if item := re.match(r"\s*-\s+(.*)$", line):
            if key is not None and (value := scalar(item[1])):
                out[key].append(value)
        elif pair := re.match(r"([^\s:#][^:]*):(?:\s+(.*))?$", line):
            key, value = pair[1].strip().lower(), (pair[2] or "").strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [s for s in (scalar(v) for v in next(csv.reader([value[1:-1]], skipinitialspace=True), [])) if s]
            else:
                out[key] = [scalar(value)] if scalar(value) else []
    return out, text[found.end() :]


def note(text: str, title: str | None = None) -> Document:
    """Markdown with front matter, [[links]], ![[embeds]] and #tags; embeds go, links leave their words."""
    head, body = front_matter(text)
    tags, links, parts = list(head.get("tags", []) + head.get("tag", [])), [], []

    def word(m: re.Match) -> str:
        target = m[2].strip()
        if target:
            links.append(target)
        return "" if m[1] else (m[4] or "".join(x for x in (target, (m[3] or "").replace("#", " › " if target else "")) if x)).strip()

    fence = ""
    for line in body.split("\n"):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else mark[1]
        elif not fence:
            tags += _TAG.findall(re.sub(r"`[^`]*`|\]\([^)]*\)|https?://\S+", " ", line))
            line = _LINK.sub(word, line)
        parts.append(line)
    named = head.get("title") or [title]
    return Document("\n".join(parts).strip(), named[0], sorted({t.lstrip("#") for t in tags}), sorted(set(links)))


# -- tables ------------------------------------------------------------------


def rows_of(text: str, delimiter: str | None = None) -> list[list[str]]:
    """RFC 4180 rows; without a delimiter that of , ; tab | which cuts the first lines into the most equal rows."""
    if delimiter is None:
        lines = text.split("\n")[:20]

        def fit(d: str) -> tuple[float, int]:
            sizes = [len(r) for r in csv.reader(lines, delimiter=d) if r]
            most = max(set(sizes), key=sizes.count, default=1)
            return (sizes.count(most) / len(sizes) if sizes and most > 1 else 0.0, most)

        delimiter = max(",;\t|", key=fit)
    return [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if any(c.strip() for c in r)]


def table_of(rows: list[list[str]]) -> str:
    """A table of GitHub-flavoured Markdown; the first row is its head, short rows are filled up."""
    if not rows:
        return ""
    wide = max(map(len, rows))
    cells = [[re.sub(r"\s*\n\s*", " ", c).replace("|", "\\|").strip() for c in r] + [""] * (wide - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [cells[0], ["---"] * wide, *cells[1:]])


# -- HTML --------------------------------------------------------------------


class _Markdown(HTMLParser):
    """HTML to Markdown in one pass; blocks are parted by blank lines."""

    UNSEEN = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object", "select", "button"}
    BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "figure", "figcaption", "address", "dl", "dt", "dd", "form", "fieldset", "details", "summary", "body", "html", "center"}
    MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.title, self.in_title, self.unseen, self.pre = "", False, 0, 0
        self.lists: list[list] = []
        self.quotes = 0
        self.heading = 0
        self.links: list[tuple[str, int]] = []
        self.targets: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.item = ""

    def flush(self) -> None:
        text = "".join(self.line)
        self.line = []
        if self.pre:
            return
        text = re.sub(r"[ \t\n\r\f]+", " ", text.replace("\0", "\n")).strip() if "\0" not in text else "\n".join(re.sub(r"[ \t\n\r\f]+", " ", p).strip() for p in text.split("\0")).strip()
        if not text:
            return
        if self.tables:
            if not self.tables[-1] or not self.tables[-1][-1]:
                self.tables[-1].append([""]) if not self.tables[-1] else self.tables[-1][-1].append("")
            cell = self.tables[-1][-1]
            cell[-1] = f"{cell[-1]} {text}".strip()
            return
        if self.heading:
            text = "#" * self.heading + " " + text.replace("\n", " ")
        depth = max(0, len(self.lists) - 1)
        if self.lists:
            lead = "  " * depth + (self.item or "  ")
            text = lead + text.replace("\n", "\n" + " " * len(lead))
            self.item = ""
        self.put(text, tight=bool(self.lists))

    def put(self, text: str, tight: bool = False) -> None:
        if self.quotes:
            text = "\n".join("> " * self.quotes + x if x else ">" * self.quotes for x in text.split("\n"))
        joins = tight and self.out and self.out[-1][0]
        if joins:
            self.out[-1] = (True, self.out[-1][1] + "\n" + text)
        else:
            self.out.append((tight, text))

    def handle_starttag(self, tag: str, attrs) -> None:
        attrs = dict(attrs)
        if tag == "title" and not self.title:
            self.in_title = True
        if tag in self.UNSEEN:
            self.unseen += 1
        if self.unseen:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.heading = int(tag[1])
        elif tag == "br":
            self.line.append("\n" if self.pre else "\0")
        elif tag == "hr":
            self.flush()
            self.put("---")
        elif tag == "pre":
            self.flush()
            self.pre += 1
        elif tag == "blockquote":
            self.flush()
            self.quotes += 1
        elif tag == "img":
            if attrs.get("alt") or attrs.get("src"):
                self.line.append(f"![{(attrs.get('alt') or '').strip()}]({attrs.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.flush()
            start = attrs.get("start") or "1"
            self.lists.append([tag, int(start) if start.isdigit() else 1])
        elif tag == "li":
            self.flush()
            kind = self.lists[-1] if self.lists else ["ul", 1]
            self.item = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
        elif tag == "table":
            self.flush()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.flush()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.flush()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append("")
        elif tag == "a":
            self.links.append((attrs.get("href") or "", len(self.line)))
        elif tag in self.MARKS and not (self.pre and tag in ("code", "kbd", "samp")):
            self.line.append(self.MARKS[tag])
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.UNSEEN:
            self.unseen = max(0, self.unseen - 1)
            return
        if self.unseen:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.heading = 0
        elif tag == "pre" and self.pre:
            text, self.line = "".join(self.line).strip("\n"), []
            self.pre -= 1
            fence = "`" * max(3, max((len(x) for x in re.findall(r"`+", text)), default=0) + 1)
            self.put(f"{fence}\n{text}\n{fence}")
        elif tag == "blockquote":
            self.flush()
            self.quotes = max(0, self.quotes - 1)
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
            if not self.lists and self.out and self.out[-1][0]:
                self.out[-1] = (False, self.out[-1][1])
        elif tag == "table" and self.tables:
            self.flush()
            rows = [r for r in self.tables.pop() if any(r)]
            if rows:
                self.put(table_of(rows))
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            words = "".join(self.line[at:]).strip()
            if words and href and not href.lower().startswith("javascript:") and at <= len(self.line):
                self.targets.append(href)
                self.line[at:] = [f"[{words}]({href})"]
        elif tag in self.MARKS and not (self.pre and tag in ("code", "kbd", "samp")):
            mark = self.MARKS[tag]
            for k in range(len(self.line) - 1, -1, -1):
                if self.line[k] == mark:
                    inner = "".join(self.line[k + 1 :])
                    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
                    self.line[k:] = [lead + mark + inner.strip() + mark + tail] if inner.strip() else [inner]
                    break
        elif tag in self.BLOCKS or tag in ("li", "tr", "td", "th"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.unseen:
            self.line.append(data)


def html_document(text: str, title: str | None = None) -> Document:
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    if parser.pre:
        parser.pre = 0
    parser.flush()
    while parser.tables:
        parser.put(table_of([r for r in parser.tables.pop() if any(r)]))
    markdown = re.sub(r"\n{3,}", "\n\n", "\n\n".join(t for _, t in parser.out)).strip()
    return Document(markdown, re.sub(r"\s+", " ", parser.title).strip() or title, links=sorted(set(parser.targets)))


# -- MediaWiki ---------------------------------------------------------------


def _without_nested(text: str, opens: str, closes: str) -> str:
    """text without what stands between balanced marks."""
    out, depth, at = [], 0, 0
    for m in re.finditer(f"{re.escape(opens)}|{re.escape(closes)}", text):
        if depth == 0:
            out.append(text[at : m.start()])
        depth = depth + 1 if m[0] == opens else max(0, depth - 1)
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    return "".join(out)


def wiki_document(text: str, title: str | None = None) -> Document:
    """Wikitext without templates, tables, references and comments; categories become tags."""
    text = re.sub(r"<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<nowiki\s*/>|__[A-Z]+__", "", text, flags=re.S)
    text = _without_nested(_without_nested(text, "{{", "}}"), "{|", "|}")
    tags, links = [], []

    def link(m: re.Match) -> str:
        target, _, words = m[1].partition("|")
        space, _, name = target.strip().lstrip(":").partition(":")
        if name and space.lower() == "category" and not target.startswith(":"):
            tags.append(name.strip())
            return ""
        if name and space.lower() in ("file", "image"):
            return ""
        links.append(target.split("#")[0].strip().lstrip(":"))
        return words.split("|")[-1].strip() or target.strip().lstrip(":")

    text = re.sub(r"\[\[([^\[\]]*)\]\]", link, text)
    text = re.sub(r"\[(https?://[^\s\]]+)(?:\s+([^\]]*))?\]", lambda m: f"[{m[2]}]({m[1]})" if m[2] else f"<{m[1]}>", text)
    marks = {"*": "- ", "#": "1. "}
    text = re.sub(r"^([*#:;]+)[ \t]*", lambda m: "  " * (len(m[1]) - 1) + marks.get(m[1][-1], ""), text, flags=re.M)
    text = re.sub(r"^(={1,6})\s*(.+?)\s*\1\s*$", lambda m: "#" * len(m[1]) + " " + m[2], text, flags=re.M)
    text = re.sub(r"'''''(.+?)'''''", r"***\1***", text)
    text = re.sub(r"'''(.+?)'''", r"**\1**", text)
    text = re.sub(r"''(.+?)''", r"*\1*", text)
    text = re.sub(r"</?(?:br|small|sub|sup|span|div|center|big|u|blockquote)[^>]*>", "", text)
    return Document(re.sub(r"\n{3,}", "\n\n", text).strip(), title, sorted(set(tags)), sorted({x for x in links if x}))


# -- office and book files ---------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes that one entry of an archive may unpack to.
MOST_ENTRY = 256 << 20


def entry(archive: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MOST_ENTRY:
        raise ValueError(f"{name} is too large")
    return archive.read(info)


def docx_document(data: bytes, title: str | None = None) -> Document:
    """Paragraphs, headings by style, lists and tables of word/document.xml (ECMA-376)."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    body = ElementTree.fromstring(entry(archive, "word/document.xml") or b"<x/>").find(f"{_W}body")
    core = entry(archive, "docProps/core.xml")
    if core:
        named = ElementTree.fromstring(core).find("{http://purl.org/dc/elements/1.1/}title")
        title = (named.text or "").strip() if named is not None and (named.text or "").strip() else title

    def words(node) -> str:
        out = []
        for x in node.iter():
            if x.tag == f"{_W}t":
                out.append(x.text or "")
            elif x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
                out.append("\t" if x.tag == f"{_W}tab" else "\n")
        return "".join(out).strip()

    parts: list[tuple[bool, str]] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            parts.append((False, table_of([[words(c) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")])))
        elif node.tag == f"{_W}p" and (text := words(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            named = (style.get(f"{_W}val") or "") if style is not None else ""
            level = re.fullmatch(r"(?:heading|berschrift|titre)\s*([1-6])", named, re.I)
            if level or named.lower() == "title":
                parts.append((False, "#" * (int(level[1]) if level else 1) + " " + text.replace("\n", " ")))
            elif node.find(f"{_W}pPr/{_W}numPr") is not None:
                depth = node.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
                parts.append((True, "  " * int(depth.get(f"{_W}val") or 0 if depth is not None else 0) + "- " + text))
            else:
                parts.append((False, text))
    out = ""
    for k, (tight, text) in enumerate(parts):
        out += ("" if not k else "\n" if tight and parts[k - 1][0] else "\n\n") + text
    return Document(out, title)


def resolved(base: str, reference: str) -> str:
    """A path within an archive, relative to the folder of the file that refers to it."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(reference.split("#")[0]))).lstrip("/")


def epub_document(data: bytes, title: str | None = None) -> Document:
    """The chapters of the package's spine, in its order (EPUB 3)."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    container = ElementTree.fromstring(entry(archive, "META-INF/container.xml") or b"<x/>")
    package = next((x.get("full-path") for x in container.iter() if x.tag.endswith("}rootfile")), None)
    if not package:
        raise ValueError("no package")
    book = ElementTree.fromstring(entry(archive, package) or b"<x/>")
    tail = lambda x: x.tag.rpartition("}")[2]
    items = {x.get("id"): x for x in book.iter() if tail(x) == "item"}
    named = next((x.text for x in book.iter() if tail(x) == "title" and (x.text or "").strip()), None)
    parts, warnings = [], []
    for x in book.iter():
        if tail(x) == "itemref" and x.get("linear") != "no" and x.get("idref") in items:
            item = items[x.get("idref")]
            if (item.get("media-type") or "") in ("application/xhtml+xml", "text/html"):
                chapter = entry(archive, path := resolved(package, item.get("href") or ""))
                if chapter is None:
                    warnings.append(f"missing chapter {path}")
                elif text := html_document(decoded(chapter)).markdown:
                    parts.append(text)
    return Document("\n\n".join(parts), (named or "").strip() or title, warnings=warnings)


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_UNSEEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "footnote", "object", "themedata", "listtable", "listoverridetable", "rsidtbl", "generator", "xmlnstbl", "datastore", "latentstyles"}
_RTF_WORDS = {"par": "\n\n", "line": "\n", "tab": "\t", "page": "\n\n", "cell": " | ", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_document(text: str, title: str | None = None) -> Document:
    """The text of the body's groups (RTF 1.9)."""
    if not text.lstrip().startswith("{\\rtf"):
        raise ValueError("no RTF")
    out, stack, unseen, fallback, skip = [], [], False, 1, 0
    first = True
    for m in _RTF.finditer(text):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((unseen, fallback))
            first = True
            continue
        if brace == "}":
            unseen, fallback = stack.pop() if stack else (False, 1)
            skip, first = 0, False
            continue
        if word:
            if word in _RTF_UNSEEN:
                unseen = True
            elif word == "uc":
                fallback = int(number or 1)
            elif word == "u" and not unseen:
                out.append(chr(int(number or 0) % 65536))
                skip = fallback
            elif not unseen and word in _RTF_WORDS:
                out.append(_RTF_WORDS[word])
        elif sign == "*" and first:
            unseen = True
        elif not unseen:
            for c in [bytes.fromhex(code).decode("cp1252", "replace")] if code else [{"~": "\xa0", "_": "-"}.get(sign, sign)] if sign and sign in "\\{}~_" else plain or "":
                if skip:
                    skip -= 1
                else:
                    out.append(c)
        first = first and sign == "*"
    body = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return Document(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", body)).strip(), title)


_PDF_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>")
_PDF_SHOW = re.compile(rb"(\[(?:[^\]\\]|\\.)*\]\s*TJ|(?:\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\"))|\b(T\*|(?:Td|TD|Tm|ET)\b)", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_document(data: bytes, title: str | None = None) -> Document:
    """The strings that content streams show (ISO 32000): for fonts in a standard encoding, in the order of the file."""
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF")

    def string(raw: bytes) -> str:
        if raw[:1] == b"<":
            digits = re.sub(rb"\s", b"", raw[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
        plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else _PDF_ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
        return plain.decode("cp1252", "replace")

    lines: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        part = m[1]
        if b"/FlateDecode" in data[max(0, m.start() - 400) : m.start()].rpartition(b"obj")[2]:
            try:
                part = zlib.decompressobj().decompress(part, MOST_ENTRY)
            except zlib.error:
                continue
        if b"BT" not in part:
            continue
        line = ""
        for show, move in _PDF_SHOW.findall(part):
            if show:
                line += "".join(map(string, _PDF_STRING.findall(show)))
            elif line.strip():
                lines.append(line.strip())
                line = ""
        if line.strip():
            lines.append(line.strip())
        if lines and lines[-1]:
            lines.append("")
    return Document("\n".join(lines).strip(), title, warnings=[] if lines else ["no text: a scan, or fonts with an encoding of their own"])


# -- dispatch ----------------------------------------------------------------

#: Extensions by category; anything else is plain text.
CATEGORIES = {
    "note": ("md", "markdown", "mdown", "mkd"),
    "html": ("html", "htm", "xhtml"),
    "wiki": ("wiki", "mediawiki", "wikitext"),
    "table": ("csv", "tsv", "tab"),
    "docx": ("docx",),
    "epub": ("epub",),
    "rtf": ("rtf",),
    "pdf": ("pdf",),
    "code": ("c", "cpp", "css", "go", "h", "java", "js", "json", "kt", "py", "r", "rb", "rs", "scala", "sh", "sql", "swift", "toml", "ts", "xml", "yaml", "yml"),
}


def category(extension: str | None) -> str:
    kind = (extension or "").lower().lstrip(".")
    return next((name for name, kinds in CATEGORIES.items() if kind in kinds), "plain")


def extract(name: str, extension: str | None, data: bytes) -> Document:
    """The document of a file; the title is what the format says, else the name without its extension."""
    title, kind = re.sub(r"(?<=.)\.[^.]+$", "", name or ""), (extension or "").lower()
    try:
        match category(kind):
            case "note":
                return note(decoded(data), title)
            case "html":
                return html_document(decoded(data), title)
            case "wiki":
                return wiki_document(decoded(data), title)
            case "table":
                return Document(table_of(rows_of(decoded(data), "\t" if kind in ("tsv", "tab") else None)), title)
            case "docx":
                return docx_document(data, title)
            case "epub":
                return epub_document(data, title)
            case "rtf":
                return rtf_document(data.decode("latin-1"), title)
            case "pdf":
                return pdf_document(data, title)
            case "code":
                text = decoded(data).rstrip("\n")
                fence = "`" * max(3, max((len(x) for x in re.findall(r"`+", text)), default=0) + 1)
                return Document(f"{fence}{kind}\n{text}\n{fence}", title)
            case _:
                return Document(decoded(data).strip(), title)
    except Exception as wrong:  # whatever a broken file raises: its text, if it has any, is better than none
        if b"\0" in data[:4096]:
            return Document(None, title, warnings=[f"{category(kind)}: {wrong}"])
        return Document(decoded(data).strip(), title, warnings=[f"read as plain text, {category(kind)}: {wrong}"])
