"""Formats: what a document's bytes hold, and how redacted text goes back into them.

A format reads bytes into chunks (text, where it lies, hints) and writes edits back. The registry finds formats by
extension, then by content type; ids are unique unless replaced. All readers keep positions, so what is not edited stays
byte for byte as it was."""

from __future__ import annotations

import contextlib
import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Chunk:
    """A unit of detection: its text, where that begins in the document's text, or the cell it is, and its hints."""

    text: str
    start: int = 0
    row: int | None = None
    col: int | None = None
    sheet: str | None = None
    column_name: str | None = None
    part: str | None = None
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Edit:
    """A replacement in chunk coordinates; drop: "row" or "column" of a table."""

    chunk: int
    start: int
    end: int
    replacement: str
    drop: str | None = None


@dataclass(frozen=True)
class Format:
    id: str
    extensions: tuple[str, ...]
    content_types: tuple[str, ...]
    read: Callable[[bytes], list[Chunk]]
    write: Callable[[bytes, list[Edit]], bytes]
    modality: str = "text"
    #: Which members of a package are documents of their own: member name -> extension, or None.
    part: Callable[[str], str | None] | None = None


class DecodeError(ValueError):
    pass


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise DecodeError(str(e)) from e


def splice(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """Edits from the right; those out of range are left out."""
    for a, b, new in sorted(edits, reverse=True):
        if 0 <= a <= b <= len(text):
            text = text[:a] + new + text[b:]
    return text


# Plain text


def paragraphs(text: str) -> list[tuple[int, str]]:
    """Maximal runs of lines that are not blank, without the last line's end."""
    out = []
    for m in re.finditer(r"(?:[^\S\n]*\S[^\n]*(?:\n|\Z))+", text):
        block = m[0]
        out.append((m.start(), block[:-2] if block.endswith("\r\n") else block[:-1] if block.endswith("\n") else block))
    return out


def read_text(raw: bytes) -> list[Chunk]:
    return [Chunk(t, a) for a, t in paragraphs(_utf8(raw))]


def write_text(raw: bytes, edits: list[Edit]) -> bytes:
    text = _utf8(raw)
    chunks = read_text(raw)
    return splice(text, [(chunks[e.chunk].start + e.start, chunks[e.chunk].start + e.end, e.replacement) for e in edits]).encode()


# CSV


def sniff_delimiter(text: str) -> str:
    """Of comma, tab, semicolon and pipe the one with the most in every one of the first five lines, then in all."""
    lines = [x for x in text.splitlines()[:5] if x.strip()]
    best = max(",\t;|", key=lambda d: (min((x.count(d) for x in lines), default=0), sum(x.count(d) for x in lines), -",\t;|".index(d)))
    return best if any(best in x for x in lines) else ","


def _rows(text: str) -> tuple[list[list[str]], str]:
    d = sniff_delimiter(text)
    return list(csv.reader(io.StringIO(text.replace("\r", "")), delimiter=d)), d


def read_csv(raw: bytes) -> list[Chunk]:
    """Every cell, the header's too; a cell's hint is its column's header."""
    rows, _ = _rows(_utf8(raw))
    head = rows[0] if rows else []
    name = lambda c: head[c] if c < len(head) else None
    return [Chunk(v, row=r, col=c, column_name=name(c), hints=(name(c),) if r and name(c) else ()) for r, line in enumerate(rows) for c, v in enumerate(line)]


def write_csv(raw: bytes, edits: list[Edit]) -> bytes:
    """Cells first, then dropped columns, then dropped rows; the header row stays."""
    text = _utf8(raw)
    rows, d = _rows(text)
    at = [(r, c) for r, line in enumerate(rows) for c in range(len(line))]
    by_cell: dict[tuple[int, int], list] = {}
    for e in edits:
        if not e.drop:
            by_cell.setdefault(at[e.chunk], []).append((e.start, e.end, e.replacement))
    for (r, c), own in by_cell.items():
        rows[r][c] = splice(rows[r][c], own)
    for c in sorted({at[e.chunk][1] for e in edits if e.drop == "column"}, reverse=True):
        for line in rows:
            del line[c : c + 1]
    gone = {at[e.chunk][0] for e in edits if e.drop == "row"} - {0}
    out = io.StringIO()
    csv.writer(out, delimiter=d, lineterminator="\n").writerows([x for r, x in enumerate(rows) if r not in gone])
    return (out.getvalue() if text.endswith("\n") or not text else out.getvalue().removesuffix("\n")).encode()


# JSON

MOST_DEPTH = 128
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_BLANK = re.compile(r"[ \t\r\n]*")


def json_leaves(text: str) -> list[tuple[str, int, int, tuple[str, ...]]]:
    """(kind, start, end, hints) of keys, string values and scalars, by position in the source; iterative."""
    import json

    out, stack, at = [], [], _BLANK.match(text).end()
    expect, key = "value", None
    while True:
        at = _BLANK.match(text, at).end()
        c = text[at : at + 1]
        if expect == "value":
            hint = (key,) if key is not None else ()
            if c in ("{", "["):
                if len(stack) >= MOST_DEPTH:
                    raise DecodeError(f"nested deeper than {MOST_DEPTH}")
                stack.append((c, key))
                at += 1
                inner = _BLANK.match(text, at).end()
                if text[inner : inner + 1] == ("}" if c == "{" else "]"):
                    at, expect = inner, "after"
                    continue
                expect = "key" if c == "{" else "value"
                continue
            m = _STRING.match(text, at)
            kind = "string" if m else "scalar"
            m = m or _SCALAR.match(text, at)
            if not m:
                raise DecodeError(f"no value at {at}")
            out.append((kind, m.start(), m.end(), hint))
            at, expect = m.end(), "after"
        elif expect == "key":
            m = _STRING.match(text, at)
            if not m:
                raise DecodeError(f"no key at {at}")
            out.append(("key", m.start(), m.end(), ()))
            key = json.loads(m[0])
            at = _BLANK.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                raise DecodeError(f"no colon at {at}")
            at, expect = at + 1, "value"
        else:
            if not stack:
                if at != len(text):
                    raise DecodeError(f"text after the value at {at}")
                return out
            kind, outer = stack[-1]
            if c == ",":
                at, expect = at + 1, "key" if kind == "{" else "value"
                key = None if kind == "{" else outer
            elif c == ("}" if kind == "{" else "]"):
                stack.pop()
                at, key = at + 1, outer
            else:
                raise DecodeError(f"unexpected text at {at}")
        if expect == "value" and stack and stack[-1][0] == "[":
            key = stack[-1][1]


def read_json(raw: bytes) -> list[Chunk]:
    import json

    text = _utf8(raw)
    return [Chunk(text[a:b] if kind == "scalar" else json.loads(text[a:b]), a, hints=hints) for kind, a, b, hints in json_leaves(text)]


def write_json(raw: bytes, edits: list[Edit]) -> bytes:
    """Edited leaves are written anew; a scalar that is no literal any more becomes a string."""
    import json

    text = _utf8(raw)
    leaves, changed = json_leaves(text), []
    by: dict[int, list] = {}
    for e in edits:
        by.setdefault(e.chunk, []).append((e.start, e.end, e.replacement))
    for i, own in by.items():
        kind, a, b, _ = leaves[i]
        value = splice(text[a:b] if kind == "scalar" else json.loads(text[a:b]), own)
        changed.append((a, b, value if kind == "scalar" and _SCALAR.fullmatch(value) else json.dumps(value, ensure_ascii=False)))
    return splice(text, changed).encode()


# HTML and XML

_MARKUP = re.compile(r"<!--(.*?)-->|<!\[CDATA\[(.*?)\]\]>|<(/?)([A-Za-z_][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BLOCKS = frozenset("p div li td th h1 h2 h3 h4 h5 h6 section article body blockquote dt dd tr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def words_of_name(name: str) -> str:
    """An element's or key's name as words: camel, snake and kebab case apart."""
    return " ".join(re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)).lower() or name


def markup_items(text: str, html: bool, scripts: bool = False) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, hints) of attribute values, text, comments and CDATA, raw as they stand.

    Text is hinted by its element's name and, in HTML, by its neighbours in the same block (2 to 64 of them)."""
    items: list[list] = []
    stack: list[str] = []
    blocks: list[list[int]] = [[]]
    at = skip = 0

    def add(a: int, b: int, hints: tuple[str, ...], sibling: bool = False) -> None:
        if text[a:b].strip():
            if sibling:
                blocks[-1].append(len(items))
            items.append([a, b, hints])

    def close_block() -> None:
        group = blocks.pop() if len(blocks) > 1 else blocks[0]
        if html and 2 <= len(group) <= 64:
            for i in group:
                items[i][2] += tuple(text[items[j][0] : items[j][1]].strip() for j in group if j != i)
        if group is blocks[0]:
            blocks[0] = []

    while at < len(text):
        m = _MARKUP.search(text, at)
        end = m.start() if m else len(text)
        if not skip or scripts:
            add(at, end, (words_of_name(stack[-1]),) if stack else (), True)
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            add(m.start(1), m.end(1), ())
        elif m[2] is not None:
            add(m.start(2), m.end(2), (words_of_name(stack[-1]),) if stack else ())
        elif m[4]:
            name = m[4].lower() if html else m[4]
            if m[3]:
                if name in stack:
                    while stack:
                        gone = stack.pop()
                        if html and gone in _BLOCKS:
                            close_block()
                        if gone == name:
                            break
                elif not html:
                    raise DecodeError(f"stray end tag {name}")
                skip = 0 if name in ("script", "style") else skip
                continue
            for x in _ATTRIBUTE.finditer(m[5]):
                g = 2 if x[2] is not None else 3 if x[3] is not None else 4
                add(m.start(5) + x.start(g), m.start(5) + x.end(g), (words_of_name(x[1]),))
            if m[5].endswith("/") or (html and name in _VOID):
                continue
            stack.append(name)
            if html and name in _BLOCKS:
                blocks.append([])
            if html and name in ("script", "style"):
                tail = re.compile(rf"</{name}\s*>", re.I).search(text, at)
                if not scripts:
                    at = tail.start() if tail else len(text)
                skip = 1
    if stack and not html:
        raise DecodeError(f"element {stack[-1]} is not closed")
    while len(blocks) > 1:
        close_block()
    close_block()
    return [(a, b, h) for a, b, h in items]


def _markup(html: bool):
    def read(raw: bytes) -> list[Chunk]:
        text = _utf8(raw)
        return [Chunk(text[a:b], a, hints=h) for a, b, h in markup_items(text, html)]

    def write(raw: bytes, edits: list[Edit]) -> bytes:
        text = _utf8(raw)
        items = markup_items(text, html)
        out = []
        for e in edits:
            a, b, _ = items[e.chunk]
            if not html and not 0 <= e.start <= e.end <= b - a:
                raise ValueError("edit outside its node")
            out.append((a + e.start, a + e.end, e.replacement))
        return splice(text, out).encode()

    return read, write


# Office packages: text runs of their XML parts, and cells


def _package(pattern: str, block: str, run: str):
    """Paragraphs (elements named block) of matching parts; edits go into the runs that hold them."""
    part_name, para, text_run = re.compile(pattern), re.compile(rf"<{block}(?:\s[^>]*)?>(.*?)</{block}>", re.S), re.compile(rf"<{run}(?:\s[^>]*)?>([^<]*)</{run}>")

    def parts(z: zipfile.ZipFile):
        from html import unescape

        for name in sorted(n for n in z.namelist() if part_name.fullmatch(n)):
            xml = z.read(name).decode("utf-8")
            for p in para.finditer(xml):
                runs = [(p.start(1) + r.start(1), p.start(1) + r.end(1), unescape(r[1])) for r in text_run.finditer(p[1])]
                if any(t.strip() for _, _, t in runs):
                    yield name, xml, runs

    def read(raw: bytes) -> list[Chunk]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [Chunk("".join(t for _, _, t in runs), part=name) for name, _, runs in parts(z)]

    def write(raw: bytes, edits: list[Edit]) -> bytes:
        from html import escape

        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            changes: dict[str, list] = {}
            by: dict[int, list[Edit]] = {}
            for e in edits:
                by.setdefault(e.chunk, []).append(e)
            for i, (name, _, runs) in enumerate(parts(z)):
                at = 0
                for a, b, t in runs:
                    own = []
                    for e in by.get(i, ()):
                        lo, hi = max(e.start, at), min(e.end, at + len(t))
                        if lo < hi or (lo == hi == e.start == e.end):
                            own.append((lo - at, hi - at, e.replacement if e.start >= at else ""))
                    if own:
                        changes.setdefault(name, []).append((a, b, escape(splice(t, own), quote=False)))
                    at += len(t)
            for info in z.infolist():
                data = z.read(info.filename)
                w.writestr(info, splice(data.decode("utf-8"), changes[info.filename]).encode() if info.filename in changes else data)
        return out.getvalue()

    return read, write


_CELL = re.compile(r'<c\s([^>]*?)(?:/>|>(.*?)</c>)', re.S)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str, list[str]]]:
    from html import unescape

    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in re.finditer(r"<si>(.*?)</si>", z.read("xl/sharedStrings.xml").decode("utf-8"), re.S):
            shared.append(unescape("".join(re.findall(r"<t(?:\s[^>]*)?>([^<]*)</t>", si[1]))))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return [(n, z.read(n).decode("utf-8"), shared) for n in names]


def _cells(xml: str, shared: list[str]):
    """(match, row, column, text) of each cell with text."""
    from html import unescape

    for m in _CELL.finditer(xml):
        attributes = dict(re.findall(r'(\w+)="([^"]*)"', m[1]))
        ref = re.fullmatch(r"([A-Z]+)(\d+)", attributes.get("r", ""))
        if not ref or m[2] is None:
            continue
        col = 0
        for c in ref[1]:
            col = col * 26 + ord(c) - 64
        value = re.search(r"<v>([^<]*)</v>", m[2])
        if attributes.get("t") == "s" and value:
            text = shared[int(value[1])]
        elif attributes.get("t") == "inlineStr":
            text = unescape("".join(re.findall(r"<t(?:\s[^>]*)?>([^<]*)</t>", m[2])))
        else:
            text = unescape(value[1]) if value else ""
        yield m, int(ref[2]) - 1, col - 1, text, attributes


def read_xlsx(raw: bytes) -> list[Chunk]:
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name, xml, shared in _sheets(z):
            cells = list(_cells(xml, shared))
            head = {c: t for _, r, c, t, _ in cells if r == 0}
            out += [Chunk(t, row=r, col=c, sheet=name, column_name=head.get(c), hints=(head[c],) if r and c in head else ()) for _, r, c, t, _ in cells]
    return out


def write_xlsx(raw: bytes, edits: list[Edit]) -> bytes:
    """Edited cells get a string of their own; rows and columns are not dropped in workbooks."""
    from html import escape

    if any(e.drop for e in edits):
        raise ValueError("workbooks keep their rows and columns")
    by: dict[int, list] = {}
    for e in edits:
        by.setdefault(e.chunk, []).append((e.start, e.end, e.replacement))
    out, n = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        changed = {}
        for name, xml, shared in _sheets(z):
            own = []
            for m, _, _, t, attributes in _cells(xml, shared):
                if n in by:
                    keep = "".join(f' {k}="{v}"' for k, v in attributes.items() if k != "t")
                    own.append((m.start(), m.end(), f'<c{keep} t="inlineStr"><is><t xml:space="preserve">{escape(splice(t, by[n]), quote=False)}</t></is></c>'))
                n += 1
            changed[name] = splice(xml, own).encode()
        for info in z.infolist():
            w.writestr(info, changed.get(info.filename, z.read(info.filename)))
    return out.getvalue()


# Packages with parts


def _embedded(*folders: str, xml: str = "") -> Callable[[str], str | None]:
    """Media and embedded files by their extension; members that match xml as markup."""

    def hint(name: str) -> str | None:
        if xml and re.fullmatch(xml, name):
            return "xml"
        return name.rpartition(".")[2].lower() if any(name.startswith(f) for f in folders) and "." in name else None

    return hint


def parts(f: Format, raw: bytes) -> list[tuple[str, str, bytes]]:
    """(member, extension, content) of a package's own documents."""
    if f.part is None:
        return []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [(n, x, z.read(n)) for n in sorted(z.namelist()) if (x := f.part(n))]


def replace_parts(raw: bytes, new: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            w.writestr(info, new.get(info.filename, z.read(info.filename)))
    return out.getvalue()


def read_document(registry: Registry, f: Format, raw: bytes) -> list[Chunk]:
    """Chunks of the body, then of each part whose format is known, one level deep; other parts are left alone."""
    out = list(f.read(raw))
    for name, x, content in parts(f, raw):
        inner = registry.find(x)
        if inner is not None:
            with contextlib.suppress(DecodeError, NotImplementedError):
                out += [replace(c, part=name) for c in inner.read(content)]
    return out


def write_document(registry: Registry, f: Format, raw: bytes, edits: list[Edit]) -> bytes:
    """The document with edits in its body and its parts; chunks count as read_document() lists them."""
    base = len(f.read(raw))
    own = [e for e in edits if e.chunk < base]
    new: dict[str, bytes] = {}
    for name, x, content in parts(f, raw):
        inner = registry.find(x)
        if inner is None:
            continue
        try:
            n = len(inner.read(content))
        except (DecodeError, NotImplementedError):
            continue
        mine = [replace(e, chunk=e.chunk - base) for e in edits if base <= e.chunk < base + n]
        if mine:
            new[name] = inner.write(content, mine)
        base += n
    out = f.write(raw, own) if own else raw
    return replace_parts(out, new) if new else out


# The registry


def _missing(what: str):
    def fail(*_):
        raise NotImplementedError(what)

    return fail


def built_in() -> list[Format]:
    docx, pptx = _package(r"word/(?:document|header\d*|footer\d*|footnotes|comments)\.xml", "w:p", "w:t"), _package(r"ppt/(?:slides|notesSlides)/\w+\.xml", "a:p", "a:t")
    office = "application/vnd.openxmlformats-officedocument."
    from veilspark.sources import media

    return [
        Format("txt", ("txt", "log"), ("text/plain",), read_text, write_text),
        Format("json", ("json",), ("application/json",), read_json, write_json),
        Format("csv", ("csv",), ("text/csv",), read_csv, write_csv, "tabular"),
        Format("html", ("html", "htm"), ("text/html",), *_markup(True)),
        Format("xml", ("xml",), ("application/xml", "text/xml"), *_markup(False)),
        Format("docx", ("docx",), (office + "wordprocessingml.document",), *docx, part=_embedded("word/media/", "word/embeddings/")),
        Format("pptx", ("pptx",), (office + "presentationml.presentation",), *pptx, part=_embedded("ppt/media/", "ppt/embeddings/")),
        Format("xlsx", ("xlsx",), (office + "spreadsheetml.sheet",), read_xlsx, write_xlsx, "tabular", _embedded("xl/media/", "xl/embeddings/", xml=r"xl/(?:comments\d*|drawings/drawing\d+)\.xml")),
        Format("wav", ("wav",), ("audio/wav", "audio/x-wav"), lambda raw: [], media.write_wav, "audio"),
        Format("rtf", ("rtf",), ("application/rtf", "text/rtf"), lambda raw: [], _missing("writing rtf")),
        Format("pdf", ("pdf",), ("application/pdf",), _missing("reading pdf needs a parser: register one"), _missing("writing pdf")),
        *(Format(n, x, (f"image/{n}",), lambda raw: [], _missing(f"{n} pixels need a decoder: register one"), "image") for n, x in (("png", ("png",)), ("jpeg", ("jpg", "jpeg")), ("tiff", ("tif", "tiff")))),
        Format("mp3", ("mp3",), ("audio/mpeg",), lambda raw: [], _missing("mp3 samples need a decoder: register one"), "audio"),
    ]


@dataclass
class Registry:
    formats: dict[str, Format] = field(default_factory=dict)

    @classmethod
    def with_built_in(cls) -> Registry:
        r = cls()
        for f in built_in():
            r.add(f)
        return r

    def add(self, f: Format) -> Registry:
        if f.id in self.formats:
            raise ValueError(f"format {f.id} is there already")
        self.formats[f.id] = f
        return self

    def replace(self, f: Format) -> Registry:
        self.formats[f.id] = f
        return self

    def find(self, extension: str | None = None, content_type: str | None = None) -> Format | None:
        if extension:
            x = extension.lower().lstrip(".")
            for f in self.formats.values():
                if x in f.extensions:
                    return f
        if content_type:
            t = content_type.partition(";")[0].strip().lower()
            for f in self.formats.values():
                if t in f.content_types:
                    return f
        return None
