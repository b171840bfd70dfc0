"""A small reader of PDF files: pages in order, their text in simple fonts, and how many images their own resources name.

It reads objects by scanning, streams without a filter or with FlateDecode, object streams, the page tree with inherited
resources, and the text operators. A string is read by its font: by its ToUnicode map if it has one, else in WinAnsi, MacRoman or Latin-1
with the Differences whose glyph names tell a character. Composite fonts without a map, encrypted files and other filters are beyond it:
such a page gives an error and the document goes on.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|<[0-9A-Fa-f\s]*>|\(|[^\s<>\[\]()/%{}]+|[{}]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class _Parser:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        while m := _TOKEN.match(self.data, self.at):
            self.at = m.end()
            if not m[0].isspace() and not m[0].startswith(b"%"):
                return m[0]
        return None

    def string(self) -> bytes:
        """After an opening parenthesis."""
        out, depth = bytearray(), 1
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                e = self.data[self.at : self.at + 1]
                octal = re.match(rb"[0-7]{1,3}", self.data[self.at : self.at + 3])
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at += len(octal[0])
                else:
                    if e not in b"\r\n":
                        out += _ESCAPES.get(e, e)
                    self.at += 1
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def value(self, token: bytes | None = None) -> object:
        t = token if token is not None else self.token()
        if t is None:
            return None
        if t == b"<<":
            out: dict[str, object] = {}
            while (k := self.token()) not in (b">>", None):
                out[k[1:].decode("latin-1")] = self.value()
            return out
        if t == b"[":
            items = []
            while (k := self.token()) not in (b"]", None):
                items.append(self.value(k))
            return items
        if t == b"(":
            return self.string()
        if t.startswith(b"<"):
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if t.startswith(b"/"):
            return Name(t[1:].decode("latin-1"))
        if re.fullmatch(rb"\d+", t):
            save = self.at
            if re.fullmatch(rb"\d+", (self.token() or b"-")) and self.token() == b"R":
                return Ref(int(t))
            self.at = save
            return int(t)
        try:
            return float(t)
        except ValueError:
            return {b"true": True, b"false": False, b"null": None}.get(t, t)


class Document:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF file")
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("encrypted")
        self.data = data
        self.offsets = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.packed: dict[int, object] = {}
        for number in list(self.offsets):
            head = data[self.offsets[number] : self.offsets[number] + 400]
            if b"/ObjStm" in head:
                d, body = self.stream(number)
                p = _Parser(body)
                pairs = [(p.value(), p.value()) for _ in range(int(d.get("N", 0)))]
                for n, at in pairs:
                    self.packed[int(n)] = _Parser(body, int(d["First"]) + int(at)).value()

    def get(self, x: object) -> object:
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            x = _Parser(self.data, self.offsets[int(x)]).value() if int(x) in self.offsets else self.packed.get(int(x))
        return None

    def stream(self, number: int) -> tuple[dict, bytes]:
        p = _Parser(self.data, self.offsets[number])
        d = p.value()
        if not isinstance(d, dict) or p.token() != b"stream":
            raise ValueError("no stream")
        at = p.at + (2 if self.data[p.at : p.at + 2] == b"\r\n" else 1)
        length = self.get(d.get("Length"))
        end = at + length if isinstance(length, int) else self.data.index(b"endstream", at)
        body = self.data[at:end]
        filters = self.get(d.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) != "FlateDecode" or d.get("DecodeParms"):
                raise ValueError(f"unsupported filter {f}")
            body = zlib.decompress(body)
        return d, body

    def pages(self) -> list[dict]:
        roots = [o for n in [*self.offsets, *self.packed] if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Catalog"]
        if not roots:
            raise ValueError("no catalogue")
        out: list[dict] = []

        def walk(x: object, resources: object, depth: int) -> None:
            node = self.get(x)
            if not isinstance(node, dict) or depth > 50:
                return
            resources = node.get("Resources", resources)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for k in kids:
                    walk(k, resources, depth + 1)
            else:
                out.append(node | {"Resources": resources})

        walk(roots[-1].get("Pages"), None, 0)
        return out

    def text(self, page: dict) -> str:
        contents = page.get("Contents")
        parts = contents if isinstance(contents, Ref) else self.get(contents)
        if isinstance(parts, Ref) and isinstance(self.get(parts), list):
            parts = self.get(parts)
        refs = parts if isinstance(parts, list) else [parts] if parts is not None else []
        content = b"\n".join(self.stream(int(r))[1] for r in refs if isinstance(r, Ref))
        resources = self.get(page.get("Resources"))
        named = self.get(resources.get("Font")) if isinstance(resources, dict) else None
        return shown_text(content, {name: Font(self, font) for name, x in named.items() if isinstance(font := self.get(x), dict)} if isinstance(named, dict) else {})

    def image_count(self, page: dict) -> int:
        resources = self.get(page.get("Resources"))
        named = self.get(resources.get("XObject")) if isinstance(resources, dict) else None
        return sum(isinstance(o := self.get(v), dict) and o.get("Subtype") == "Image" for v in named.values()) if isinstance(named, dict) else 0


def _decoded(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


# Glyph names of characters that aren't letters of ASCII, as far as Differences commonly name them.
_GLYPHS = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright underscore".split(),
        " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]_",
        strict=True,
    )
) | dict(zip("aacute eacute iacute oacute uacute ntilde udieresis Aacute Eacute Iacute Oacute Uacute Ntilde Udieresis questiondown exclamdown degree ordmasculine ordfeminine endash emdash quoteleft quoteright quotedblleft quotedblright bullet ellipsis fi fl".split(), [*"áéíóúñüÁÉÍÓÚÑÜ¿¡°ºª–—‘’“”•…", "fi", "fl"], strict=True))
_CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


def _units(x: bytes) -> str:
    return bytes.fromhex(x.decode()).decode("utf-16-be", "replace")


class Font:
    """How a font's strings are read."""

    def __init__(self, doc: Document, font: dict):
        self.composite = font.get("Subtype") == "Type0"
        self.map: dict[int, str] | None = None
        self.width = 2 if self.composite else 1
        encoding = doc.get(font.get("Encoding"))
        self.codec, self.differences = _CODECS.get(str(encoding), "latin-1"), {}
        if isinstance(encoding, dict):
            self.codec = _CODECS.get(str(doc.get(encoding.get("BaseEncoding"))), "latin-1")
            code = 0
            for x in doc.get(encoding.get("Differences")) or []:
                if isinstance(x, Name):
                    known = x if len(x) == 1 else _GLYPHS.get(x) or (chr(int(x[3:7], 16)) if re.fullmatch(r"uni[0-9A-F]{4}", x) else None)
                    self.differences[code] = known
                    code += 1
                elif isinstance(x, int):
                    code = x
        if isinstance(font.get("ToUnicode"), Ref):
            self.map = self._to_unicode(doc.stream(int(font["ToUnicode"]))[1])

    def _to_unicode(self, cmap: bytes) -> dict[int, str]:
        out: dict[int, str] = {}
        spaces = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
        if spaces:
            self.width = max(1, len(spaces[1]) // 2)
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
            codes = _HEX.findall(block)
            out |= {int(a, 16): _units(b) for a, b in zip(codes[::2], codes[1::2], strict=False)}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
            for lo, hi, to, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.DOTALL):
                first, last = int(lo, 16), min(int(hi, 16), int(lo, 16) + 0xFFFF)
                if listed:
                    out |= {first + i: _units(x) for i, x in enumerate(_HEX.findall(listed))}
                elif to:
                    base = _units(to)
                    out |= {first + i: base[:-1] + chr(ord(base[-1]) + i) for i in range(last - first + 1)} if base else {}
        return out

    def read(self, raw: bytes) -> str:
        if self.map is not None:
            codes = [int.from_bytes(raw[i : i + self.width]) for i in range(0, len(raw), self.width)]
            return "".join(self.map.get(c, "" if self.composite else chr(c)) for c in codes)
        if self.composite:
            raise ValueError("a composite font without a map to characters")
        if not self.differences:
            return _decoded(raw) if self.codec == "latin-1" else raw.decode(self.codec, "replace")
        out = []
        for b in raw:
            if b in self.differences and self.differences[b] is None:
                raise ValueError("a font with unknown glyph names")
            out.append(self.differences.get(b) or bytes([b]).decode(self.codec, "replace"))
        return "".join(out)


def shown_text(content: bytes, fonts: dict[str, Font] | None = None) -> str:
    """What the text operators of a page's content show; a move to another line is a line feed, a wide gap a space."""
    read = _decoded
    p, stack, out = _Parser(content), [], []

    def newline() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    while (t := p.token()) is not None:
        v = p.value(t)
        if not (isinstance(v, bytes) and v == t and t not in (b"(",)):
            stack.append(v)
            continue
        if t == b"Tf" and len(stack) >= 2:
            read = fonts[stack[-2]].read if fonts and stack[-2] in fonts else _decoded
        elif t in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            if t != b"Tj":
                newline()
            out.append(read(stack[-1]))
        elif t == b"TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                if isinstance(x, bytes):
                    out.append(read(x))
                elif isinstance(x, (int, float)) and x < -200 and out and not out[-1].endswith(" "):
                    out.append(" ")
        elif t in (b"T*", b"ET") or t in (b"Td", b"TD") and len(stack) >= 2 and stack[-1] != 0:
            newline()
        elif t == b"Tm":
            newline()
        stack = []
    return "".join(out).strip("\n")


def page_texts(data: bytes, max_pages: int | None = None) -> list[tuple[str | None, int, str | None]]:
    """(text, images, error) of each page; no page for what is no PDF file. Pages beyond max_pages are counted but not read."""
    try:
        doc = Document(data)
        pages = doc.pages()
    except (ValueError, KeyError, IndexError, TypeError, zlib.error, AttributeError):
        return []
    out: list[tuple[str | None, int, str | None]] = []
    for i, page in enumerate(pages):
        if max_pages is not None and i >= max_pages:
            out.append((None, 0, None))
            continue
        images, text, error = 0, None, None
        try:
            text = doc.text(page)
            images = doc.image_count(page)
        except (ValueError, KeyError, IndexError, TypeError, zlib.error, AttributeError) as e:
            error = None if text is not None else str(e) or type(e).__name__
        out.append((text, images, error))
    return out
