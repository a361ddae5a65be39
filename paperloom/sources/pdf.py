"""The text of PDF pages.

Where the ``pymupdf`` package is installed it reads the pages. Otherwise a plain reader does, for
files without encryption: cross-reference tables aren't needed, objects are found by their markers,
in object streams too; content streams may be stored or deflated; strings are decoded by the font's
``ToUnicode`` map, else as Latin text.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(
    rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[01*]?", re.S
)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def page_texts(content: bytes) -> list[str]:
    """The text of each page, in order."""
    try:
        import pymupdf
    except ImportError:
        return _plain(content)
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        return [page.get_text("text") for page in doc]


def _stream(body: bytes) -> bytes | None:
    """An object's stream, inflated where it is deflated."""
    m = STREAM.search(body)
    if not m:
        return None
    if b"/FlateDecode" in body[: m.start()]:
        return zlib.decompressobj().decompress(m[1])
    return m[1]


def _objects(content: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[3] for m in OBJECT.finditer(content)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            data = _stream(body) or b""
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, data[:first].split()))
            places = [first + p for p in numbers[1::2]] + [len(data)]
            for k, number in enumerate(numbers[::2]):
                found.setdefault(number, data[places[k] : places[k + 1]])
    return found


def _value(body: bytes, key: bytes) -> bytes:
    """What follows a key in a dictionary: a list, a dictionary, or the text up to the next key."""
    m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
    if not m:
        return b""
    rest = body[m.end() :]
    if rest.startswith(b"["):
        return rest[: rest.find(b"]") + 1]
    if rest.startswith(b"<<"):
        depth, at = 0, 0
        for t in re.finditer(rb"<<|>>", rest):
            depth += 1 if t[0] == b"<<" else -1
            at = t.end()
            if not depth:
                break
        return rest[:at]
    return re.split(rb"[/>]", rest, maxsplit=1)[0]


def _followed(objects: dict[int, bytes], value: bytes) -> bytes:
    m = re.fullmatch(rb"\s*(\d+)\s+\d+\s+R\s*", value)
    return objects.get(int(m[1]), b"") if m else value


def _pages(objects: dict[int, bytes]) -> list[tuple[bytes, bytes]]:
    """Each page's dictionary with the resources that it has or inherits, in the order of the page tree."""
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not _value(b, b"Parent").strip()]
    out, todo, seen = [], [(n, b"") for n in reversed(roots)], set()
    while todo:
        n, inherited = todo.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        resources = _followed(objects, _value(body, b"Resources")) or inherited
        if re.search(rb"/Type\s*/Pages\b", body):
            todo.extend((int(k), resources) for k in reversed(REFERENCE.findall(_followed(objects, _value(body, b"Kids")))))
        else:
            out.append((body, resources))
    return out


def _unicode_map(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code."""
    out: dict[int, str] = {}
    size = max((len(m[1]) // 2 for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>", data)), default=1)
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for section in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", section):
            out[int(code, 16)] = text(to)
    for section in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", section):
            for k in range(int(low, 16), int(high, 16) + 1):
                out[k] = chr(int(to, 16) + k - int(low, 16)) if len(to) <= 4 else text(to)
    return size, out


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def unescaped(m: re.Match[bytes]) -> bytes:
        if m[1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] in (b"\n", b"\r") else ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", unescaped, token[1:-1], flags=re.S)


def _page_text(data: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The strings that the operators of a content stream show, with the line breaks that they make."""
    out: list[str] = []
    held: list[bytes] = []
    size, codes = 1, {}

    def shown(token: bytes) -> str:
        raw = _string(token)
        if not codes:
            return raw.decode("cp1252", "replace")
        return "".join(codes.get(int.from_bytes(raw[i : i + size], "big"), "") for i in range(0, len(raw), size))

    for m in TOKEN.finditer(data):
        token = m[0]
        if not (token[:1].isalpha() or token in (b"'", b'"')):
            held.append(token)
            continue
        strings = [t for t in held if t[:1] in b"(<" and t not in (b"<<", b">>")]
        if token == b"Tf" and held:
            names = [t[1:] for t in held if t.startswith(b"/")]
            size, codes = fonts.get(names[-1] if names else b"", (1, {}))
        elif token in (b"Tj", b"TJ"):
            for t in held:
                if t in strings:
                    out.append(shown(t))
                elif token == b"TJ" and re.fullmatch(rb"-\d*\.?\d+", t) and float(t) < -200:
                    out.append(" ")  # a gap as wide as a space
        elif token in (b"'", b'"'):
            out += ["\n", *map(shown, strings)]
        elif token in (b"Td", b"TD"):
            numbers = [float(t) for t in held if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
            out.append("\n" if len(numbers) > 1 and numbers[-1] else " ")
        elif token in (b"T*", b"ET", b"Tm"):
            out.append("\n")
        held = []
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def _plain(content: bytes) -> list[str]:
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise ValueError("the PDF file is encrypted")
    objects = _objects(content)
    out = []
    for body, resources in _pages(objects):
        fonts = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", _followed(objects, _value(resources, b"Font"))):
            to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(int(number), b""))
            if to:
                fonts[name] = _unicode_map(_stream(objects.get(int(to[1]), b"")) or b"")
        parts = [_stream(objects.get(int(n), b"")) or b"" for n in REFERENCE.findall(_value(body, b"Contents"))]
        out.append(_page_text(b"\n".join(parts), fonts))
    return out
