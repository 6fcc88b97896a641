"""Text of PDF files: plain and deflated content streams, fonts with maps to Unicode.

What needs a renderer (scanned pages, encryption, fonts without a map beyond Latin-1) gives
empty pages or stray letters; a loader with a PDF library can be put in its place.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_UTF16 = ("utf-16-be", "replace")


def _plain(body: bytes) -> bytes:
    """A stream's bytes; empty if its filter is none that is known here."""
    found = _STREAM.search(body)
    if not found:
        return b""
    head, data = body[: found.start()], found[1]
    if b"/Filter" not in head:
        return data
    if b"/FlateDecode" not in head or re.search(rb"/(?:DCT|JPX|LZW|ASCII85|RunLength|CCITTFax)Decode", head):
        return b""
    return zlib.decompressobj().decompress(data)


def _objects(content: bytes) -> dict[int, bytes]:
    """All objects by number, those in object streams too; of equal numbers the last one."""
    out = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
    for body in list(out.values()):
        if b"/ObjStm" not in body[:400]:
            continue
        data, count, first = _plain(body), re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
        if not data or not count or not first:
            continue
        numbers = [int(x) for x in data[: int(first[1])].split()[: 2 * int(count[1])]]
        places = list(zip(numbers[::2], numbers[1::2], strict=True)) + [(0, len(data) - int(first[1]))]
        for (number, at), (_, end) in zip(places, places[1:], strict=False):
            out.setdefault(number, data[int(first[1]) + at : int(first[1]) + end])
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str], list[tuple[int, int, int]]]:
    """Bytes of a code, texts by code, and ranges (first, last, text of the first) of a font's map."""
    width, single, ranges = 1, {}, []
    for kind, block in re.findall(rb"begin(codespacerange|bfchar|bfrange)(.*?)end", cmap, re.S):
        codes = [re.sub(rb"\s", b"", x) for x in re.findall(rb"<([0-9A-Fa-f\s]*)>", block)]
        if kind == b"codespacerange" and codes:
            width = max(1, len(codes[0]) // 2)
        elif kind == b"bfchar":
            single |= {int(a, 16): bytes.fromhex(b.decode()).decode(*_UTF16) for a, b in zip(codes[::2], codes[1::2], strict=False)}
        elif kind == b"bfrange":
            for a, z, rest in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[.*?\])", block, re.S):
                if rest[:1] == b"[":
                    texts = re.findall(rb"<([0-9A-Fa-f]+)>", rest)
                    single |= {int(a, 16) + i: bytes.fromhex(t.decode()).decode(*_UTF16) for i, t in enumerate(texts)}
                else:
                    ranges.append((int(a, 16), int(z, 16), int(rest[1:-1], 16)))
    return width, single, ranges


def _decoded(raw: bytes, font: tuple | None) -> str:
    if font is None:
        return raw[2:].decode(*_UTF16) if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
    width, single, ranges = font
    units = b""
    for i in range(0, len(raw) - width + 1, width):
        code = int.from_bytes(raw[i : i + width], "big")
        if code in single:
            units += single[code].encode("utf-16-be", "surrogatepass")
            continue
        units += next(((code - a + first).to_bytes(2, "big") for a, z, first in ranges if a <= code <= z), b"")
    return units.decode(*_UTF16)


def _page_text(content: bytes, fonts: dict[bytes, tuple | None]) -> str:
    out: list[str] = []
    font, held = None, []
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(</[]" or token[:1] in b"+-.0123456789":
            held.append(token)
            continue
        shown = [t for t in held if t[:1] in (b"(", b"<")]
        if token == b"Tf":
            font = next((fonts.get(t[1:]) for t in held if t[:1] == b"/"), None)
        elif token in (b"Tj", b"'", b'"'):
            out += ["\n"] * (token != b"Tj") + [_decoded(_string(t), font) for t in shown[-1:]]
        elif token == b"TJ":
            for t in held:
                if t[:1] in (b"(", b"<"):
                    out.append(_decoded(_string(t), font))
                elif t[:1] == b"-" and t[1:].replace(b".", b"").isdigit() and float(t) < -200:
                    out.append(" ")
        elif token in (b"Td", b"TD", b"Tm", b"T*", b"ET") and out and not out[-1].endswith("\n"):
            same_line = token in (b"Td", b"TD") and len(held) > 1 and held[-1].strip(b"+-0.") == b""
            out.append(" " if same_line else "\n")
        held = []
    return "".join(out).strip("\n")


def pdf_pages(content: bytes) -> list[str]:
    """The text of every page in order; a file that is no PDF raises."""
    if b"%PDF" not in content[:1024]:
        raise ValueError("no PDF")
    objects = _objects(content)

    def resolved(value: bytes) -> bytes:
        ref = _REF.match(value.strip())
        return objects.get(int(ref[1]), b"") if ref else value

    def entry(body: bytes, name: bytes) -> bytes:
        found = re.search(rb"/" + name + rb"\s*(\d+\s+\d+\s+R|\[.*?\]|<<.*?>>(?=\s*(?:/|>>|$)))", body, re.S)
        return found[1] if found else b""

    def kids(number: int, seen: set[int]) -> list[int]:
        body = objects.get(number, b"")
        if number in seen:
            return []
        seen.add(number)
        if b"/Kids" not in body:
            return [number] if re.search(rb"/Type\s*/Page\b(?!s)", body) else []
        return [p for k in _REF.findall(resolved(entry(body, b"Kids"))) for p in kids(int(k), seen)]

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\s+\d", b)]
    order = [p for r in roots for p in kids(r, set())] or [n for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    pages = []
    for number in order:
        body, fonts = objects[number], {}
        holder: bytes | None = body
        while holder is not None and not (resources := resolved(entry(holder, b"Resources"))):
            parent = re.search(rb"/Parent\s+(\d+)", holder)
            holder = objects.get(int(parent[1])) if parent else None
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", resolved(entry(resources or b"", b"Font"))):
            to = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(ref), b""))
            fonts[name] = _unicode_map(_plain(objects.get(int(to[1]), b""))) if to else None
        refs = _REF.findall(entry(body, b"Contents"))
        inner = objects.get(int(refs[0]), b"") if len(refs) == 1 else b""
        if inner.strip()[:1] == b"[":
            refs = _REF.findall(inner)
        pages.append(_page_text(b"\n".join(_plain(objects.get(int(r), b"")) for r in refs), fonts))
    return pages
