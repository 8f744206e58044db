"""Text of PDF files, read with the standard library.

Covers what most writers produce: plain and Flate-compressed streams, object streams, page trees and
fonts with a ToUnicode map or one-byte text. Fonts in other encodings give what their bytes spell in
Latin-1; scanned pages give no text, which is where a registered recogniser takes over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
#: Strings, hexadecimal strings, numbers, names and operators of a page.
_PIECE = re.compile(rb"\((?P<said>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|/(?P<name>[^\s/<>\[\]()]+)|(?P<number>-?\d*\.?\d+)|(?P<op>[A-Za-z'\"*]+)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in an array of strings, in thousandths of the letter size, that stands for a space.
SPACE = -180


class Encrypted(ValueError):
    pass


def _plain(dictionary: bytes, body: bytes) -> bytes:
    if b"FlateDecode" not in dictionary:
        return b"" if b"/Filter" in dictionary else body
    out = zlib.decompressobj()
    try:
        return out.decompress(body)
    except zlib.error:
        return b""


def _objects(data: bytes) -> dict[int, bytes]:
    """The text of every object by number, those of object streams too."""
    found = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(found.values()):
        packed = _STREAM.match(body) if b"/ObjStm" in body[:400] else None
        if packed:
            inside = _plain(packed[1], packed[2])
            first = re.search(rb"/First\s+(\d+)", packed[1])
            start = int(first[1]) if first else 0
            heads = [int(x) for x in inside[:start].split()]
            places = [*heads[1::2], len(inside) - start]
            for k, number in enumerate(heads[::2]):
                found.setdefault(number, inside[start + places[k] : start + places[k + 1]])
    return found


def _value(body: bytes, key: bytes) -> bytes:
    """What stands behind a name in a dictionary: up to the closing bracket, or a word or a reference."""
    at = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
    if not at:
        return b""
    rest = body[at.end() :]
    for opening, closing in ((b"<<", b">>"), (b"[", b"]")):
        if rest.startswith(opening):
            depth, i = 0, 0
            while i < len(rest):
                if rest.startswith(opening, i):
                    depth, i = depth + 1, i + len(opening)
                elif rest.startswith(closing, i):
                    depth, i = depth - 1, i + len(closing)
                    if not depth:
                        return rest[:i]
                else:
                    i += 1
            return rest
    return re.match(rb"\d+\s+\d+\s+R|/?[^\s/<>\[\]]*", rest)[0]


class _File:
    def __init__(self, data: bytes) -> None:
        if b"/Encrypt" in data:
            raise Encrypted("encrypted")
        self.objects = _objects(data)

    def at(self, value: bytes) -> bytes:
        """What a value refers to, or itself."""
        ref = _REF.fullmatch(value.strip())
        return self.objects.get(int(ref[1]), b"") if ref else value

    def stream(self, value: bytes) -> bytes:
        parts = _STREAM.match(self.at(value))
        return _plain(parts[1], parts[2]) if parts else b""

    def pages(self) -> list[tuple[bytes, bytes]]:
        """Pages in reading order, each with its resources, which may come from above."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[tuple[bytes, bytes]] = []
        seen: set[bytes] = set()
        todo = [(_value(root, b"Pages"), b"")]
        while todo:
            ref, above = todo.pop()
            body = self.at(ref)
            if not body or ref in seen:
                continue
            seen.add(ref)
            own = self.at(_value(body, b"Resources")) or above
            kids = _REF.findall(self.at(_value(body, b"Kids")))
            if kids:
                todo += [(k + b" 0 R", own) for k in reversed(kids)]
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append((body, own))
        return out or [(b, self.at(_value(b, b"Resources"))) for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def letters(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """For each font name, what its codes mean; empty without a map."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.at(_value(resources, b"Font"))):
            out[name] = _unicode(self.stream(_value(self.objects.get(int(number), b""), b"ToUnicode")))
        return out

    def text(self, page: bytes, resources: bytes) -> str:
        contents = _value(page, b"Contents")
        refs = _REF.findall(contents if contents.startswith(b"[") or _STREAM.match(self.at(contents)) else self.at(contents))
        return _said(b"\n".join(self.stream(r + b" 0 R") for r in refs), self.letters(resources))


def _hex(text: bytes) -> bytes:
    text = re.sub(rb"\s", b"", text)
    return bytes.fromhex((text + b"0" * (len(text) % 2)).decode())


def _unicode(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    wide = lambda x: _hex(x).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {_hex(a): wide(b) for a, b in re.findall(rb"<([^>]*)>\s*<([^>]*)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, one, many in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[(.*?)\])", block, re.S):
            low, high, size = int(_hex(a).hex() or "0", 16), int(_hex(b).hex() or "0", 16), len(_hex(a))
            each = [wide(x) for x in re.findall(rb"<([^>]*)>", many)]
            base = wide(one)
            for k in range(min(high - low + 1, 65_536)):
                meant = each[k] if k < len(each) else base[:-1] + chr(ord(base[-1]) + k) if base else ""
                out[(low + k).to_bytes(size, "big")] = meant
    return out


def _literal(said: bytes) -> bytes:
    said = re.sub(rb"\\\r?\n", b"", said)
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), said, flags=re.S)


def _meant(code: bytes, letters: dict[bytes, str]) -> str:
    if not letters:
        return code[2:].decode("utf-16-be", "replace") if code.startswith(b"\xfe\xff") else code.decode("latin-1")
    size = max(map(len, letters))
    return "".join(letters.get(code[i : i + size], "") for i in range(0, len(code), size))


def _said(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """What the text operators of a page show, a new line where the position moves down."""
    out: list[str] = []
    held: list[str | float] = []
    name, letters = b"", {}
    for m in _PIECE.finditer(content):
        if m["said"] is not None:
            held.append(_meant(_literal(m["said"]), letters))
        elif m["hex"] is not None:
            held.append(_meant(_hex(m["hex"]), letters))
        elif m["number"]:
            held.append(float(m["number"]))
        elif m["name"]:
            name = m["name"]
        else:
            op, numbers = m["op"], [x for x in held if not isinstance(x, str)]
            if op == b"Tf":
                letters = fonts.get(name, {})
            elif op in (b"T*", b"'", b'"', b"ET") or op in (b"Td", b"TD", b"Tm") and numbers and (op == b"Tm" or numbers[-1]):
                out.append("\n")
            elif op in (b"Td", b"TD"):
                out.append(" ")
            if op in (b"Tj", b"TJ", b"'", b'"'):
                out += [x if isinstance(x, str) else " " if op == b"TJ" and x < SPACE else "" for x in held]
            held = []
    return re.sub(r"\n\s*", "\n", "".join(out)).strip()


def pages(data: bytes) -> Iterator[str]:
    """The text of each page; ``Encrypted`` if it can't be read."""
    file = _File(data)
    for page, resources in file.pages():
        yield file.text(page, resources)
