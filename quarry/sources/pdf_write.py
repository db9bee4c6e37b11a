"""Texts as PDF files, in the forms that readers meet: plain objects with a cross-reference table, compressed ones with fonts of two bytes, object and cross-reference streams."""

from __future__ import annotations

import re
import zlib

ESCAPED = re.compile(rb"[()\\\0-\x1f]")
PLAIN, MAPPED, PACKED = range(3)


def _stream(body: bytes, extra: bytes = b"", packed: bool = True) -> bytes:
    data = zlib.compress(body) if packed else body
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", extra, data)


def _to_unicode(codes: dict[str, int]) -> bytes:
    rows = [b"<%04X> <%s>" % (n, c.encode("utf-16-be").hex().encode()) for c, n in codes.items()]
    parts = [b"%d beginbfchar\n%s\nendbfchar" % (len(rows[i : i + 100]), b"\n".join(rows[i : i + 100])) for i in range(0, len(rows), 100)]
    return b"/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"\n".join(parts) + b"\nendcmap end"


def write_pdf(text: str, form: int = PLAIN, page_lines: int = 50) -> bytes:
    """A file with the text's lines, `page_lines` a page. Texts that the plain form's encoding lacks letters for are mapped."""
    if form == PLAIN:
        try:
            text.encode("cp1252")
        except UnicodeEncodeError:
            form = MAPPED
    lines = text.split("\n")
    codes = {c: n for n, c in enumerate(sorted(set(text) - {"\n"}), 1)}
    hexes = {ord(c): f"{n:04X}" for c, n in codes.items()}

    def said(line: str) -> bytes:
        if form == PLAIN:
            return b"(" + ESCAPED.sub(lambda m: b"\\" + m[0] if m[0] in b"()\\" else b"\\%03o" % m[0][0], line.encode("cp1252")) + b")"
        return b"<%s>" % line.translate(hexes).encode("ascii")

    def shown(line: str) -> bytes:
        if form == PACKED and len(line) > 1:  # a pair set apart a little
            return b"[%s -20 %s] TJ" % (said(line[: len(line) // 2]), said(line[len(line) // 2 :]))
        return said(line) + b" Tj"

    pages = [lines[i : i + page_lines] for i in range(0, len(lines), page_lines)]
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    if form == PLAIN:
        objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    else:
        objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 4 0 R >>"
        objects[4] = _stream(_to_unicode(codes))
        objects[5] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Made /DW 500 /W [1 [500 500] 3 %d 500] >>" % (len(codes) + 3)
    kids = []
    for page in pages:
        n = max(objects) + 1
        kids.append(b"%d 0 R" % n)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        body = b"BT /F1 10 Tf 12 TL 40 800 Td\n" + b"\n".join((shown(x) if x else b"") + b" T*" for x in page) + b"\nET"
        objects[n + 1] = _stream(body, packed=form != PLAIN)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> /MediaBox [0 0 595 842] >>" % (len(kids), b" ".join(kids))
    out, places = bytearray(b"%PDF-1.5\n"), {}
    if form == PACKED:  # all that is no stream goes into one
        inner = {n: x for n, x in objects.items() if b"stream\n" not in x}
        heads, bodies = [], b""
        for n, x in inner.items():
            heads.append(b"%d %d" % (n, len(bodies)))
            bodies += x + b" "
        first = b" ".join(heads) + b" "
        holder = max(objects) + 1
        objects = {n: x for n, x in objects.items() if n not in inner} | {holder: _stream(first + bodies, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(first)))}
        places = {n: (2, holder, i) for i, n in enumerate(inner)}
    for n in sorted(objects):
        places[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
    start, size = len(out), max(places) + 1
    if form != PACKED:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        out += b"".join(b"%010d 00000 n \n" % places[n][1] if n in places else b"0000000000 00000 f \n" for n in range(1, size))
        out += b"trailer\n<< /Size %d /Root 1 0 R >>\n" % size
    else:
        places[size] = (1, start, 0)
        rows = [bytes([places.get(n, (0, 0, 0))[0]]) + places.get(n, (0, 0, 0))[1].to_bytes(4, "big") + places.get(n, (0, 0, 0))[2].to_bytes(2, "big") for n in range(size + 1)]
        above, body = bytes(7), b""
        for row in rows:
            body += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
            above = row
        out += b"%d 0 obj\n%s\nendobj\n" % (size, _stream(body, b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>" % (size + 1)))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)
