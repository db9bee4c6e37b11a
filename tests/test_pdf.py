"""PDF text: files in several forms give back what was written, and damaged ones what can be found."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.sources import convert, pdf, pdf_write

TEXT = "Grüße, (a) \\ b: ça va?\nsecond line with  two blanks\n\n    indented\nlast"


def words(pages):
    return " ".join(" ".join(pages).split())


@pytest.mark.parametrize("form", [pdf_write.PLAIN, pdf_write.MAPPED, pdf_write.PACKED])
def test_forms(form):
    pages = pdf.page_texts(pdf_write.write_pdf(TEXT, form))
    assert [x for x in pages[0].split("\n")] == [x for x in TEXT.split("\n") if x]
    long = "\n".join(f"line {i} × 😀 שלום" for i in range(120))
    pages = pdf.page_texts(pdf_write.write_pdf(long, form))
    assert len(pages) == 3 and "\n".join(pages) == long


@given(st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=60), st.sampled_from([0, 1, 2]))
@settings(max_examples=60, deadline=None)
def test_any_letters(text, form):
    assert words(pdf.page_texts(pdf_write.write_pdf(text, form))) == words([text])


def test_damaged_files_are_searched():
    for form in (pdf_write.PLAIN, pdf_write.MAPPED, pdf_write.PACKED):
        whole = pdf_write.write_pdf(TEXT, form)
        cut = whole[: whole.rfind(b"startxref")]
        assert words(pdf.page_texts(cut)) == words([TEXT])
        assert words(pdf.page_texts(b"some bytes before\n" + whole)) == words([TEXT])
    for bad in (b"", b"no pdf", b"%PDF-1.4\nstartxref\n9\n%%EOF"):
        with pytest.raises(ValueError, match="no PDF"):
            pdf.page_texts(bad)
    with pytest.raises(ValueError, match="encrypted"):
        pdf.page_texts(pdf_write.write_pdf(TEXT).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))


def made(content, fonts=b"/F1 << /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [65 /eacute /uni05D0 /fi] >> /FirstChar 65 /Widths [500 500 500] >>", more=b""):
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj "
        b"3 0 obj << /Type /Page /Contents [4 0 R 5 0 R] /Resources << /Font << " + fonts + b" >> /XObject << /X 6 0 R >> >> >> endobj "
        b"4 0 obj << /Length 9999 >> stream\n" + content + b"\nendstream endobj 5 0 obj << >> stream\nBT /F1 9 Tf 0 -99 Td (end) Tj ET\nendstream endobj "
        b"6 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -50] >> stream\nBT /F1 9 Tf 5 20 Td (form) Tj ET\nendstream endobj " + more
    )


@pytest.mark.parametrize(
    "content,lines",
    [
        (b"BT /F1 10 Tf 10 50 Td (ABC) Tj 0 -20 Td [(x) -900 (y) 20 (z)] TJ ET", ["éאfi".replace("fi", "ﬁ"), "x yz", "end"]),
        (b"BT /F1 10 Tf 1 0 0 1 10 10 Tm (low) Tj 1 0 0 1 10 70 Tm (high) Tj ET", ["high", "low", "end"]),
        (b"BT /F1 10 Tf 12 TL 10 50 Td (one) Tj (\\164w\\\no) ' 1 1 (three) \" ET", ["one", "two", "three", "end"]),
        (b"q 1 0 0 1 0 300 cm BT /F1 10 Tf (up) Tj ET Q BT /F1 10 Tf 0 10 Td <6d6964> Tj ET % note (x) Tj", ["up", "mid", "end"]),
        (b"BT /F1 10 Tf 0 90 Td (top) Tj ET /X Do", ["top", "form", "end"]),
        (b"BT /F1 10 Tf 0 5 Td (a) Tj 30 0 Td (b) Tj ET BI /W 1 ID \x00 (no) Tj \nEI BT /F1 10 Tf 0 -20 Td (c) Tj Tj ET", ["a b", "c", "end"]),
    ],
)
def test_text_operators(content, lines):
    assert pdf.page_texts(made(content))[0].split("\n") == lines


def test_revisions_filters_and_predictors():
    first = pdf_write.write_pdf("old text")
    place = len(first)
    new = b"4 0 obj << /Type /Page /Parent 2 0 R /Contents 9 0 R >> endobj\n9 0 obj << /Filter [/ASCIIHexDecode /FlateDecode] /Length 1 >> stream\n" + zlib.compress(b"BT /F1 9 Tf (new text) Tj ET").hex().encode() + b">\nendstream endobj\n"
    at9, xref = place + new.index(b"9 0 obj"), place + len(new)
    again = first + new + b"xref\n4 1\n%010d 00000 n \n9 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Size 10 /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (place, at9, int(first.split(b"startxref\n")[1].split()[0]), xref)
    assert pdf.page_texts(again) == ["new text"]
    rows = [bytes([1, 2, 3, 4]), bytes([9, 9, 9, 9]), bytes([0, 50, 3, 255])]
    for rule in range(5):
        above, body = bytes(4), b""
        for row in rows:
            body += bytes([rule])
            for j, x in enumerate(row):
                left, up, corner = row[j - 1] if j else 0, above[j], above[j - 1] if j else 0
                p = left + up - corner
                paeth = min((left, up, corner), key=lambda v: abs(p - v))  # noqa: B023
                body += bytes([(x - (0, left, up, (left + up) // 2, paeth)[rule]) & 255])
            above = row
        assert pdf.unpredicted(body, {"Predictor": 15, "Columns": 4}) == b"".join(rows)


def test_conversion_dispatches_to_a_reader_of_scans(spark, tmp_path):
    (tmp_path / "text.pdf").write_bytes(pdf_write.write_pdf("hello there\n" * 70))
    (tmp_path / "scan.pdf").write_bytes(pdf_write.write_pdf(""))
    files = convert.read_files(spark, [str(tmp_path)])
    got = {r["path"].rsplit("/", 1)[-1]: r for r in convert.convert(files).collect()}
    assert got["text.pdf"]["pages"] == 2 and got["text.pdf"]["error"] is None and "**Page 2**" in got["text.pdf"]["text"]
    assert "reader of scans is needed" in got["scan.pdf"]["error"]
    pdf.register_ocr(lambda data, dpi, lang: [f"read at {dpi} in {lang}"])
    try:
        assert "read at 150 in heb" in pdf.pdf(pdf_write.write_pdf(""), dpi=150, lang="heb")[0]
        assert "read at 300 in None" in pdf.pdf(pdf_write.write_pdf("text"), force_ocr=True)[0]
    finally:
        pdf.register_ocr(None)
    rows = pdf.read_pages(files.unionByName(spark.createDataFrame([("x.pdf", b"junk")], "path string, content binary"))).collect()
    assert sorted((r["path"].rsplit("/", 1)[-1], r["page"], r["error"] is None) for r in rows) == [("scan.pdf", 1, True), ("text.pdf", 1, True), ("text.pdf", 2, True), ("x.pdf", None, False)]


@pytest.mark.parametrize("form", [pdf_write.MAPPED, pdf_write.PACKED])
def test_what_pages_share_is_read_once(monkeypatch, form):
    text = "\n".join(f"line {i} (of) \\ some é" for i in range(600))
    data, made, decoded = pdf_write.write_pdf(text, form), [], []
    font, whole = pdf.Font.__init__, pdf.Pdf.decoded
    monkeypatch.setattr(pdf.Font, "__init__", lambda self, *a: made.append(1) or font(self, *a))
    monkeypatch.setattr(pdf.Pdf, "decoded", lambda self, stream: decoded.append(stream.dict.get("Type")) or whole(self, stream))
    pages = pdf.page_texts(data)
    assert len(pages) == 12 and "\n".join(pages) == text
    assert len(made) == 1 and decoded.count("ObjStm") <= 1
