"""The PDF reader, on files that are put together here."""

import base64
import zlib

import pytest

from quire.pages import pdf


def build(objects, extra=b""):
    """A file of numbered objects; the first is the catalogue."""
    out = b"%PDF-1.5\n"
    for n, body in enumerate(objects, 1):
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def simple(content, head=b"", font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", more=()):
    return build([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 595 842] /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", stream(content, head), font, *more])


TEXT = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Hello \\(you\\)) Tj 0 -14 Td [(Wor) -120 (ld)] TJ T* (caf\\351) ' ET"


@pytest.mark.parametrize("how", ["plain", "flate", "hex", "ascii85", "both"])
def test_text_and_places(how):
    flate, a85 = zlib.compress(TEXT), base64.a85encode
    data, head = {"plain": (TEXT, b""), "flate": (flate, b"/Filter /FlateDecode"), "hex": (TEXT.hex().encode() + b">", b"/Filter [/ASCIIHexDecode]"), "ascii85": (a85(TEXT) + b"~>", b"/Filter /ASCII85Decode"), "both": (a85(flate) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]")}[how]
    page = pdf.read(simple(data, head))[0]
    assert [r.text for r in page.runs] == ["Hello (you)", "World", "café"]
    assert [r.matrix[4:] for r in page.runs] == [(72.0, 700.0), (72.0, 686.0), (72.0, 686.0)]
    assert page.box == [0.0, 0.0, 595.0, 842.0] and page.runs[0].size == 12 and page.runs[0].font == "F1"
    assert [op for op, _ in page.commands] == ["BT", "Tf", "Tm", "Tj", "Td", "TJ", "T*", "'", "ET"]
    assert page.commands[5][1] == [{"t": "(", "c": "Wor"}, {"t": "n", "c": "-120"}, {"t": "(", "c": "ld"}]


def test_matrices_widths_and_runs_that_go_on():
    font = b"<< /Type /Font /Subtype /TrueType /FirstChar 97 /Widths [500 600] >>"
    page = pdf.read(simple(b"q 2 0 0 2 10 0 cm BT /F1 10 Tf 5 5 Td (ab) Tj (b) Tj ET Q", font=font))[0]
    assert page.runs[0].matrix == (2.0, 0.0, 0.0, 2.0, 20.0, 10.0) and page.runs[0].units == 1100.0
    assert page.runs[1].matrix[4] == pytest.approx(20 + 2 * 11.0)


def test_unicode_tables_and_differences():
    table = b"2 beginbfchar <0001> <0041> <0002> <00660066> endbfchar 1 beginbfrange <0010> <0012> <0391> endbfrange 1 beginbfrange <0020> <0021> [<0031> <0032>] endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R /DescendantFonts [<< /DW 900 /W [1 [400] 16 18 700] >>] >>"
    page = pdf.read(simple(b"BT /F1 1 Tf <00010002001000110020> Tj ET", font=font, more=[stream(table)]))[0]
    assert page.runs[0].text == "AffΑΒ1" and page.runs[0].units == 400 + 900 + 700 + 700 + 900
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /germandbls /uni00E4 /x] >> >>"
    assert pdf.read(simple(b"BT /F1 1 Tf (ABC) Tj ET", font=font))[0].runs[0].text == "ßäx"


def test_object_streams_and_several_contents():
    packed = b"3 0 4 90 " + (b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R] /Rotate 90 >>").ljust(90) + b"<< /Type /Font /Subtype /Type1 >>"
    body = zlib.compress(packed)
    head = b"/Type /ObjStm /N 2 /First 9 /Filter /FlateDecode"
    out = b"%PDF-1.5\n"
    for n, text in ((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 100 100] /Resources << /Font << /F1 4 0 R >> >> >>"), (5, stream(b"BT /F1 9 Tf 1 1 Td (one) Tj ET")), (6, stream(b"BT /F1 9 Tf 1 9 Td (two) Tj ET")), (7, stream(body, head))):
        out += b"%d 0 obj\n%s\nendobj\n" % (n, text)
    page = pdf.read(out)[0]
    assert [r.text for r in page.runs] == ["one", "two"] and page.rotate == 90


def test_predicted_rows():
    rows = [b"abcd", b"bcde", b"aacc"]
    data = bytes([0]) + rows[0] + bytes([2]) + bytes((y - x) & 255 for x, y in zip(rows[0], rows[1])) + bytes([1]) + bytes((y - x) & 255 for x, y in zip(b"\0" + rows[2], rows[2]))
    file = pdf.PdfFile(simple(b""))
    assert file._predicted(data, {"Predictor": 12, "Columns": 4}) == b"".join(rows)


@pytest.mark.parametrize("data", [b"", b"no file", b"%PDF-1.4 nothing", simple(TEXT, b"/Filter /LZWDecode"), simple(zlib.compress(TEXT)[:9], b"/Filter /FlateDecode").replace(b"stream\n", b"stream\n\0\0", 1), build([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [2 0 R] >>"]), build([b"<< /Type /Catalog /Pages 9 0 R >>"]), simple(TEXT).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R")])
def test_broken_files_are_one_kind_of_error(data):
    with pytest.raises(pdf.PdfError):
        pdf.read(data)
