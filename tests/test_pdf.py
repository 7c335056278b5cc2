"""PDF pages without a library."""

import zlib

import pytest

from quire.sources import pdf, readers


def made(objects, trailer=b"<< /Root 1 0 R >>"):
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    return out + b"trailer\n" + trailer


def stream(body, extra=b""):
    return b"<< /Length %d %s >>\nstream\n" % (len(body), extra) + body + b"\nendstream"


def test_round_trip():
    pages = ["Hello (world) \\ é €", "", "line 1\nline 2\n\nlast   x ", "a" * 5000]
    doc = pdf.Pdf(pdf.written(pages, "A (title)"))
    assert doc.title() == "A (title)" and list(doc.pages()) == pages


def test_shapes_of_real_files():
    """An object stream, an indirect length, arrays of contents, nested pages, fonts with a map, kerning and hexadecimal strings."""
    inner = b"<< /Type /Pages /Kids [4 0 R 5 0 R] >> << /Font << /F1 7 0 R /F2 8 0 R >> >>"
    head = b"2 0 3 %d " % inner.index(b"<< /Font")
    packed = zlib.compress(head + inner)
    tounicode = b"2 beginbfchar <0001> <0041> <0002> <00DF> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<0066> <00660069>] endbfrange"
    one = b"BT /F1 12 Tf 10 700 Td [(Hel) 20 (lo) -400 (there)] TJ 0 -14 Td (n\\145xt \\(x\\)) Tj ET"
    cut = one.index(b"-400")
    two = b"BT /F2 9 Tf 1 0 0 1 10 500 Tm <000100020010001100120021> Tj 1 0 0 1 90 500 Tm <0020> Tj 1 0 0 1 10 480 Tm <0002> Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        4: b"<< /Type /Pages /Parent 2 0 R /Resources 3 0 R /Kids [6 0 R] >>",
        5: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F2 8 0 R >> >> /Contents 12 0 R >>",
        6: b"<< /Type /Page /Contents [10 0 R 11 0 R] % a comment )\n >>",
        7: b"<< /Type /Font /Subtype /Type1 >>",
        8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 13 0 R >>",
        9: stream(packed, b"/Type /ObjStm /N 2 /First %d /Filter [/FlateDecode]" % len(head)),
        10: b"<< /Length 14 0 R >>\nstream\r\n" + one[:cut] + b"\nendstream",
        11: stream(one[cut:]),
        12: stream(zlib.compress(two), b"/Filter /FlateDecode"),
        13: stream(tounicode),
        14: b"%d" % cut,
    }
    doc = pdf.Pdf(made(objects, b"<< /Root 1 0 R /Info << /Title <FEFF00C400620063> >> >>"))
    assert doc.title() == "Äbc"
    assert list(doc.pages()) == ["Hello there\nnext (x)", "Aßabcfif\nß"]


def test_broken_and_encrypted_files():
    good = pdf.written(["one", "two"])
    assert list(pdf.Pdf(good[: good.index(b"xref")]).pages()) == ["one", "two"]  # no table, no trailer
    for data in (b"", b"%PDF-1.4", b"no pdf", good[:200], b"<<" * 5000, b"((((" * 1000, b"1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj"):
        assert isinstance(list(pdf.Pdf(data).pages()), list)
    assert pdf.Pdf(b"").title() == "Untitled"
    loop = made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page >>"})
    assert list(pdf.Pdf(loop).pages()) == [""]
    with pytest.raises(ValueError):
        pdf.Pdf(made({1: b"<< /Type /Catalog >>"}, b"<< /Root 1 0 R /Encrypt 2 0 R >>"))


def test_files_command_line_and_parsers(spark, tmp_path):
    from quire.cli import main

    (tmp_path / "in").mkdir()
    for name, pages in (("first", ["Opening words\nand more", "Second part", "no heading here that is short enough to be one of them at all because it goes on"]), ("second", ["Alone"])):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(pdf.written(pages, name.upper()))
    rows = readers.pdf_pages(spark, str(tmp_path / "in")).orderBy("doc_name", "page_no").collect()
    assert [(r.doc_name, r.page_no, r.title) for r in rows] == [("first", 1, "FIRST"), ("first", 2, "FIRST"), ("first", 3, "FIRST"), ("second", 1, "SECOND")]
    assert rows[0].text == "Opening words\nand more" and rows[0].n_tokens == 4
    spark.dataSource.register(readers.PdfPages)
    got = spark.read.format("quire_pdf").load(str(tmp_path / "in" / "second.pdf")).collect()
    assert [(r.page_no, r.text, r.title) for r in got] == [(1, "Alone", "SECOND")]
    with pytest.raises(ValueError):
        readers.pdf_pages(spark, str(tmp_path / "in"), "other")
    assert main(["index", "--pdf", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark) == 0
    back = readers.index_files(spark, str(tmp_path / "out"), "*.txt").orderBy("doc_name", "ord").collect()
    assert [(r.doc_name, r.title, r.start_index, r.end_index) for r in back][:2] == [("first", "Opening words", 1, 1), ("first", "Second part", 2, 3)]
