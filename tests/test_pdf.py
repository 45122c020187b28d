"""PDF files built here, classic and packed, healthy and broken, read back as lines."""

import random
import zlib

import pytest

from strataloom.operators import pipeline
from strataloom.plans.composites import _pdf
from strataloom.sources import pdf, readers


def file_of(objects, classic=True, packed=(), extra=b""):
    """A PDF of numbered objects; ``packed`` ones lie in an object stream, and then the cross-reference is a stream too."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    if packed:
        holder = max(objects) + 1
        heads, body = [], b""
        for n in packed:
            heads += [n, len(body)]
            body += objects[n] + b" "
        head = " ".join(map(str, heads)).encode() + b" "
        data = zlib.compress(head + body)
        objects = {n: x for n, x in objects.items() if n not in packed} | {holder: b"<</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>>\nstream\n" % (len(packed), len(head), len(data)) + data + b"\nendstream"}
    for n, x in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    start = len(out)
    if not packed:
        last = max(objects)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (last + 1)
        out += b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00000 f \n" for n in range(1, last + 1))
        out += b"trailer\n<</Root 1 0 R/Size %d%s>>\n" % (last + 1, extra)
    else:
        last = holder + 1
        places[last] = start
        rows = [b"\0" * 5]
        for n in range(1, last + 1):
            row = (b"\2" + holder.to_bytes(3) + bytes([packed.index(n)])) if n in packed else b"\1" + places[n].to_bytes(3) + b"\0" if n in places else b"\0" * 5
            rows.append(row)
        above, lines = bytes(5), []
        for row in rows:  # PNG's predictor "up"
            lines.append(b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True)))
            above = row
        data = zlib.compress(b"".join(lines))
        out += b"%d 0 obj\n<</Type/XRef/W[1 3 1]/Root 1 0 R/Size %d/Length %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 5>>%s>>\nstream\n" % (last, last + 1, len(data), extra) + data + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


def stream(data, more=b""):
    return b"<</Length %d%s>>\nstream\n" % (len(data), more) + data + b"\nendstream"


def one_page(content, font=b"<</Type/Font/Subtype/Type1/BaseFont/Times-Roman/Encoding/WinAnsiEncoding>>", more=None, **kind):
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]/Resources<</Font<</A 5 0 R>>/XObject<</X 6 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", 4: stream(content), 5: font}
    return file_of(objects | (more or {}), **kind)


def texts(content):
    return [r[2] for r in pdf.runs_of(content) if r[7] is None]


def test_lines_places_and_sizes():
    content = b"q 2 0 0 2 0 0 cm BT /A 10 Tf 12 TL 1 0 0 1 10 300 Tm (First) Tj ( line) Tj T* (Second \\(x\\)\\051\\\\) Tj ET Q BT /A 1 Tf 14 0 0 14 300 600 Tm [(ri) -10 (ght)] TJ 14 0 0 14 50 100 Tm [(far) -3000 (apart)] TJ ET"
    rows = list(pdf.runs_of(one_page(content)))
    assert [(r[0], r[1], r[2], r[4], r[5], r[6]) for r in rows] == [
        (1, 1, "First line", 10, 10.0, 200.0), (1, 2, "right", 1, 14.0, 200.0), (1, 3, "Second (x))\\", 10, 10.0, 224.0), (1, 4, "far", 1, 14.0, 700.0), (1, 5, "apart", 1, 14.0, 700.0),
    ]
    assert {r[3] for r in rows} == {"Times-Roman"}


def test_filters_packed_objects_and_forms():
    body = b"BT /A 10 Tf 50 700 Td (in a form) Tj ET"
    form = stream(zlib.compress(body), b"/Type/XObject/Subtype/Form/BBox[0 0 9 9]/Matrix[1 0 0 1 0 -100]/Filter/FlateDecode")
    content = b"BT /A 10 Tf 50 700 Td (on the page) Tj ET /X Do BI /W 1 /H 1 ID \x00(\xff EI BT /A 9 Tf 12 TL 50 500 Td <6566> Tj (g) ' ET"
    for kind in ({}, {"packed": (1, 2, 3, 5)}):
        assert texts(one_page(content, more={6: form}, **kind)) == ["on the page", "in a form", "ef", "g"]
    hexed = {4: stream(body.hex().encode() + b">", b"/Filter/ASCIIHexDecode")}
    assert texts(one_page(b"", more=hexed)) == ["in a form"]
    # a form that shows itself ends
    assert texts(one_page(b"/X Do", more={6: stream(b"BT /A 10 Tf 5 5 Td (x) Tj ET /X Do", b"/Subtype/Form")}))


def test_encodings():
    named = b"<</Subtype/Type1/BaseFont/F/FirstChar 65/Widths[700 700 700 700]/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/eacute/ccedilla 67/uni20AC/germandbls]>>>>"
    assert texts(one_page(b"BT /A 10 Tf (ABCD\xe0) Tj ET", named)) == ["éç€ßà"]
    cmap = b"begincmap 1 begincodespacerange <0000><ffff> endcodespacerange 2 beginbfchar <0001> <00660069> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079>] endbfrange endcmap"
    wide = b"<</Subtype/Type0/BaseFont/Some-Bold/Encoding/Identity-H/DescendantFonts[7 0 R]/ToUnicode 8 0 R>>"
    more = {7: b"<</Subtype/CIDFontType2/DW 600/W[16[500 510] 32 33 400]>>", 8: stream(cmap)}
    assert texts(one_page(b"BT /A 10 Tf <00010002001000110012002000210099> Tj ET", wide, more)) == ["fi😀ABCxy"]


def test_incremental_update_and_inherited_pages():
    first = one_page(b"BT /A 10 Tf (old) Tj ET")
    at, start = len(first) + 1, int(first.split(b"startxref")[1].split()[0])
    new = b"4 0 obj\n" + stream(b"BT /A 10 Tf (new) Tj ET") + b"\nendobj\n"
    updated = first + b"\n" + new + b"xref\n4 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R/Size 6/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, start, at + len(new))
    assert texts(updated) == ["new"]


def test_broken_files():
    good = one_page(b"BT /A 10 Tf (kept) Tj ET")
    assert texts(good.replace(b"startxref\n", b"startxref\n9")) == ["kept"]  # found again without its table
    assert texts(one_page(b"BT /A 10 Tf (kept) Tj ET", packed=(1, 2, 3, 5)).replace(b"startxref\n", b"startxref\n9")) == ["kept"]
    for bad in (b"", b"no pdf", good[:40], one_page(b"", extra=b"/Encrypt 5 0 R"), b"%PDF-1.4\n1 0 obj\n<</Root"):
        (row,) = pdf.runs_of(bad)
        assert row[0] == 0 and row[2] is None and row[7]
    # a page whose content can't be read costs itself alone
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[3 0 R 4 0 R 2 0 R]>>", 3: b"<</Contents 5 0 R/Resources<</Font<</A 7 0 R>>>>>>", 4: b"<</Contents 6 0 R/Resources<</Font<</A 7 0 R>>>>>>", 5: stream(b"xx", b"/Filter/FlateDecode"), 6: stream(b"BT /A 10 Tf (two) Tj ET"), 7: b"<</BaseFont/F>>"}
    rows = list(pdf.runs_of(file_of(objects)))
    assert [(r[0], r[2]) for r in rows] == [(1, None), (2, "two")] and "Broken" in rows[0][7]


def test_damaged_bytes_never_raise():
    base = one_page(b"BT /A 10 Tf 50 700 Td (some text) Tj [(a) 3 (b)] TJ ET", packed=(1, 2, 3, 5))
    rng = random.Random(1)
    for _ in range(400):
        data = bytearray(base)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        list(pdf.runs_of(bytes(data[: rng.randint(1, len(data))] if rng.random() < 0.3 else data)))


def test_deep_brackets():
    assert texts(one_page(b"[" * 50_000 + b"]" * 50_000 + b" TJ BT /A 10 Tf (x) Tj ET")) in (["x"], [])


def test_whole_files_and_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(_pdf([[("Helvetica-Bold", [20], 20, "Title"), ("Helvetica", [10], 40, "Body, Apache-2.0 (é)")], [("Courier", [10], 20, "code()")]]))
    (tmp_path / "in/b.pdf").write_bytes(b"broken")
    (tmp_path / "in/c.pdf").write_bytes(_pdf([[("Helvetica", [10], 10, " ")]]))
    files = readers.read_files(spark, str(tmp_path / "in"))
    runs = readers.pdf_runs(files).cache()
    assert [(r.path[-5:], r.page) for r in readers.broken_files(runs).collect()] == [("b.pdf", 0)]
    assert sorted((r.page, r.text, r.y) for r in readers.lines_of_runs(runs).collect()) == [(1, "Body, Apache-2.0 (é)", 40.0), (1, "Title", 20.0), (2, "code()", 20.0)]
    assert {r.path[-5:]: r.text for r in readers.texts_of_runs(files, runs).collect()} == {"a.pdf": "Title\nBody, Apache-2.0 (é)\ncode()\n", "b.pdf": None, "c.pdf": " \n"}
    rows = {r.name: r for r in pipeline.auto_detect(files).collect()}
    assert rows["a.pdf"].route == "OSS" and "\n= Title\n\nBody, Apache-2.0 (é)\n[source,text]\n----\ncode()\n----\n" in rows["a.pdf"].text
    assert rows["b.pdf"].text == rows["c.pdf"].text == "= [Document vide]\n\n" and rows["b.pdf"].zone == "UNKNOWN"


def test_files_are_parsed_once(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def parser(content):
        count.add(1)
        if content == b"bad":
            raise ValueError("no")
        return [(1, 1, "x", "F", 10.0, 1.0)]

    files = spark.createDataFrame([(f"{i}.pdf", bytearray(b"bad" if i == 3 else b"x")) for i in range(10)], "path string, content binary")
    found = pipeline.auto_detect(files, parser)
    assert found.count() == 10 and pipeline.chunks_of(found).count() >= 9
    assert count.value == 10


@pytest.mark.parametrize("text", [b"(a", b"<<", b"]", b"/", b"1 0 R", b"<41", b"\xff"])
def test_odd_content(text):
    list(pdf.runs_of(one_page(b"BT /A 10 Tf (ok) Tj ET " + text)))
