"""Diagnosis of pages and vector artwork, on the surveyed cases."""

import re

import pytest

from quire.pages import artwork, diagnosis, geometry, overlap
from quire.pages.geometry import Entry

BOX = [0.0, 0.0, 595.0, 842.0]


def entries(*runs, size=10.0):
    return [Entry(i, 1.0, 0.0, 0.0, 1.0, float(x), float(y), t, size) for i, (x, y, t) in enumerate(runs)]


def show(page, text, **more):
    return diagnosis.visualize(page, BOX, 0, text, 1, [], **more)


def test_columns_keep_their_own_texts():
    left, right = "Left column sentence with enough characters to overlap the gutter", "Right column sentence"
    found = show(entries((20, 500, left), (350, 500, right)), f"{left}\n\n{right}")
    assert [m.text for m in found.regions] == [left, right] and found.text.count("<mark ") == 2


def test_hyphens_and_repeats():
    found = show(entries((20, 500, "mallow fa-"), (20, 485, "mily"), (20, 450, "Repeated"), (20, 435, "Repeated"), (20, 420, "-")), "mallow family\n\nRepeated Repeated")
    assert len(found.regions) == 4 and found.text.count("<mark ") == 4 and ">mallow fa</mark>" in found.text


def test_words_are_linked_by_their_neighbours():
    found = show(entries((20, 500, "that"), (50, 500, "feel playful"), (350, 500, "concepts"), (405, 500, "that"), (435, 500, "deliver")), "that feel playful\n\nconcepts that deliver")
    assert re.findall(r'data-region-id="([^"]+)"[^>]*>that</mark>', found.text) == ["page-1-region-1", "page-1-region-4"]


def test_words_form_lines():
    found = show(entries((20, 500, "One"), (45, 500, "two"), (70, 500, "three")), "One two three")
    assert len(found.regions) == 3 and len(found.lines) == 1
    line = found.lines[0]
    assert (line.text, line.start, line.stop) == ("One two three", 0, 13) and found.line_text.count("<mark ") == 1


def test_boxes():
    wide = show([Entry(0, 2.0, 0.0, 0.0, 2.0, 20.0, 500.0, "Metric text", 10.0)], "Metric text", units={0: 5000.0}).regions[0].box
    assert wide.width == pytest.approx((100.0 + 1.6) / 595.0 * 100.0, abs=0.001)
    high = show([Entry(0, 2.0, 0.0, 0.0, 3.0, 20.0, 500.0, "Scaled text", 10.0)], "Scaled text").regions[0].box
    assert high.height == pytest.approx(30 * 1.02 / 842 * 100, abs=0.001) and high.top == pytest.approx((842 - (500 + 30 * 0.82)) / 842 * 100, abs=0.001)


def test_runs_that_go_on_are_moved():
    page = [Entry(i, 10.0, 0.0, 0.0, 10.0, 20.0, 500.0, t, 1.0) for i, t in enumerate(("Regular ", "bold ", "regular"))]
    units = dict.fromkeys(range(3), 1000.0)
    found = show(page, "Regular bold regular", units=units, flags={0: False, 1: True, 2: True})
    assert [m.box.left for m in found.regions] == pytest.approx([(x - 0.8) / 595 * 100 for x in (20, 30, 40)], abs=0.001)
    still = show(page[:2], "Regular bold", units=units, flags={0: False, 1: False})
    assert still.regions[0].box.left == still.regions[1].box.left


def test_turned_pages_have_no_boxes():
    found = diagnosis.visualize(entries((20, 500, "a < b")), BOX, 90, "a < b", 1, [])
    assert not found.regions and found.text == "a &lt; b"
    assert not diagnosis.visualize(entries((20, 500, "ab")), None, 0, "ab", 1, []).regions


PAGE = [0.0, 0.0, 600.0, 800.0]


def rows(*runs):
    return geometry.read([Entry(i, 1.0, 0.0, 0.0, 1.0, float(x), float(y), t, s) for i, (x, y, t, s) in enumerate(runs)])


def test_artwork_in_a_band_without_text():
    text = rows((80, 700, "Extractable heading", 20.0), (80, 620, "Extractable introduction", 10.0), (80, 40, "Footer", 8.0))
    paths = "\n".join(f"{120 + i % 4 * 70} {180 + i // 4 * 45} 35 24 re f" for i in range(16))
    assert artwork.detect(text, PAGE, paths) == [(120.0, 180.0, 365.0, 339.0)]
    assert artwork.detect(text, PAGE, "q 2 0 0 2 0 0 cm " + "\n".join(f"{60 + i % 4 * 35} {90 + i // 4 * 22.5} 17.5 12 re f" for i in range(16)) + " Q") == [(120.0, 180.0, 365.0, 339.0)]
    assert artwork.detect(text, PAGE, paths.replace(" f", " n")) == []
    assert artwork.detect(text, PAGE, "BT (re f) Tj ET " * 20) == [] and artwork.detect(text, None, paths) == []
    assert artwork.detect(rows((80, 700, "Heading", 20.0)), PAGE, "100 100 30 30 re f 150 100 30 30 re f") == []
    assert artwork.detect(rows((80, 600, "Page content", 10.0)), PAGE, "\n".join(f"{100 + i % 10 * 35} 770 18 12 re f" for i in range(20))) == []


def test_matrices():
    assert artwork.transform(artwork.compose((1, 0, 0, 1, 5, 6), (2, 0, 0, 3, 1, 1)), 1, 1) == (13, 22)
    assert artwork.painted("0 0 m 10 0 l 10 20 l h S 1 2 m 3 4 5 6 7 8 c f*") == [(0, 0, 10, 20), (1, 2, 7, 8)]


def test_overlaps():
    found = overlap.pairs(entries((29.2, 622.13, "Juice Drinks"), (30.1, 622.25, "Energy Drinks"), size=11.04), {}, 10)
    assert len(found) == 1 and found[0][:2] == (0, 1) and found[0][2] > 90
    assert overlap.pairs(entries((20, 500, "Left"), (200, 500, "Right"), (20, 500, "Left")), {}, 10) == []
    run = entries((20, 500, "Regular text"), (20, 500, "bold text"), (20, 500, "regular again"))
    assert overlap.pairs(run, {0: False, 1: True, 2: True}, 10) == [] and len(overlap.pairs(run, {}, 10)) == 3
    assert len(overlap.pairs(run, {}, 2)) == 2
    # 60 point runs, 10 points apart: within a fifth of their size
    assert len(overlap.pairs(entries((20, 500, "Heading one"), (20, 510, "Heading two"), size=60.0), {}, 10)) == 1
