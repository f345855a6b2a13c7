"""Layout of pages, on the surveyed cases."""

import pytest

from quire.pages import geometry, regions
from quire.pages.geometry import Entry


def page(*lines):
    """Entries from (x, y, text[, size])."""
    return [Entry(i, 1.0, 0.0, 0.0, 1.0, float(x), float(y), text, float(size[0]) if size else 10.0) for i, (x, y, text, *size) in enumerate(lines)]


def analyse(*lines):
    return regions.analyse(geometry.read(page(*lines)))


def kinds(*lines):
    return [r.type for r in regions.diagnose(geometry.read(page(*lines)))]


def in_order(text, *parts):
    places = [text.index(p) for p in parts]
    assert places == sorted(places), (parts, text)


def pairs(rows, top, step=14, left="Left prose line", right="Right prose line", xs=(20, 350), off=0.0, **more):
    out = []
    for i in range(rows):
        out += [(xs[0], top - i * step, f"{left} {i + 1}", *more.values()), (xs[1], top - i * step - off, f"{right} {i + 1}", *more.values())]
    return out


def test_two_columns_are_read_one_after_the_other():
    found = analyse(*pairs(5, 500, left="Left column sentence number", right="Right column sentence number"))
    assert (found.layout, found.column_count) == ("columns", 2)
    in_order(found.text, "Left column sentence number 5", "Right column sentence number 1")


def test_a_grid_is_a_table():
    cells = [["Alpha", "X-17", "4 %", "North"], ["Beta", "Y-23", "8 %", "South"], ["Gamma", "Z-42", "12 %", "West"], ["Delta", "Q-51", "16 %", "East"]]
    found = analyse(*[(x, 500 - 18 * i, t) for i, row in enumerate(cells) for x, t in zip((20, 180, 300, 410), row)])
    assert (found.layout, found.table_rows) == ("table", 4)
    assert "Beta | Y-23 | 8 % | South" in found.text


def test_heading_above_columns_that_are_off_by_a_few_points():
    lines = [(20, 580, "Full width heading " * 5), *pairs(5, 500, off=4)]
    found = analyse(*lines)
    assert found.layout == "mixed"
    in_order(found.text, "Full width heading", "Left prose line 1", "Left prose line 5", "Right prose line 1")
    assert kinds(*lines) == ["full-width", "columns"]


def test_rows_of_one_column_group_by_gaps():
    text = " paragraph line with enough text to fill the content area"
    lines = [(20, 580, "Introduction"), (20, 530, "First" + text), (20, 516, "Second" + text), (20, 502, "Third" + text), (20, 450, "Highlighted closing statement"), (20, 436, "Second highlighted closing line")]
    assert kinds(*lines) == ["full-width"] * 3


def test_adjacent_headings_are_one_region():
    lines = [(20, 590, "First heading line " * 5), (20, 574, "Second heading line " * 5), *pairs(5, 520, off=4)]
    assert kinds(*lines) == ["full-width", "columns"]
    in_order(analyse(*lines).text, "First heading line", "Second heading line", "Left prose line 1", "Left prose line 5", "Right prose line 1")


def test_captions_in_pairs_are_column_blocks():
    lines = [(20, 600, "Full width heading " * 5), (20, 560, "Full width introduction " * 4)]
    for top, which in ((450, "first"), (300, "second")):
        for step, end in ((0, "caption line"), (14, "continuation"), (28, "closing line")):
            lines += [(20, top - step, f"Left {which} {end}"), (350, top - step, f"Right {which} {end}")]
    lines += [(20, 130, "First of three blocks"), (220, 130, "Second of three blocks"), (420, 130, "Third of three blocks")]
    assert kinds(*lines) == ["full-width", "column-blocks", "column-blocks", "full-width"]
    found = analyse(*lines)
    assert found.layout == "mixed"
    in_order(found.text, "Left first continuation", "Right first caption line", "Left second continuation", "Right second caption line")


def test_blocks_beside_each_other_with_other_line_heights():
    lines = [(20, 550, "Left callout first line"), (350, 547, "Right paragraph first line"), (350, 533, "Right paragraph second line"), (20, 530, "Left callout second line"), (350, 519, "Right paragraph third line"), (20, 510, "Left callout third line"), (350, 505, "Right paragraph fourth line"), (20, 300, "Left lower caption"), (350, 300, "Right lower caption")]
    found = analyse(*lines)
    assert found.layout == "columns" and kinds(*lines)[0] == "column-blocks"
    in_order(found.text, "Left callout third line", "Right paragraph first line", "Right paragraph fourth line")


def test_a_longer_tail_stays_with_its_column():
    lines = [*pairs(5, 500, left="Left column line", right="Right column line", off=3), (20, 426, "Left continuation whose estimated width reaches across the calculated split"), (20, 412, "Second left continuation remains part of the same unequal column")]
    found = analyse(*lines)
    assert found.layout == "columns" and kinds(*lines) == ["columns"]
    in_order(found.text, "Second left continuation", "Right column line 1")


def test_columns_that_begin_and_end_at_other_heights():
    lines = [
        (350, 680, "Right callout heading"), (350, 648, "Right callout first line"), (350, 632, "Right callout second line"), (20, 566, "Left main heading"), (350, 566, "Right callout third line"),
        (20, 530, "Left introduction whose estimated width crosses the split"), (350, 526, "Right callout fourth line"), (20, 506, "Left second line whose estimated width also crosses the split"), (350, 490, "Right callout fifth line"),
        (20, 476, "Left introduction closing line"), (350, 474, "Right callout closing line"), (20, 450, "Left prose first line"), (350, 450, "Right final line"), (20, 434, "Left prose second line"), (350, 434, "Right final continuation"),
        (20, 406, "Left continuation after the short column ended"), (20, 390, "Left final continuation"),
    ]
    found = analyse(*lines)
    assert found.layout == "columns" and kinds(*lines) == ["columns"]
    in_order(found.text, "Left final continuation", "Right callout heading", "Right final continuation")


def test_prose_cards_and_products():
    lines = [(20, 556, "Page title"), (20, 527, "A subtitle spanning the content area with sufficient text for the page"), *pairs(6, 500, xs=(20, 320)), (20, 385, "Benefits heading")]
    cards = {360: ("01", "02", "03"), 346: "one", 332: "two", 318: "three", 304: ("First card line four", "Second card line four", "Third card closing"), 290: ("First card line five", "Second card closing", None), 276: ("First card closing", None, None)}
    for y, row in cards.items():
        row = row if isinstance(row, tuple) else [f"{n} card line {row}" for n in ("First", "Second", "Third")]
        lines += [(x, y, t) for x, t in zip((30, 220, 410), row) if t]
    lines += [(20, 220, "Left product heading"), (320, 220, "Right solution heading"), *pairs(4, 200, left="Left product line", right="Right solution line", xs=(20, 320))]
    found = analyse(*lines)
    assert found.layout == "mixed" and "multi-column-blocks" in kinds(*lines)
    in_order(found.text, "Right prose line 6", "Benefits heading", "First card closing", "Second card line one", "Second card closing", "Third card line one", "Third card closing", "Left product heading", "Left product line 4", "Right solution heading")


def test_cards_of_one_height_with_headings_off():
    rows = {350: ("Card one", "Card two", "Card three"), 322: "body one", 308: "body two", 294: "body three", 280: "closing"}
    lines = [(x, y, t) for y, row in rows.items() for x, t in zip((30, 220, 410), row if isinstance(row, tuple) else [f"{n} {row}" for n in ("First", "Second", "Third")])]
    found = regions.diagnose(geometry.read(page(*lines)))
    assert (found[0].type, found[0].column_count) == ("multi-column-blocks", 3)
    in_order(analyse(*lines).text, "First closing", "Card two", "Second closing", "Card three")


def test_fragments_of_prose_are_not_three_columns():
    lines = [(x, 500 - 14 * i, t) for i in range(5) for x, t in ((30, "Left prose"), (170, "middle prose"), (350, "right prose fragment"))]
    assert "multi-column-blocks" not in kinds(*lines, (30, 420, "Left closing"), (170, 406, "Middle closing"))


def test_a_subtitle_in_fragments_stays_ahead():
    lines = [(20, 560, "Section title"), (20, 532, "Natural body booster for alcohol"), (210, 532, "-free and low"), (290, 532, "-ABV beers"), *pairs(6, 503)]
    assert "multi-column-blocks" not in kinds(*lines)
    in_order(analyse(*lines).text, "-ABV beers", "Left prose line 1")


def test_full_width_is_not_carried_into_columns():
    lines = [(20, 560, "Full width introduction " * 5), *pairs(5, 510, left="Left column paragraph line", right="Right column paragraph line", size=7), (20, 426, "Left asymmetric continuation one"), (20, 412, "Left asymmetric continuation two")]
    assert kinds(*lines) == ["full-width", "columns"]
    in_order(analyse(*lines).text, "Left asymmetric continuation two", "Right column paragraph line 1")


def test_a_mark_and_a_callout_below_columns():
    lines = [*pairs(5, 500, left="Left column line", right="Right column line", off=4), (300, 390, "i"), (40, 366, "Interesting fact spanning the complete content width"), (40, 352, "Second full width callout line"), (40, 338, "Third full width callout line")]
    found = analyse(*lines)
    assert found.layout == "mixed"
    first, *rest = kinds(*lines)
    assert first == "columns" and set(rest) == {"full-width"}
    in_order(found.text, "Left column line 5", "Right column line 1", "Right column line 5", "Interesting fact")


def test_a_section_below_finished_columns():
    lines = [*pairs(8, 600, left="Left column sentence", right="Right column sentence", off=3), (20, 465, "Healthy components of hibiscus"), (28, 440, "A full width bullet line extending across the complete content area"), (28, 426, "Another full width bullet line extending across the content area"), (20, 400, "Discussed potential health benefits"), (28, 376, "A shorter bullet")]
    first, *rest = kinds(*lines)
    assert analyse(*lines).layout == "mixed" and first == "columns" and set(rest) == {"full-width"}
    in_order(analyse(*lines).text, "Left column sentence 8", "Right column sentence 1", "Right column sentence 8", "Healthy components of hibiscus")


def test_a_hyphen_at_the_end_of_a_column():
    found = analyse((20, 500, "Left first line"), (20, 486, "Left second line"), (20, 472, "Left third line"), (20, 458, "known for having a posi-"), (350, 496, "tive effect on health"), (350, 482, "Right second line"), (350, 468, "Right third line"), (350, 454, "Right fourth line"))
    assert found.layout == "columns" and "known for having a positive effect on health" in found.text and "posi-" not in found.text


def test_a_long_heading_of_one_column():
    lines = [(350, 550, "Right column starts above the left side"), (350, 536, "Right column second line"), (20, 522, "Left column heading with a moderately long title"), (20, 508, "Left column first line"), (350, 508, "Right column third line"), (20, 494, "Left column second line"), (350, 494, "Right column fourth line"), (20, 480, "Left column third line"), (350, 480, "Right column fifth line"), (20, 466, "Left column fourth line")]
    assert analyse(*lines).layout == "columns" and kinds(*lines) == ["columns"]
    in_order(analyse(*lines).text, "Left column fourth line", "Right column starts above")


def test_blocks_below_each_other_on_other_sides_are_not_parallel():
    lines = [*[(20, 550 - 14 * i, f"Left upper {n} line") for i, n in enumerate(("first", "second", "third"))], *[(350, 480 - 14 * i, f"Right lower {n} line") for i, n in enumerate(("first", "second", "third"))], (20, 300, "Left lower caption"), (350, 300, "Right lower caption")]
    assert kinds(*lines)[:2] == ["full-width", "full-width"]


def test_cards_inside_a_column():
    words = zip((742, 712, 682, 652, 622, 593, 563, 532), ("Major", "challenges", "when", "reducing", "cocoa", "powder", "in food", "applications"))
    names = ("one", "two", "three", "four", "five")
    block = lambda name, xs, top: [(x, top - 15 * i, f"{name} card {names[i]}", 7) for i, x in enumerate(xs)]
    lines = [*[(42, y, t) for y, t in words], *block("Top left", (252, 258, 259, 256, 249), 739), *block("Top right", (431,) * 4, 739), *block("Bottom left", (275, 267, 290), 608), *block("Bottom right", (430, 429, 426, 437, 422), 608)]
    assert kinds(*lines)[0] == "nested-columns"
    in_order(analyse(*lines).text, "applications", "Top left card five", "Top right card one", "Top right card four", "Bottom left card one", "Bottom left card three", "Bottom right card one")


def test_three_columns_inside_a_column():
    lines = [(x, 520 - 14 * i, f"{t} line {i + 1}", 7) for i in range(5) for x, t in ((20, "Outer left content"), (320, "First nested prose"), (410, "Second nested prose"), (500, "Third nested prose"))]
    region = regions.diagnose(geometry.read(page(*lines)))[0]
    assert (region.type, region.column_count, len(region.all_splits)) == ("nested-columns", 3, 3)
    found = analyse(*lines)
    assert found.column_count == 3
    in_order(found.text, "First nested prose line 5", "Second nested prose line 1", "Second nested prose line 5", "Third nested prose line 1")


def test_three_columns_relative_to_their_own_width():
    lines = [(630, 570, "Compact section heading", 12), *[(x, 540 - 14 * i, f"{t} compact prose line {i + 1}", 7) for i in range(5) for x, t in ((630, "First"), (805, "Second"), (980, "Third"))], *pairs(5, 380, left="Lower left page content line", right="Lower right page content line", xs=(36, 650), size=7)]
    region = regions.diagnose(geometry.read(page(*lines)))[0]
    assert (region.type, region.column_count) == ("multi-column-blocks", 3)
    in_order(analyse(*lines).text, "First compact prose line 5", "Second compact prose line 1", "Second compact prose line 5", "Third compact prose line 1")


def test_overprinted_and_turned_text():
    assert analyse((20, 500, "Visible once"), (20, 500, "Visible once")).text == "Visible once"
    turned = Entry(1, 0.0, 1.0, -1.0, 0.0, 500.0, 100.0, "Decoration", 10.0)
    assert regions.analyse(geometry.read([*page((20, 500, "Readable content")), turned])).text == "Readable content"
    assert regions.analyse([]).layout == "empty"


def test_reading():
    assert geometry.read(page((20, 500, "Hello world", 11)))[0].parts[0].x_max == pytest.approx(20 + 11 * 11 * 0.58)
    atom = geometry.atom_of(Entry(0, 2.0, 0.0, 0.0, 3.0, 20.0, 500.0, "Scaled", 10.0))
    assert (atom.size, atom.h_scale, atom.v_scale) == (10.0, 20.0, 30.0)
    rows = geometry.read([Entry(0, 1, 0, 0, 1, 20, 500, "03", 20.04), Entry(1, 1, 0, 0, 1, 60, 502, "Introduction", 11.04)])
    assert len(rows) == 1 and rows[0].parts[0].text == "03 Introduction"
    left, right = geometry.split_rows(geometry.read(page((10, 100, "Left"), (42, 100, "Right"))), 40)
    assert (left[0].parts[0].text, right[0].parts[0].text) == ("Left", "Right")


def test_wrapped_values_go_to_the_nearest_key():
    from quire.pages import tables

    rows = geometry.read(page((10, 100, "Key A"), (100, 100, "Value A"), (100, 90, "continued"), (10, 60, "Key B"), (100, 60, "Value B")))
    assert tables.records_text(rows) == "Key A | Value A continued\nKey B | Value B"
    assert tables.records_text(geometry.read(page((10, 100, "alone")))) == "alone"
