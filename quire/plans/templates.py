"""Pages of known layout for every document, with the result that each must give.

A slot's text is made of the document's hash, so that its length, and with it
the geometry, is fixed while its letters differ.  Results are written by hand,
as slots in reading order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.positions import spread


@dataclass(frozen=True)
class Slot:
    x: float
    y: float
    length: int
    size: float = 10.0


@dataclass(frozen=True)
class Template:
    slots: tuple[Slot, ...]
    layout: str
    columns: int
    table_rows: int
    confidence: float
    #: text: strings between the numbers of slots
    text: tuple[int | str, ...]
    #: (type, columns, rows, splits)
    regions: tuple[tuple[str, int, int, int], ...]


def _lines(*numbers: int) -> list[int | str]:
    out: list[int | str] = []
    for n in numbers:
        out += ["\n", n] if out else [n]
    return out


def _cells(*rows: tuple[int, ...]) -> list[int | str]:
    out: list[int | str] = []
    for row in rows:
        out += ["\n"] if out else []
        for k, n in enumerate(row):
            out += [" | ", n] if k else [n]
    return out


def _blocks(*blocks: list[int | str]) -> tuple[int | str, ...]:
    out: list[int | str] = []
    for block in blocks:
        out += ["\n\n", *block] if out else block
    return tuple(out)


def _pairs(rows: int, top: float, left: int, right: int, off: float = 0.0) -> tuple[Slot, ...]:
    return tuple(s for i in range(rows) for s in (Slot(20, top - 14 * i, left), Slot(350, top - 14 * i - off, right)))


_even, _odd = range(0, 10, 2), range(1, 10, 2)
TEMPLATES = (
    # two columns of lines at the same heights
    Template(_pairs(5, 500, 29, 30), "columns", 2, 0, 0.95, _blocks(_lines(*_even), _lines(*_odd)), (("columns", 2, 5, 1),)),
    # a grid of four starts
    Template(tuple(Slot(x, 500 - 18 * i, n) for i in range(4) for x, n in zip((20, 180, 300, 410), (5, 4, 4, 5))), "table", 1, 4, 0.91, tuple(_cells(*[tuple(range(4 * i, 4 * i + 4)) for i in range(4)])), (("table", 1, 4, 0),)),
    # a heading above columns whose lines are off by four points
    Template((Slot(20, 580, 95), *_pairs(5, 500, 17, 18, 4.0)), "mixed", 2, 0, 0.695, _blocks([0], _lines(*range(1, 11, 2)), _lines(*range(2, 11, 2))), (("full-width", 1, 1, 0), ("columns", 2, 10, 1))),
    # one column
    Template(tuple(Slot(20, 500 - 14 * i, 40 + i) for i in range(5)), "plain", 1, 0, 0.9, tuple(_lines(*range(5))), (("full-width", 1, 5, 0),)),
    # captions in pairs below a heading, three texts at the foot
    Template(
        (Slot(20, 600, 95), Slot(20, 560, 96), *_pairs(3, 450, 23, 24), *_pairs(3, 300, 24, 25), Slot(20, 130, 21), Slot(220, 130, 22), Slot(420, 130, 21)),
        "mixed", 2, 0, 0.5 + 0.2 + 0.25 * 7 / 9 - 0.01,
        _blocks(_lines(0, 1), _lines(2, 4, 6), _lines(3, 5, 7), _lines(8, 10, 12), _lines(9, 11, 13), [14, " ", 15, " ", 16]),
        (("full-width", 1, 2, 0), ("column-blocks", 2, 3, 1), ("column-blocks", 2, 3, 1), ("full-width", 1, 1, 0)),
    ),
    # three cards with headings that stand off
    Template(
        tuple(Slot(x, y, n) for y, row in ((350, (8, 8, 10)), (322, (14, 15, 14)), (308, (14, 15, 14)), (294, (16, 17, 16)), (280, (13, 14, 13))) for x, n in zip((30, 220, 410), row)),
        "columns", 3, 0, 0.95, _blocks(*[_lines(*range(k, 15, 3)) for k in range(3)]), (("multi-column-blocks", 3, 5, 2),),
    ),
    # three columns inside the right one
    Template(tuple(Slot(x, 520 - 14 * i, n, 7.0) for i in range(5) for x, n in zip((20, 320, 410, 500), (25, 25, 26, 25))), "columns", 3, 0, 0.95, _blocks(*[_lines(*range(k, 20, 4)) for k in range(4)]), (("nested-columns", 3, 5, 3),)),
    # two tables of keys and values beside each other
    Template(tuple(Slot(x, 500 - 18 * i, n) for i in range(4) for x, n in zip((20, 160, 350, 490), (6, 9, 7, 8))), "columns", 2, 0, 0.95, _blocks(_cells(*[(4 * i, 4 * i + 1) for i in range(4)]), _cells(*[(4 * i + 2, 4 * i + 3) for i in range(4)])), (("side-by-side-tables", 2, 4, 1),)),
)


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_no, entries and what they share: one page for every document, of the template of its number's remainder, as a list."""
    slots = F.array(*[F.array(*[F.struct(F.lit(float(s.x)).alias("x"), F.lit(float(s.y)).alias("y"), F.lit(s.length).alias("n"), F.lit(s.size).alias("size")) for s in t.slots]) for t in TEMPLATES])
    own = F.col("doc_id").cast("string")
    text = lambda s, i: F.substring(F.repeat(F.md5(F.concat(own, F.lit(":"), i.cast("string"))), 4), F.lit(1), s["n"])
    placed = F.transform("slots", lambda s, i: F.struct(i.alias("entry_idx"), s["x"].alias("x"), s["y"].alias("y"), text(s, i).alias("text"), s["size"].alias("font_size")))
    one, zero = F.lit(1.0), F.lit(0.0)
    docs = spread(docs.select("doc_id")).withColumn("slots", F.element_at(slots, (F.col("doc_id") % len(TEMPLATES) + 1).cast("int")))
    return docs.select("doc_id", F.lit(1).alias("page_no"), placed.alias("entries"), one.alias("a"), zero.alias("b"), zero.alias("c"), one.alias("d"))


def entries(docs: DataFrame) -> DataFrame:
    """The entries of ``pages`` as rows."""
    return pages(docs).select("doc_id", "page_no", "a", "b", "c", "d", F.inline("entries")).select("doc_id", "page_no", "entry_idx", "a", "b", "c", "d", "x", "y", "text", "font_size")


def boxes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(1).alias("page_no"), F.array(*map(F.lit, (0.0, 0.0, 595.0, 842.0))).alias("box"), F.lit(0).alias("rotate"))


def slot_sql(doc: str, number: str, length: str) -> str:
    return f"substr(repeat(md5({doc} || ':' || {number}), 4), 1, {length})"


def text_values() -> str:
    """(t, place, slot, n, literal) of every template's text, for SQL."""
    rows = []
    for t, template in enumerate(TEMPLATES):
        for place, part in enumerate(template.text):
            if isinstance(part, int):
                rows.append(f"({t}, {place}, {part}, {template.slots[part].length}, '')")
            else:
                rows.append(f"({t}, {place}, -1, 0, '{part}')")
    return ", ".join(rows).replace("\n", "' || chr(10) || '")


def text_sql() -> str:
    """Common table expressions ``parts`` and ``texts`` (doc_id, t, text)."""
    return f"""
parts(t, place, slot, n, literal) AS (VALUES {text_values()}),
texts AS (SELECT doc_id, doc_id % {len(TEMPLATES)} AS t, string_agg(CASE WHEN slot < 0 THEN literal ELSE {slot_sql('doc_id', 'slot', 'n')} END, '' ORDER BY place) AS text FROM documents JOIN parts ON parts.t = doc_id % {len(TEMPLATES)} GROUP BY ALL)"""
