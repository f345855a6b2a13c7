"""Aligning positioned text with the commands of its content stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.pages import plain, with_fields
from quire.pages.bulk import numbers
from quire.pages.alignment import PLACES, RUNS, SHOWS, advanced, carried, chosen, goes_on

PAGE = ["doc_id", "page_no"]


def align(entries: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """The entries with the text of their commands where that is usable, and whether each goes on from the one before.

    ``commands`` is (doc_id, page_no, cmd_idx, op, operand, raw): the bytes, if
    there, stand for the operand.  The i-th showing command belongs to the i-th
    entry of its page.  On a page where the two differ in number nothing is
    changed and nothing goes on.  Without ``commands`` the entries are lists, a
    row for each page, beside a list ``commands``; so are those that come back.
    """
    if commands is None:
        return _align_pages(entries)
    own = [c for c in entries.columns if c not in (*PAGE, "continues")]
    listed = entries.groupBy(*PAGE).agg(F.collect_list(F.struct(*own)).alias("entries"))
    given = commands.groupBy(*PAGE).agg(F.collect_list(F.struct("cmd_idx", "op", "operand", "raw")).alias("commands"))
    done = _align_pages(listed.join(given, PAGE, "left")).select(*PAGE, F.inline("entries"))
    return done.select(*[c for c in entries.columns if c != "continues"], "continues")


def _align_pages(pages: DataFrame) -> DataFrame:
    if "raw" not in pages.schema["commands"].dataType.elementType.names:
        pages = pages.withColumn("commands", F.transform("commands", lambda c: F.struct(c["cmd_idx"], c["op"], c["operand"], F.lit(None).cast("binary").alias("raw"))))
    return with_fields(pages, {"text": "string", "continues": "boolean"}, lambda part: dict(zip(("text", "continues"), _aligned(part))), ("commands",))


def _aligned(part: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """(texts, continues) of all entries of the pages, as they are given."""
    counts = [pc.fill_null(part.column(n).value_lengths(), 0).to_numpy(zero_copy_only=False) for n in ("entries", "commands")]
    page, of = (np.repeat(np.arange(part.num_rows), n) for n in counts)
    entries, commands = part.column("entries").flatten(), part.column("commands").flatten()
    number = commands.field("cmd_idx").to_numpy(zero_copy_only=False)
    order = np.lexsort((number, of))
    of, number = of[order], number[order]
    op = commands.field("op").take(pa.array(order))
    is_one = lambda names: pc.is_in(op, pa.array(names)).to_numpy(zero_copy_only=False)
    shows = is_one(SHOWS)
    flags = goes_on(of, number, shows, is_one(RUNS), is_one(PLACES))
    same = np.bincount(of[shows], minlength=part.num_rows) == counts[0]
    # of pages with as many shows as entries both are met in order
    shown = np.flatnonzero(shows & same[of])
    place = np.lexsort((entries.field("entry_idx").to_numpy(zero_copy_only=False), page))
    place = place[same[page[place]]]
    values = (plain(commands.field(n).take(pa.array(order[shown]))) for n in ("raw", "operand"))
    old = entries.field("text")
    texts = np.array(plain(old), object)
    texts[place] = [chosen(raw, operand, text) for raw, operand, text in zip(*values, texts[place].tolist())]
    continues = np.zeros(len(page), bool)
    continues[place] = flags[shown]
    return pa.array(texts, "string", from_pandas=False), pa.array(continues)


def run_places(pages: DataFrame) -> DataFrame:
    """The entries of each page with ``continues`` carried over from the list ``raw`` and x moved to where the run before ended.

    An entry goes on only where its neighbour in the page is its neighbour in
    ``raw`` as well: entries that were left out between the two break a run.
    Both have entry_idx of the source and are met in its order.  A chain goes
    on while entries follow each other in the source, are flagged and are
    recorded at nearly the same place as the one before; the moves of a chain
    are running sums of ``advance``.
    """
    return with_fields(pages, {"continues": "boolean", "x": "double"}, _placed, ("raw",))


def _placed(part: pa.RecordBatch) -> dict[str, pa.Array]:
    page, of = (np.repeat(np.arange(part.num_rows), pc.fill_null(part.column(n).value_lengths(), 0).to_numpy(zero_copy_only=False)) for n in ("entries", "raw"))
    entries, raw = part.column("entries").flatten(), part.column("raw").flatten()
    order = np.lexsort((entries.field("entry_idx").to_numpy(zero_copy_only=False), page))
    index = numbers(entries.field("entry_idx"), np.int64)[order]
    x, y, advance = (numbers(v)[order] for v in (entries.field("x"), entries.field("y"), pc.fill_null(entries.field("advance"), 0.0)))
    there = np.lexsort((raw.field("entry_idx").to_numpy(zero_copy_only=False), of))
    flags = pc.fill_null(raw.field("continues"), False).to_numpy(zero_copy_only=False)[there]
    goes = carried((page[order], index), (of[there], raw.field("entry_idx").to_numpy(zero_copy_only=False)[there]), flags)
    back = np.argsort(order)
    return {"continues": pa.array(goes[back]), "x": pa.array(advanced(page[order], index, goes, x, y, advance)[back])}
