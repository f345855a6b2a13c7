"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of each 9 neighbouring 5-gram hashes of a document the least is kept, so any
13 words that it shares with an item hold a kept one.  Items keep every 5-gram
that is least of some window, ties included.  A document's kept gram whose hash
is one of theirs is extended to all 13 words that hold it, and those that are
an item's count: only whole shared windows are joined with items, so a phrase
that many items and documents have in common does not multiply them.  Items of
fewer than 13 words are joined as whole sequences with the documents' sequences
of that length.

Defined results: a null text has no words and no hits; an item without words
fits nowhere; an item without an id marks words but is not listed; documents
that repeat with the same key and text each give their row; an empty benchmark
leaves every document clean; an empty table gives an empty table.  Of equal
hashes in a window (a tie) documents keep the first and items all.  A text of
any length is one row's array of words, linear in its length.  Only the named
columns of both tables are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import ascii_lower, cut, let

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: bytes of the benchmark's fingerprints, words included, that are still broadcast; more are joined by shuffling
BROADCAST_BYTES = 48 << 20

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: as _BREAK in text that still has its upper-case letters
_BREAK_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def count_words(text: Column) -> Column:
    """As size(words_of(text)), without lower-casing."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK_ANY), "")).cast("long")


def _hashes(words: Column) -> Column:
    """Hashes of all 5-grams, from the words' hashes, with the last four bits clear; needs 5 words."""
    each = F.transform(words, lambda w: F.xxhash64(w))
    grams = lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - (GRAM - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, GRAM)]).bitwiseAND(F.lit(-16)))
    return let(each, grams)


def _least_of_nine(code: Column) -> Column:
    """The least of each 9 neighbours, by the least of three and then of three such; needs 9 elements."""
    threes = F.transform(code, lambda x, i: F.least(x, F.coalesce(F.get(code, i + 1), x), F.coalesce(F.get(code, i + 2), x)))
    nines = lambda t: F.transform(F.slice(t, F.lit(1), F.size(t) - (WINDOW - 1)), lambda x, i: F.least(x, F.get(t, i + 3), F.get(t, i + 6)))
    return let(threes, nines)


def _around(words: Column, at: Column) -> tuple[Column, Column]:
    """(count of words before, words): up to 8 words before a gram, it, and up to 8 after it."""
    before = F.least(at - 1, F.lit(SPAN - GRAM))
    return before, F.slice(words, at - before, before + SPAN)


def _document_prints(text: Column) -> Column:
    """array<struct<hash, at, before, around, n_words>> of the least hash of each window.

    The place in its window is put into the hash's last four bits, so that one
    array_min gives the hash and the place.
    """

    def of(words: Column) -> Column:
        coded = let(_hashes(words), lambda h: F.transform(h, lambda x, i: x.bitwiseOR((i + 1).cast("long").bitwiseAND(F.lit(15)))))

        def picked(code: Column) -> Column:
            least = F.transform(_least_of_nine(code), lambda x, i: i + 1 + (x.bitwiseAND(F.lit(15)).cast("int") - i - 1).bitwiseAND(F.lit(15)))

            def entry(at: Column) -> Column:
                before, around = _around(words, at)
                return F.struct(F.element_at(code, at).bitwiseAND(F.lit(-16)).alias("hash"), at.alias("at"), before.alias("before"), F.array_join(around, " ").alias("around"), F.size(words).alias("n_words"))

            return F.transform(F.array_distinct(least), entry)

        return F.when(F.size(words) >= SPAN, let(coded, picked))

    return let(words_of(text), of)


def _item_grams(items: DataFrame) -> DataFrame:
    """hash: every gram that is least of some window of an item of 13 or more words, each once."""

    def of(words: Column) -> Column:
        least = lambda h: F.transform(F.sequence(F.lit(1), F.size(words) - SPAN + 1), lambda i: F.array_min(F.slice(h, i, WINDOW)))
        return let(_hashes(words), lambda h: F.array_distinct(least(h)))

    return items.where(F.size("words") >= SPAN).select(F.explode(of(F.col("words"))).alias("hash")).distinct()


def _item_windows(items: DataFrame) -> DataFrame:
    """words, item_id: the windows of 13 words of each item that has as many."""
    w = F.col("words")
    each = F.transform(F.sequence(F.lit(1), F.size(w) - SPAN + 1), lambda i: F.array_join(F.slice(w, i, SPAN), " "))
    return items.where(F.size(w) >= SPAN).select(F.explode(each).alias("words"), "item_id").distinct()


def _windows_about(around: Column, before: Column, at: Column) -> Column:
    """array<struct<words, start>>: the windows of 13 words that hold a gram, within the words around it."""
    least = F.greatest(F.lit(0), before - (SPAN - GRAM))
    most = F.least(before, F.size(around) - SPAN)
    window = lambda i: F.struct(F.array_join(F.slice(around, i + 1, SPAN), " ").alias("words"), (at - before + i).alias("start"))
    return F.when(most >= least, F.transform(F.sequence(least, most), window))


def _shared(df: DataFrame, words: Column) -> DataFrame:
    """The table, to be broadcast if the bytes of its words and 64 for each row stay within the bound."""
    size = df.agg(F.sum(F.octet_length(words) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, text_hash, n_words, start, stop, item_id: where documents share 13 words, or a whole shorter item, with items."""
    items = cut(items.select(F.col(item_key).alias("item_id"), words_of(F.col(item_text)).alias("words")))
    grams = _shared(cut(_item_grams(items)), F.lit(""))
    windows = cut(_item_windows(items))
    windows = _shared(windows, F.col("words"))
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    own = source.select("key", "text_hash", F.inline(_document_prints(F.col("text")))).join(grams, "hash", "left_semi")
    wide = own.withColumn("around", F.split("around", " ")).select("key", "text_hash", "n_words", F.inline(_windows_about(F.col("around"), F.col("before"), F.col("at"))))
    out = wide.join(windows, "words").select("key", "text_hash", "n_words", "start", (F.col("start") + SPAN - 1).alias("stop"), "item_id")
    lengths = [r[0] for r in items.select(F.size("words").alias("n")).where(f"n BETWEEN 1 AND {SPAN - 1}").distinct().collect()]  # 12 at most
    if lengths:
        whole = cut(items.where(F.size("words").between(1, SPAN - 1)).select(F.array_join("words", " ").alias("words"), "item_id").distinct())
        whole = _shared(whole, F.col("words"))

        def runs(w: Column) -> Column:
            of = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda j: F.struct(F.array_join(F.slice(w, j, n), " ").alias("words"), j.alias("start"), (j + n - 1).alias("stop"), F.size(w).alias("n_words")))).otherwise(F.array())
            return F.flatten(F.array(*[of(n) for n in sorted(lengths)]))

        short = source.select("key", "text_hash", F.inline(let(words_of(F.col("text")), runs))).join(whole, "words")
        out = out.unionByName(short.select("key", "text_hash", "n_words", "start", "stop", "item_id"))
    return out


def by_document(found: DataFrame) -> DataFrame:
    """key, text_hash, n_words, n_hit, items: what the hits of one document cover; both sets are bounded by the document and the benchmark."""
    grouped = found.groupBy("key", "text_hash", "n_words").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"]))))
    return grouped.select("key", "text_hash", F.col("n_words").cast("long"), F.size(covered).cast("long").alias("n_hit"), "items")


def _is_bad(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = by_document(hits(docs, items, key, text)).drop("n_words")
    every = docs.select(F.col(key), F.xxhash64(text).alias("h"), count_words(F.col(text)).alias("n_words"))
    joined = every.join(found, (F.col("h") == F.col("text_hash")) & F.col(key).eqNullSafe(F.col("key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<long>")), lambda x: x.cast("string")))
    return joined.select(F.col(key), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), _is_bad(n_hit, F.col("n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all columns, that share no window with an item; one hit word is enough to go."""
    bad = hits(docs, items, key, text).select(F.col("key").alias("_bad"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, (F.xxhash64(docs[text]) == bad["_hash"]) & docs[key].eqNullSafe(bad["_bad"]), "left_anti")
