"""Text cut into chunks by folds over arrays: no Python, no shuffle, a document's work stays in its row.

A long text is held as blocks of ``size`` characters, so looking at a window costs a window whatever the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions import text as tx

# The shortest pack that is closed, and the signs after which a blank makes a cut of its own.
LEAST_PACK = 50
SENTENCE_SIGNS = ".!?;,"


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _read(blocks: Column, size: int, start: Column, length: Column | int) -> Column:
    """``length`` characters (two blocks at most) from ``start`` (from 0)."""
    first = F.floor(start / size).cast("int")
    near = F.concat(*[F.coalesce(F.get(blocks, first + k), F.lit("")) for k in range(3)])
    return F.substring(near, (start - first * size + 1).cast("int"), length.cast("int") if isinstance(length, Column) else F.lit(length))


def _cut_after(window: Column, size: int) -> Column:
    """Characters up to and with the last cut mark of a window of ``size`` + 2 characters; 0 without one.

    A mark that ends in a blank is found by its blank, but for one that straddles the limit.
    """
    def marked(w: Column) -> Column:
        def placed(back: Column) -> Column:
            return F.when(back == 0, 0).otherwise(F.length(F.substring(w, 1, size + 1)) - back + 1)
        inside = F.replace(F.substring(w, 1, size + 1), F.lit("\n"), F.lit(" "))
        straddles = F.substring(w, size + 1, 2).rlike(f"^[{SENTENCE_SIGNS}] ")
        return F.when(straddles, size + 1).otherwise(tx.let(F.locate(" ", F.reverse(inside)), placed))
    return tx.let(window, marked)


def window_chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of the cleaned text, each ending at the last mark before its limit."""
    def long_text(blocks: Column, n: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), _no_texts().alias("out"))

        def step(state: Column, _: Column) -> Column:
            at = state["at"]

            def cut(end: Column) -> Column:
                out = tx.let(tx.trimmed(_read(blocks, size, at, end - at)), lambda piece: F.when(piece == "", state["out"]).otherwise(F.concat(state["out"], F.array(piece))))
                return F.struct(F.greatest(end - overlap, at + 1).alias("at"), (end >= n).alias("done"), out.alias("out"))
            mark = _cut_after(_read(blocks, size, at, size + 2), size)
            end = F.when(at + size >= n, n).otherwise(tx.let(mark, lambda m: F.when(m > 1, at + m).otherwise(at + size)))
            return F.when(state["done"], state).otherwise(tx.let(end, cut))

        def folded(turns: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), turns), start, step)
        # Windows whose only marks stand near their start move on by one character; only then are more turns needed.
        usual = folded((F.ceil(n / max(1, size - overlap)) * 2 + 4).cast("int"))
        return tx.let(usual, lambda s: F.when(s["done"], s["out"]).otherwise(folded(n)["out"]))

    def cleaned(t: Column) -> Column:
        def by_length(n: Column) -> Column:
            blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
            return F.when(n == 0, _no_texts()).when(n <= size, F.array(t)).otherwise(tx.let(blocks, lambda b: long_text(b, n)))
        return tx.let(F.length(t), by_length)
    return F.when(text.isNotNull(), tx.let(tx.clean_content(text), cleaned))


def packed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs packed up to ``size``; the end of a closed pack opens the next. Only the last pack is cut by windows."""
    gap = F.lit("\n\n")
    parts = F.filter(F.transform(F.split(text, "\n{2,}"), tx.trimmed), lambda p: p != "")
    start = F.struct(F.lit("").alias("held"), _no_texts().alias("closed"))

    def step(state: Column, part: Column) -> Column:
        held, closed = state["held"], state["closed"]
        tail = tx.trimmed(F.right(held, F.lit(overlap))) if overlap > 0 else F.lit("")
        fits = (F.length(held) + 2 + F.length(part) <= size) | (F.length(held) < LEAST_PACK)
        return (F.when(held == "", F.struct(part.alias("held"), closed.alias("closed")))
                .when(fits, F.struct(F.concat(held, gap, part).alias("held"), closed.alias("closed")))
                .otherwise(F.struct(tx.let(tail, lambda t: F.when(t == "", part).otherwise(F.concat(t, gap, part))).alias("held"), F.concat(closed, F.array(held)).alias("closed"))))

    def ended(state: Column) -> Column:
        last = F.when(F.length(state["held"]) > size, window_chunks(state["held"], size, overlap)).otherwise(F.array(state["held"]))
        return F.filter(F.transform(F.concat(state["closed"], last), tx.clean_content), lambda c: c != "")
    return F.when(text.isNotNull(), tx.let(F.aggregate(parts, start, step), ended))
