"""Repo lending: closes matched to the lots they name, then first in first out, with interest on what is matched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.ledger import BOOK, EXACT, _pieces


def _kept(lots: DataFrame, closes: DataFrame, book: tuple[str, ...]) -> DataFrame:
    """(book, open_id, close_id, matched) of closes that name a lot: in order of time, as far as the lot's principal goes and not before it was lent."""
    own = lots.select(*book, F.col("id").alias("open_id"), F.col("principal").cast(EXACT).alias("_lent"), F.struct("trade_date", "id").alias("_since"))
    named = closes.where("open_id IS NOT NULL").select(*book, "open_id", F.col("id").alias("close_id"), F.col("principal").cast(EXACT).alias("_asks"), F.struct("trade_date", "id").alias("_at"))
    met = named.join(own.hint("merge"), [*book, "open_id"]).where("_at > _since")
    w = Window.partitionBy(*book, "open_id").orderBy("_at")
    left = F.col("_lent") - F.coalesce(F.sum("_asks").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.withColumn("matched", F.greatest(F.lit(0).cast(EXACT), F.least(F.col("_asks"), left)).cast(EXACT)).where("matched > 0").select(*book, "open_id", "close_id", "matched")


def matched(lots: DataFrame, closes: DataFrame, book: tuple[str, ...] = BOOK) -> DataFrame:
    """(book, open_id, close_id, open_date, close_date, named, matched, interest, fee) of lots lent and closed.

    lots: (book, id, trade_date, principal, rate_pct, interest_days, basis, fee);
    closes: (book, id, trade_date, principal, open_id). A close that names a lot
    takes from that one alone. The others take, in order, from the oldest lots
    what the named closes leave of them: intervals of running principal, cut by
    one window, so a book is never joined with itself. No lot gives more than was
    lent; what a close asks beyond that is matched with nothing (see
    unmatched()). Interest runs for the agreed days, or from the lending to the
    close, both days counted, where none are agreed; fee is the lot's share.
    """
    kept = _kept(lots, closes, book)
    gone = kept.groupBy(*book, F.col("open_id").alias("id")).agg(F.sum("matched").alias("_gone"))
    zero = F.lit(0.0)
    row = lambda side, q: [*book, "trade_date", F.lit("").alias("trade_time"), "id", F.lit(side).alias("side"), q.cast(EXACT).alias("quantity"), zero.alias("price"), zero.alias("fee")]
    free = lots.join(gone.hint("merge"), [*book, "id"], "left").select(*row("BUY", F.col("principal").cast(EXACT) - F.coalesce("_gone", F.lit(0)))).where("quantity > 0")
    asked = closes.where("open_id IS NULL").select(*row("SELL", F.col("principal")))
    fifo = _pieces(free.unionByName(asked), book).select(*book, F.col("buy.id").alias("open_id"), F.col("sell.id").alias("close_id"), F.col("_matched").alias("matched"))
    both = kept.withColumn("named", F.lit(True)).unionByName(fifo.withColumn("named", F.lit(False)))
    terms = lots.select(*book, F.col("id").alias("open_id"), F.col("trade_date").alias("open_date"), F.col("principal").alias("_lent"), "rate_pct", "interest_days", "basis", F.col("fee").alias("_fee"))
    ends = closes.select(*book, F.col("id").alias("close_id"), F.col("trade_date").alias("close_date"))
    out = both.join(terms.hint("merge"), [*book, "open_id"]).join(ends.hint("merge"), [*book, "close_id"])
    days = F.when(F.col("interest_days") > 0, F.col("interest_days")).otherwise(F.greatest(F.lit(1), F.datediff("close_date", "open_date") + 1))
    m = F.col("matched").cast("double")
    return out.select(*book, "open_id", "close_id", "open_date", "close_date", "named", m.alias("matched"), (m * F.col("rate_pct") / 100 * days / F.col("basis")).alias("interest"), F.try_divide(m * F.col("_fee"), F.col("_lent")).alias("fee"))


def unmatched(closes: DataFrame, pieces: DataFrame, book: tuple[str, ...] = BOOK) -> DataFrame:
    """(book, id, open_id, missing): closes that found less principal than they ask."""
    found = pieces.groupBy(*book, F.col("close_id").alias("id")).agg(F.sum(F.col("matched").cast(EXACT)).alias("_found"))
    missing = (F.col("principal").cast(EXACT) - F.coalesce("_found", F.lit(0))).cast("double")
    return closes.join(found.hint("merge"), [*book, "id"], "left").select(*book, "id", "open_id", missing.alias("missing")).where("missing > 0")
