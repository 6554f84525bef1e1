"""Trade ledgers: FIFO lots, rounds, cash, holdings and returns, all books in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import upto
from panelforge.operators.account_days import account_days
from panelforge.operators.calendar import as_of, on_days

ORDER = ("trade_date", "trade_time", "id", "price", "quantity")


#: Running quantities are exact: they are grouped and compared.
EXACT = "decimal(28,6)"
BOOK = ("account_id", "code")


def _net(book: tuple[str, ...]) -> Column:
    """Running quantity bought less sold after each trade."""
    q = F.col("quantity").cast(EXACT)
    w = Window.partitionBy(*book).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.col("side") == "BUY", q).otherwise(-q)).over(w).cast(EXACT)


def _lots(trades: DataFrame, book: tuple[str, ...]) -> DataFrame:
    """Trades with _net, _q (what a buy adds as a lot, what a sell finds in stock; none: null) and _end, the running sum of _q on the trade's own side.

    What a sell asks beyond the stock held then is matched with nothing (see
    oversold()), so no sell meets a later buy: the oversold part so far is how
    far the running quantity has been below zero. All is one sort of the books.
    """
    w = Window.partitionBy(*book).orderBy(*ORDER)
    q, none = F.col("quantity").cast(EXACT), F.lit(0).cast(EXACT)
    buy = F.col("side") == "BUY"
    t = trades.withColumn("_net", _net(book)).withColumn("_over", F.greatest(none, -F.min("_net").over(upto(w))))
    t = t.withColumn("_q", F.when(buy, q).otherwise(q - F.col("_over") + F.coalesce(F.lag("_over").over(w), none)).cast(EXACT))
    t = t.withColumn("_q", F.when(F.col("_q") > 0, F.col("_q"))).drop("_over")
    run = lambda mine: F.coalesce(F.sum(F.when(mine, F.col("_q"))).over(upto(w)), none).cast(EXACT)
    return t.withColumns({"_bought": run(buy), "_sold": run(~buy)}).withColumn("_end", F.when(buy, F.col("_bought")).otherwise(F.col("_sold"))).drop("_bought")


def _pieces(trades: DataFrame, book: tuple[str, ...]) -> DataFrame:
    """(book, buy, sell, _matched): each sell's quantity against the oldest stock held at its time, exact.

    Buys and what sells find in stock (see _lots()) become intervals of running
    quantity; two intervals match where they overlap. A merge of the interval
    ends of both sides (one window) finds each overlap, so that a book of n
    trades gives at most n pieces and is never joined with itself.
    """
    t = _lots(trades, book).where("_q IS NOT NULL")
    info = F.struct("id", "price", "fee", "quantity", "trade_date", "_end")
    # every interval end cuts the line of quantities; the piece before it belongs to the next end of either side
    pieces = t.groupBy(*book, "_end").agg(F.first(F.when(F.col("side") == "BUY", info), True).alias("_b"), F.first(F.when(F.col("side") != "BUY", info), True).alias("_s"))
    back = Window.partitionBy(*book).orderBy(F.desc("_end"))
    pieces = pieces.withColumn("_from", F.coalesce(F.lead("_end").over(back), F.lit(0).cast(EXACT))).withColumn("buy", F.last("_b", True).over(upto(back))).withColumn("sell", F.last("_s", True).over(upto(back)))
    return pieces.where("buy IS NOT NULL AND sell IS NOT NULL").select(*book, "buy", "sell", (F.col("_end") - F.col("_from")).cast(EXACT).alias("_matched"))


def fifo(trades: DataFrame, book: tuple[str, ...] = BOOK) -> DataFrame:
    """(book, buy_id, sell_id, buy_date, sell_date, matched, pnl, fee) of the first-in-first-out pieces."""
    p = _pieces(trades, book).withColumn("matched", F.col("_matched").cast("double"))
    fee = F.col("matched") / F.col("buy.quantity") * F.col("buy.fee") + F.col("matched") / F.col("sell.quantity") * F.col("sell.fee")
    return p.select(*book, F.col("buy.id").alias("buy_id"), F.col("sell.id").alias("sell_id"), F.col("buy.trade_date").alias("buy_date"), F.col("sell.trade_date").alias("sell_date"), "matched", ((F.col("sell.price") - F.col("buy.price")) * F.col("matched")).alias("pnl"), fee.alias("fee"))


def oversold(trades: DataFrame, book: tuple[str, ...] = BOOK) -> DataFrame:
    """Trades after which more has been sold than bought."""
    return trades.withColumn("net", _net(book).cast("double")).where("net < 0")


def rounds(trades: DataFrame, book: tuple[str, ...] = ("code",)) -> DataFrame:
    """(book, round, ...): a round ends when the running quantity is back at zero."""
    w = Window.partitionBy(*book).orderBy(*ORDER)
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    t = trades.withColumn("_net", F.sum(signed).over(upto(w)))
    t = t.withColumn("round", F.coalesce(F.sum((F.abs("_net") < 1e-9).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    amount = F.col("quantity") * F.col("price")
    return t.groupBy(*book, "round").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("n_trades"), F.sum(F.when(F.col("side") == "BUY", amount)).alias("bought"),
        F.sum(F.when(F.col("side") == "SELL", amount)).alias("sold"), F.sum("fee").alias("fees"), (F.abs(F.max_by("_net", F.struct(*ORDER))) < 1e-9).alias("closed"),
    )


def cash(trades: DataFrame, flows: DataFrame | None = None, account: str = "account_id") -> DataFrame:
    """Trades with the account's running cash after each, transfers before trades of their day."""
    amount = F.col("quantity") * F.col("price")
    delta = F.when(F.col("side") == "BUY", -amount).otherwise(amount) - F.col("fee")
    t = trades.withColumn("_delta", delta)
    if flows is not None:
        f = flows.select(F.col(account), F.col("flow_date").alias("trade_date"), F.lit("").alias("trade_time"), F.col("id"), F.col("amount").alias("_delta"))
        t = t.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(account).orderBy("trade_date", "trade_time", "id", "price", "quantity").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cash", F.sum("_delta").over(w)).drop("_delta")


def initial_capital(with_cash: DataFrame, account: str = "account_id") -> DataFrame:
    """Capital that keeps the running cash at zero or above."""
    return with_cash.groupBy(account).agg(F.greatest(F.lit(0.0), -F.min("cash")).alias("capital"))


def split_adjusted(trades: DataFrame, actions: DataFrame) -> DataFrame:
    """Trades in units after all later splits (code, effective_date, ratio): quantity times, price over the suffix product."""
    a = actions.select("code", F.col("effective_date").alias("trade_date"), "ratio", F.lit(0).alias("_side"))
    both = trades.withColumn("_side", F.lit(1)).unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("trade_date", "_side").rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("_f", F.coalesce(F.product(F.coalesce("ratio", F.lit(1.0))).over(w), F.lit(1.0))).where("_side = 1")
    return both.withColumn("quantity", F.col("quantity") * F.col("_f")).withColumn("price", F.col("price") / F.col("_f")).drop("_f", "_side", "ratio")


#: Prices and amounts are exact too: an account's value is a running sum of changes.
PRICE = "decimal(14,4)"


def _held(trades: DataFrame, book: tuple[str, ...], shown: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(book, _from, _to, quantity, cost): constant holdings, dealt by code.

    Trades are dealt by code once; all that follows stays in place. The stock
    sold so far, read on the line of bought quantities, tells what it cost: a
    book's cost is what it spent less that.
    """
    others = [c for c in book if c != "code"]
    zero = F.lit(0).cast(EXACT)
    buy = F.col("_buy")
    t = trades.repartition("code").select(*book, *ORDER, (F.col("side") == "BUY").alias("_buy"))
    line, own = Window.partitionBy("code").orderBy(*others, *ORDER), F.struct(F.lit(0), *others)  # the books of a code, one after the other
    t = t.withColumns({"_k": F.row_number().over(line), "_last": ~F.lead(own).over(line).eqNullSafe(own), "_first": ~F.lag(own).over(line).eqNullSafe(own), "_to": F.lead("trade_date").over(line)})
    t = t.withColumns({"_many": ~(F.col("_last") & F.col("_first")), "_to": F.when(~F.col("_last"), F.col("_to"))})
    # windows are dear by the group, so a code's books of one trade, which need none, make one group
    t = t.withColumns({f"_book{i}": F.when(F.col("_many"), F.col(c)) for i, c in enumerate(others)}).drop("trade_time", "id", "_first")
    by = ("code", "_many", *[f"_book{i}" for i in range(len(others))])
    w = Window.partitionBy(*by).orderBy("_k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_mixed", F.col("_many") & (F.min("_buy").over(whole) != F.max("_buy").over(whole)))
    # exact sums are dear, and so are wide columns that sorts and windows copy: a book of one trade has none, and only one that both buys and sells has those of its lots
    x, px = F.col("quantity").cast(EXACT), F.col("price").cast(PRICE)
    paid, signed, real = F.when(buy, (x * px).cast(EXACT)), F.when(buy, x).otherwise(-x), x > 0
    so_far = lambda when, y: F.sum(F.when(when, y)).over(upto(w))
    t = t.withColumns({"_net": so_far(F.col("_many"), signed).cast(EXACT), "_spent": so_far(F.col("_many"), paid).cast(EXACT)} | {c: F.when(F.col("_mixed"), F.coalesce(so_far(F.col("_mixed") & when, y), zero).cast(EXACT)) for c, when, y in (("_bought", buy & real, x), ("_sold", ~buy & real, x), ("_before", real, paid))})
    over = F.greatest(zero, -F.min(F.when(F.col("_mixed"), F.coalesce("_net", zero))).over(upto(w)))  # see _lots(): what sells lacked so far
    t = t.withColumn("_sold", F.when(F.col("_mixed"), (F.col("_sold") - over).cast(EXACT)))
    lot = F.when(F.col("_mixed") & buy & real, F.struct((F.col("_bought") - x).cast(EXACT).alias("start"), (F.col("_before") - paid).cast(EXACT).alias("before"), px.alias("price")))
    t = t.select(*book, *by[1:], "trade_date", "quantity", "price", "_buy", "_k", "_to", "_last", "_net", "_spent", "_sold", F.when(buy, F.col("_bought")).otherwise(F.col("_sold")).alias("_end"), lot.alias("_lot"))
    down = upto(Window.partitionBy(*by).orderBy(F.desc("_end"), F.desc("_buy")))
    t = t.withColumn("_lot", F.last("_lot", True).over(down))  # the lot in which a sell ends
    gone = F.when(~buy, F.col("_lot.before") + ((F.col("_sold") - F.col("_lot.start")) * F.col("_lot.price")).cast(EXACT))
    t = t.withColumn("_gone", gone.cast(EXACT)).drop("_sold", "_end", "_lot")
    t = t.withColumn("_gone", F.last("_gone", True).over(upto(w)))
    net, spent = (F.coalesce(F.when(F.col("_many"), F.col(c)).otherwise(y), zero) for c, y in (("_net", signed), ("_spent", paid)))
    return t.where("_last OR NOT _to <=> trade_date").where(net != 0).select(*book, F.col("trade_date").alias("_from"), "_to", shown(net).alias("quantity"), shown((spent - F.coalesce("_gone", zero)).cast(EXACT)).alias("cost"))


def _held_at_prices(trades: DataFrame, prices: DataFrame, book: tuple[str, ...], shown: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(book, _from, _to, quantity, cost, _p): constant holdings, once for each price (begin, end, close, day) that holds in them. A code's prices, one a day, meet its books as an array."""
    days = Window.partitionBy("code").orderBy("trade_date")
    close = shown(F.col("close").cast(PRICE))
    span = F.struct(F.col("trade_date").alias("begin"), F.lead("trade_date").over(days).alias("end"), close.alias("close"), F.col("trade_date").alias("day"))
    spans = prices.select("code", F.when(F.col("trade_date").isNotNull(), span).alias("_p")).groupBy("code").agg(F.collect_list("_p").alias("_p"), F.min("_p.begin").alias("_first"))
    unknown = F.struct(F.to_date(F.lit("0001-01-01")).alias("begin"), F.col("_first").alias("end"), shown(F.lit(None).cast(PRICE)).alias("close"), F.lit(None).cast("date").alias("day"))
    met = _held(trades, book, shown).join(spans.select("code", F.concat(F.array(unknown), "_p").alias("_p")).hint("merge"), "code", "left").select(*book, "_from", "_to", "quantity", "cost", F.explode_outer("_p").alias("_p"))
    return met.where("_p IS NULL OR ((_p.end IS NULL OR _p.end > _from) AND (_to IS NULL OR _to > _p.begin))")


def holding_intervals(trades: DataFrame, prices: DataFrame, book: tuple[str, ...] = BOOK, shown: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(book, from_date, to_date, quantity, cost, close, close_date, missing): what each book holds, every day of it.

    A row holds from from_date until the day before to_date (null: still). It
    ends with a trade of the book or a new price (code, trade_date, close) of the
    code; flat times have no row. cost is what the first-in-first-out lots held
    were bought for (nothing, where more was sold than bought); close is the last
    price on or before, missing where there is none yet. Spreading a row over
    days is left to the reader: a book and day would be hundreds of times as many.
    Quantity, cost and close are exact; what `shown` makes of them is made once a
    holding and once a price, not once a row.
    """
    met = _held_at_prices(trades, prices, book, shown)
    return met.select(*book, F.greatest("_from", "_p.begin").alias("from_date"), F.least("_to", "_p.end").alias("to_date"), "quantity", "cost", F.col("_p.close").alias("close"), F.col("_p.day").alias("close_date"), F.col("_p.close").isNull().alias("missing"))


_WIDE, _SLIM = "decimal(38,6)", "decimal(18,6)"


def _worth(close: Column) -> Column:
    return F.coalesce((F.col("quantity").cast("decimal(18,4)") * close).cast(_WIDE), F.lit(0).cast(_WIDE))


def _change(day: Column, value: Column, cost: Column, n_held: Column, n_missing: Column) -> Column:
    """(day, value, rest) of a change. Most are of the value alone and of few digits: what is more than that is in rest, as changes are shuffled."""
    slim = F.abs(value) < 10**11
    rest = F.struct(F.when(~slim, value).alias("value"), cost.cast(EXACT).alias("cost"), n_held.cast("int").alias("n_held"), n_missing.cast("int").alias("n_missing"))
    return F.struct(day.alias("day"), F.when(slim, value.cast(_SLIM)).alias("value"), F.when(~slim | (cost != 0) | (n_held != 0) | (n_missing != 0), rest).alias("rest"))


def account_groups(trades: DataFrame, account: str = "account_id", rows: int = 400_000) -> tuple[Column, int]:
    """An account's group, and how many there are: accounts near each other in number, with about `rows` trades a group (fewer, where cores would idle).

    What a group needs is sent to it once, so accounts that hold the same codes
    do well to share one; numbers that lie together often do. Any grouping gives
    the same results. A stretch of numbers with more trades than a group takes
    is dealt by hash, and so is all where accounts have no whole numbers.
    """
    stretch = F.lit(0)
    if trades.schema[account].dataType.typeName() in ("byte", "short", "integer", "long"):
        low, high = (x or 0 for x in trades.agg(F.min(account), F.max(account)).first())
        width = max(1, -(-(high - low) // 4095))
        start = low // width if low >= 0 else -(-low // width)  # DIV rounds towards zero
        stretch = (F.call_function("div", F.coalesce(F.col(account).cast("long"), F.lit(low)), F.lit(width)) - start).cast("int")
    counts = {r["k"]: r["count"] for r in trades.groupBy(stretch.alias("k")).count().collect()}
    rows = max(1, min(rows, sum(counts.values()) // (4 * trades.sparkSession.sparkContext.defaultParallelism)))
    group, filled, first, parts = 0, 0, [], []
    for n in (counts.get(k, 0) for k in range(max(counts, default=0) + 1)):
        if filled and filled + n > rows:
            group, filled = group + 1, 0
        first.append(group)
        parts.append(max(1, -(-n // rows)))
        group, filled = (group, filled + n) if parts[-1] == 1 else (group + parts[-1], 0)
    at = lambda values: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), stretch)
    return (at(first) + F.pmod(F.xxhash64(account), at(parts))).cast("int"), first[-1] + parts[-1]


def holding_changes(trades: DataFrame, prices: DataFrame, book: tuple[str, ...] = BOOK, account: str = "account_id") -> DataFrame:
    """(_group, book, _from, _to, _units, cost, _leads, _path, _wide): what changes accounts' daily values, for summed_changes().

    A code's later prices change each of its books: many more changes than
    trades. So no change is shuffled, but holdings and prices, to groups of
    accounts: a code's prices go once to each group that holds it, with the first
    of its holdings there, and from that one's begin on. Units and closes are
    whole ten-thousandths; prices take six bytes each (_path) where that is enough.
    """
    whole = lambda x, kind: (x.cast(kind) * 10**4).cast("long")
    group, n = account_groups(trades, account)
    held = _held(trades, book).select(group.alias("_group"), *book, "_from", "_to", whole(F.col("quantity"), "decimal(18,4)").alias("_units"), "cost")
    held = held.withColumn("_leads", F.row_number().over(Window.partitionBy("code", "_group").orderBy(F.asc_nulls_first("_from"))) == 1)
    price = F.struct(F.col("trade_date").alias("day"), whole(F.col("close"), PRICE).alias("close"))
    paths = prices.select("code", F.when(F.col("trade_date").isNotNull(), price).alias("_p")).groupBy("code").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    paths = paths.select("code", F.col("_p.day").alias("_days"), F.col("_p.close").alias("_closes"), F.get("_p.day", F.lit(0)).alias("_since"))
    slim = (F.datediff(F.array_max("_days"), "_since") < 2**15) & (F.coalesce(F.greatest(F.array_max("_closes"), -F.array_min("_closes")), F.lit(0)) < 2**31)
    short = F.when(slim, F.transform("_days", lambda day: F.datediff(day, F.col("_since")).cast("short")))
    paths = paths.select("code", "_days", "_since", short.alias("_short"), F.when(slim, F.col("_closes").cast("array<int>")).alias("_small"), F.when(~slim, F.col("_closes")).alias("_closes"))
    met = held.join(paths.hint("merge"), "code", "left")
    begin = F.greatest(F.lit(1), F.size(F.filter("_days", lambda day: day <= F.col("_from"))))
    left = lambda c: F.slice(c, begin, F.size("_days"))
    path = F.struct("_since", left("_short").alias("short"), left("_small").alias("small"))
    wide = F.struct(left("_days").alias("days"), left("_closes").alias("closes"))
    here, slim = F.col("_leads"), F.col("_short").isNotNull()
    return met.select(*held.columns, F.when(here & slim, path).alias("_path"), F.when(here & ~slim, wide).alias("_wide")).repartition(n, "_group")


def daily_value(intervals: DataFrame, last_day: str, account: str = "account_id") -> DataFrame:
    """(account, trade_date, value, cost, n_held, n_missing) of every calendar day from the account's first holding to last_day.

    Intervals become changes at their two ends; one running sum an account gives
    each day's figures, so no row a book and day is made. Days without a change
    repeat those of the day before.
    """
    value, missing = _worth(F.col("close")), F.col("missing").cast("int")
    begin = _change(F.col("from_date"), value, F.col("cost"), F.lit(1), missing)
    end = F.when(F.col("to_date").isNotNull(), _change(F.col("to_date"), -value, -F.col("cost"), F.lit(-1), -missing))
    return summed_changes(intervals.select(account, F.explode(F.array(begin, end)).alias("_c")).where("_c IS NOT NULL").select(account, "_c.*"), last_day, account)


def summed_changes(changes: DataFrame, last_day: str, account: str = "account_id") -> DataFrame:
    """daily_value() of changes: those of holding_changes() where their groups are; others (account, day, value, rest) are shuffled once, by account."""
    if "_group" in changes.columns:
        return account_days(changes.sortWithinPartitions("_group", "code", F.desc("_leads")), last_day, account)
    names = ("value", "cost", "n_held", "n_missing")
    of = {"value": F.coalesce(F.col("value").cast(_WIDE), F.col("rest.value")), **{c: F.coalesce(F.col(f"rest.{c}"), F.lit(0)) for c in names[1:]}}
    w = Window.partitionBy(account).orderBy("day")
    runs = changes.select(account, "day", "value", "rest").withColumns({f"_{c}": F.sum(x).over(upto(w)) for c, x in of.items()} | {"_next": F.lead("day").over(w)})
    runs = runs.withColumn("_until", F.least(F.date_sub("_next", 1), F.to_date(F.lit(last_day)))).where(F.col("_until") >= F.col("day"))
    spread = runs.withColumn("trade_date", F.explode(F.sequence("day", "_until")))
    return spread.select(account, "trade_date", F.col("_value").cast("double").alias("value"), F.col("_cost").cast("double").alias("cost"), F.col("_n_held").cast("long").alias("n_held"), F.col("_n_missing").cast("long").alias("n_missing"))


def holdings(trades: DataFrame, days: DataFrame, prices: DataFrame, book: tuple[str, ...] = ("account_id", "code")) -> DataFrame:
    """Quantity of each book on each of `days` from its first trade on, with the last price on or before and its age; flat days left out.

    Trades become intervals of constant quantity; flat ones are dropped before
    the others are spread over days, so closed books make no rows.
    """
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    daily = trades.groupBy(*book, F.col("trade_date").alias("_from")).agg(F.sum(signed).alias("_q"))
    w = Window.partitionBy(*book).orderBy("_from")
    held = daily.withColumn("quantity", F.sum("_q").over(upto(w))).withColumn("_to", F.lead("_from").over(w)).where("abs(quantity) > 1e-9")
    rows = on_days(held.select(*book, "quantity", "_from", "_to"), days, "_from", "_to").select(*book, "trade_date", "quantity")
    out = as_of(rows, prices, "close", ["code"])
    return out.withColumn("value", F.col("quantity") * F.col("close")).withColumn("stale_days", F.datediff("trade_date", "close_date")).drop("close_date")


def period_returns(equity: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Rows (keys, trade_date, equity, flow): time-weighted and modified Dietz return, and the compounded one."""
    w = Window.partitionBy(*keys).orderBy("trade_date")
    before = F.lag("equity").over(w)
    gain = F.col("equity") - before - F.col("flow")
    base = before + 0.5 * F.col("flow")
    df = equity.withColumn("twr", F.when(F.abs(before) > 1e-9, gain / before)).withColumn("dietz", F.when(F.abs(base) > 1e-9, gain / base))
    return df.withColumn("cumulative", F.product(1 + F.coalesce("twr", F.lit(0.0))).over(upto(w)) - 1)


def dominant(contracts: DataFrame, ratio: float = 1.1) -> DataFrame:
    """(root, trade_date, contract): the leading contract a day.

    First day: the largest open interest. Then yesterday's best contract that
    has not led yet takes over once its open interest exceeds `ratio` times the
    leader's; a leader without a bar is replaced by the best of the day. The
    state makes it a loop; a group is one root's daily counts.
    """

    def walk(pdf):
        import pandas as pd

        out, lead, led, before = [], None, set(), {}
        for date, g in pdf.sort_values(["trade_date", "contract"]).groupby("trade_date", sort=True):
            today = dict(zip(g["contract"], g["hold"], strict=True))
            best = lambda held: min(held, key=lambda c: (-held[c], c)) if held else None
            if lead is None:
                lead = best(today)
            else:
                fresh = {c: h for c, h in before.items() if c not in led and c in today}
                rival = best(fresh)
                if rival and fresh[rival] > ratio * before.get(lead, 0):
                    lead = rival
                elif lead not in today:
                    lead = best({c: h for c, h in today.items() if c not in led}) or best(today)
            led.add(lead)
            before = today
            out.append((g["root"].iloc[0], date, lead))
        return pd.DataFrame(out, columns=["root", "trade_date", "contract"])

    return contracts.select("root", "trade_date", "contract", "hold").groupBy("root").applyInPandas(walk, "root string, trade_date date, contract string")


def switches(lead: DataFrame) -> DataFrame:
    w = Window.partitionBy("root").orderBy("trade_date")
    was = F.lag("contract").over(w)
    return lead.withColumn("from_contract", was).where("from_contract <> contract").select("root", "trade_date", "from_contract", F.col("contract").alias("to_contract"))


def continuous(contracts: DataFrame, lead: DataFrame) -> DataFrame:
    """Bars of the leading contract, raw and adjusted.

    At a switch the gap between both contracts' closes of the day before is
    added to all earlier days (forward adjusted), and the gap of their opens on
    the day is taken off all days from it on (backward adjusted).
    """
    bars = contracts.select("root", "contract", "trade_date", "open", "close")
    w = Window.partitionBy("root").orderBy("trade_date")
    rows = lead.withColumn("_old", F.lag("contract").over(w)).withColumn("_day", F.lag("trade_date").over(w)).join(bars.hint("merge"), ["root", "contract", "trade_date"])
    old = bars.select("root", F.col("contract").alias("_old"), "trade_date", F.col("open").alias("_old_open"))
    ends = bars.select("root", F.col("contract").alias("_c"), F.col("trade_date").alias("_day"), F.col("close").alias("_e"))
    rows = rows.join(old.hint("merge"), ["root", "_old", "trade_date"], "left")
    rows = rows.join(ends.withColumnRenamed("_c", "_old").withColumnRenamed("_e", "_old_close").hint("merge"), ["root", "_old", "_day"], "left").join(ends.withColumnRenamed("_c", "contract").withColumnRenamed("_e", "_new_close").hint("merge"), ["root", "contract", "_day"], "left")
    moved = F.col("_old") != F.col("contract")
    rows = rows.withColumn("_gc", F.when(moved, F.coalesce(F.col("_new_close") - F.col("_old_close"), F.lit(0.0))).otherwise(0.0)).withColumn("_go", F.when(moved, F.coalesce(F.col("open") - F.col("_old_open"), F.lit(0.0))).otherwise(0.0))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    return rows.select("root", "trade_date", "contract", "open", "close", (F.col("close") + F.coalesce(F.sum("_gc").over(later), F.lit(0.0))).alias("close_forward"), (F.col("close") - F.sum("_go").over(upto(w))).alias("close_backward"))
