"""Rules that need their own last result, row by row in order, without gathering a series in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.functions.frames import KEYS

_ARROW = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def ordered_scan(df: DataFrame, inputs: list[str], outputs: dict[str, str], begin: Callable[[], Callable], keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """df plus output columns (name -> double, string or boolean).

    begin() starts a series and gives a step: input values of a row -> tuple of
    its outputs. One sort brings each series together; its rows pass through in
    Arrow batches, and only what the step remembers stays in the task.
    """
    columns, names = df.columns, list(outputs)
    at_keys, at_inputs = [columns.index(k) for k in keys], [columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            found = []
            owners = zip(*(b.column(k).to_pylist() for k in at_keys), strict=True)
            for key, values in zip(owners, zip(*(b.column(k).to_pylist() for k in at_inputs), strict=True), strict=True):
                if key != now:
                    now, step = key, begin()
                found.append(step(*values))
            made = zip(*found, strict=True) if found else ((),) * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, _ARROW[outputs[n]]) for n, v in zip(names, made, strict=True))], [*columns, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` {t}" for n, t in outputs.items())
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def dated_scan(df: DataFrame, inputs: list[str], outputs: dict[str, str], begin: Callable[[], Callable], keys: tuple[str, ...], order: tuple[str, ...] = (), date: str = "trade_date") -> DataFrame:
    """df plus output columns, for rules that look at all rows of a date at once and carry a state to the next date.

    begin() starts a key and gives a step: list of the input values of a date's
    rows, in `order`, -> list of their outputs. A task holds the rows of one date
    and the state, never a key's whole history. `order` holds column names; a
    leading minus sorts downwards.
    """
    from pyspark.sql import functions as F

    columns, names = df.columns, list(outputs)
    at_owner, at_inputs = [columns.index(k) for k in (*keys, date)], [columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, rest = None, None, None

        def worked(t: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal now, step
            owners = list(zip(*(t.column(k).to_pylist() for k in at_owner), strict=True))
            values = list(zip(*(t.column(k).to_pylist() for k in at_inputs), strict=True))
            found, start = [], 0
            for end in ends:
                if step is None or owners[start][:-1] != now:
                    now, step = owners[start][:-1], begin()
                found += step(values[start:end])
                start = end
            made = zip(*found, strict=True)
            t = pa.table([*t.columns, *(pa.array(v, _ARROW[outputs[n]]) for n, v in zip(names, made, strict=True))], [*columns, *names])
            yield from t.combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b]).rename_columns(columns)
            rest = t if rest is None else pa.concat_tables([rest, t])
            owners = list(zip(*(rest.column(k).to_pylist() for k in at_owner), strict=True))
            ends = [k for k in range(1, len(owners)) if owners[k] != owners[k - 1]]
            if ends:
                yield from worked(rest.slice(0, ends[-1]), ends)
                rest = rest.slice(ends[-1])
        if rest is not None and rest.num_rows:
            yield from worked(rest, [rest.num_rows])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` {t}" for n, t in outputs.items())
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    dealt = df.repartition(*keys) if keys else df.repartition(1)  # without keys it is one series of dates
    return dealt.sortWithinPartitions(*keys, date, *by).mapInArrow(run, schema)
