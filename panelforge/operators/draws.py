"""Draws from hashes, so that reruns agree and SQL engines with MD5 draw the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A draw is so many bits of a digest.
BITS = 52


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by colons; null parts are left out."""
    cols = [F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def uniform_sql(*parts: str | int) -> str:
    """The same as SQL; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, {BITS // 4}))::BIGINT / {1 << BITS}.0::DOUBLE)"


def _digest(block: Column | int, *parts: Column | str | int) -> Column:
    cols = [F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols, F.lit(block).cast("string") if isinstance(block, int) else block.cast("string")))


def many_draws(*parts: Column | str | int, n: int) -> Column:
    """n draws of 32 bits as hex digits of eight, which compare like numbers; a digest gives four."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 4)), lambda b: _digest(b, *parts))
    return F.slice(F.flatten(F.transform(blocks, lambda m: F.array(*[F.substring(m, 8 * k + 1, 8) for k in range(4)]))), 1, n)


def many_draws_sql(k: str, *parts: str | int) -> str:
    """Draw k (an SQL expression, from 0) of many_draws()."""
    return f"substr(md5(concat_ws(':', {', '.join(f'({p})::VARCHAR' for p in parts)}, ({k} // 4)::VARCHAR)), (8 * ({k} % 4) + 1)::BIGINT, 8)"


def hex_of(share: Column) -> Column:
    """A number as a bound for many_draws()."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * float((1 << 32) - 1)
    return F.lower(F.lpad(F.hex(F.floor(at).cast("long")), 8, "0"))


def many_bits(*parts: Column | str | int, n: int) -> Column:
    """n draws of 0 or 1; a digest gives as many as uniform() has bits."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // BITS)), lambda b: F.conv(F.substring(_digest(b, *parts), 1, BITS // 4), 16, 10).cast("long"))
    return F.slice(F.flatten(F.transform(blocks, lambda x: F.array(*[F.getbit(x, F.lit(k)).cast("int") for k in range(BITS)]))), 1, n)


def many_bits_sql(k: str, *parts: str | int) -> str:
    """Draw k (an SQL expression, from 0) of many_bits()."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(f'({p})::VARCHAR' for p in parts)}, ({k} // {BITS})::VARCHAR)), 1, {BITS // 4}))::BIGINT >> ({k} % {BITS})::INT) & 1)"
