"""Scalar column functions: times, formatting, intervals, word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(ms: Column | str) -> Column:
    return col(ms) / F.lit(1000.0)


def to_ms(sec: Column | str) -> Column:
    return F.round(col(sec) * 1000).cast("bigint")


def half_up(x: Column | str, digits: int) -> Column:
    """Round on the scaled double, the same IEEE steps in every engine."""
    scale = float(10**digits)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def fixed(x: Column | str, digits: int) -> Column:
    """Fixed-point text, correctly rounded from the binary value (ties to even)."""
    return F.replace(F.format_number(col(x).cast("double"), digits), F.lit(","), F.lit(""))


def exact_sum(x: Column | str) -> Column:
    """Order-independent sum of doubles with at most eight decimals."""
    return F.sum(col(x).cast("decimal(18,8)")).cast("double")


def exact_mean(x: Column | str) -> Column:
    """Mean of doubles, whatever the order of addition; each counts to twelve decimals."""
    return F.try_divide(F.sum(col(x).cast("decimal(26,12)")).cast("double"), F.count(col(x)).cast("double"))


def srt_time(ms: Column | str) -> Column:
    """HH:MM:SS,mmm (milliseconds are whole already, so nothing is rounded)."""
    m = col(ms)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(m / 3_600_000),
        F.floor(m / 60_000) % 60,
        F.floor(m / 1000) % 60,
        m % 1000,
    )


def mmss(ms: Column | str) -> Column:
    m = col(ms)
    return F.format_string("%02d:%02d", F.floor(m / 60_000), F.floor(m / 1000) % 60)


def mmss_ms(ms: Column | str) -> Column:
    m = col(ms)
    return F.format_string("%02d:%02d.%03d", F.floor(m / 60_000), F.floor(m / 1000) % 60, m % 1000)


def hms_of_day(ms: Column | str) -> Column:
    """HH:MM:SS of a stream offset; wraps at 24 hours."""
    m = col(ms)
    return F.format_string(
        "%02d:%02d:%02d", F.floor(m / 3_600_000) % 24, F.floor(m / 60_000) % 60, F.floor(m / 1000) % 60
    )


def time_range(start_ms: Column | str, end_ms: Column | str) -> Column:
    return F.concat(mmss(start_ms), F.lit("–"), mmss(end_ms))


def format_gaps(gaps_ms: Column | str, max_gaps: int | None = None, precision: int = 4, sep: str = ", ") -> Column:
    """Gaps as fixed-precision seconds; ``max_gaps`` of None or 0 keeps all."""
    g = col(gaps_ms)
    if max_gaps:
        g = F.slice(g, 1, max_gaps)
    return F.array_join(F.transform(g, lambda x: fixed(x / F.lit(1000.0), precision)), sep)


#: White space as Unicode has it, which strip() and split() of most languages follow.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"^{SPACE}++|{SPACE}++$", "")


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(col(text), f"{SPACE}+"), lambda t: t != "")


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def overlap_ms(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.lit(0), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)))


def intersects(a_start, a_end, b_start, b_end) -> Column:
    return (col(a_start) < col(b_end)) & (col(a_end) > col(b_start))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def present(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    labels = F.array(*[F.when(c, F.lit(label)) for c, label in pairs])
    return F.filter(labels, lambda x: x.isNotNull())
