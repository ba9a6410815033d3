"""Places of pattern matches as column expressions: no Python worker, no shuffle.

Spark gives the matches of a pattern and the gaps between them, but not their places. Places are
running sums of both lengths, in code points. The sums are taken in two levels (blocks of matches,
then within a block), so a text with a hundred thousand matches needs no quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  # matches of a block of running sums
CONTEXT = 24  # characters kept on either side, at most up to the next match


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _ends(steps: Column) -> Column:
    """Running sums of an array that is not empty."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    return bound(
        F.transform(blocks, lambda k: _total(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))),
        lambda sums: bound(
            F.transform(blocks, lambda k: _total(F.slice(sums, F.lit(1), k))),
            lambda before: F.transform(
                steps,
                lambda _, i: F.get(before, F.floor(i / BLOCK).cast("int"))
                + _total(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
            ),
        ),
    )


def places(text: Column, pattern: str, context: int = CONTEXT) -> Column:
    """``array<struct<start, end, value, left, right>>`` of the leftmost non-overlapping matches.

    ``pattern`` must not match the empty string. ``left`` and ``right`` are the characters next to
    a match, up to the neighbouring match. A null text has none.
    """
    none = F.expr(
        "cast(array() as array<struct<start: int, end: int, value: string, left: string, right: string>>)"
    )

    def described(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        steps = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))
        return bound(
            steps,
            lambda s: bound(
                _ends(s),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.char_length(m)).alias("start"),
                        F.get(ends, i).alias("end"),
                        m.alias("value"),
                        F.right(F.get(gaps, i), F.lit(context)).alias("left"),
                        F.left(F.get(gaps, i + 1), F.lit(context)).alias("right"),
                    ),
                ),
            ),
        )

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    some = F.coalesce(text.rlike(pattern), F.lit(False))
    return F.when(some, bound(both, described)).otherwise(none)
