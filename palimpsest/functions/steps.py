"""Step ranges in file names, and paths that name the same file: JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_U64_MAX = 2**64 - 1
_I64_MAX = 2**63 - 1


def step_range(name: str | None) -> tuple[int, int] | None:
    """First dot-separated segment that reads ``a-b``, both plain unsigned 64-bit integers."""
    for segment in (name or "").split("."):
        a, dash, b = segment.partition("-")
        if dash and re.fullmatch("[0-9]+", a) and re.fullmatch("[0-9]+", b):
            if int(a) <= _U64_MAX and int(b) <= _U64_MAX:
                return int(a), int(b)
    return None


def _segment(name: Column) -> Column:
    def reads(x: Column) -> Column:
        in_range = lambda n: (F.length(n) < 20) | ((F.length(n) == 20) & (n <= F.lit(str(_U64_MAX))))
        bare = lambda i: F.regexp_replace(F.split_part(x, F.lit("-"), F.lit(i)), "^0+(?=.)", "")
        return x.rlike("^[0-9]+-[0-9]+$") & in_range(bare(1)) & in_range(bare(2))

    return F.get(F.filter(F.split(name, "[.]"), reads), F.lit(0))


def step_columns(name: Column) -> tuple[Column, Column]:
    """(from, to) of a name's step range as BIGINT, both NULL where it has none.

    A bound over 2^63-1 is an unsigned integer but no BIGINT; it comes out as the
    largest BIGINT, so the range keeps its order.
    """
    segment = _segment(name)

    def bound(i: int) -> Column:
        wide = F.split_part(segment, F.lit("-"), F.lit(i)).try_cast("decimal(38,0)")
        most = F.lit(_I64_MAX).cast("decimal(38,0)")
        return F.when(wide > most, most).otherwise(wide).cast("bigint")

    return bound(1), bound(2)


def strip_space(text: Column) -> Column:
    """Cuts white space, as Unicode and ASCII separators have it, from both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def resolved_path(path: Column) -> Column:
    """The absolute POSIX path that ``path`` names, by text alone.

    White space at both ends is cut; empty parts and ``.`` vanish; ``..`` drops the
    part before it and stays at the root; a relative path starts at the root.
    NULL stays NULL.
    """
    text = strip_space(path)
    plain = F.concat(F.lit("/"), F.regexp_replace(text, "^/+|/+$", ""))
    push = lambda done, part: (
        F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )
    parts = F.aggregate(F.split(text, "/"), F.array().cast("array<string>"), push)
    walked = F.concat(F.lit("/"), F.array_join(parts, "/"))
    # Nearly all paths have no dot part and no double slash: the fold is only for the others.
    return F.when(text.rlike(r"(^|/)\.{1,2}(/|$)|//"), walked).otherwise(plain)


def last_component(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
