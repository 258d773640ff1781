"""Text expressions for the JVM, and the one rule Python tasks share with them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
# Python's word characters without the underscore are the same letters and numbers.
TOKEN = re.compile(r"[^\W_]+")


class _Breaks(dict):
    """A blank for every character that ``TOKEN`` leaves out, worked out on first sight."""

    def __missing__(self, code: int) -> int:
        kept = self[code] = code if TOKEN.match(chr(code)) else 32
        return kept


_breaks = _Breaks()


def token_list(text: str) -> list[str]:
    """``tokens`` for one text inside a Python task: what ``TOKEN`` finds, by faster means."""
    return text.lower().translate(_breaks).split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def content_key(model: str | Column, text: Column) -> Column:
    """Key of one text under one model. Per row, so adding a text never
    invalidates the keys of the others."""
    model = F.lit(model) if isinstance(model, str) else model
    return F.md5(F.concat_ws("::", model, text))


def hash_of(*parts) -> Column:
    """md5 over ``:``-joined parts: the basis of every seeded order and draw."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def draw(*parts) -> Column:
    """Seeded draw in [0, 2^60), the same on every engine and partitioning."""
    return F.conv(F.substring(hash_of(*parts), 1, 15), 16, 10).cast("long")


def fill_template(template: Column, base: Column) -> Column:
    return F.replace(template, F.lit("{base}"), base)
