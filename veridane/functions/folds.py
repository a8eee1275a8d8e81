"""Folds over long arrays that give lists: in chunks, so a list that grows is never long while it does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridane.functions.text import bound

State = dict[str, Column]


def struct_of(fields: State) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def folded(items: Column, start: State, step: Callable[[State, Column], tuple[State, Column]], kind: str, finish: Callable[[State, Column], Column]) -> Column:
    """Folds over an array. step gives the next state and what the item adds to the list, of type `kind`, or null; finish gets the last state and the list.

    The items are taken in chunks of about the root of their number: each chunk has a
    short list of its own, and there are few chunks, so adding to lists costs n to the power 1.5.
    """
    names, lists = list(start), f"array<array<{kind}>>"
    fields = lambda s: {k: s[k] for k in names}

    def one(s: Column, item: Column) -> Column:
        state, out = step(fields(s), item)
        return bound(struct_of({**state, "_new": out}), lambda n: struct_of({**fields(n), "_out": F.when(n["_new"].isNotNull(), F.concat(s["_out"], F.array(n["_new"]))).otherwise(s["_out"])}))

    def chunk(s: Column, part: Column) -> Column:
        begun = struct_of({**fields(s), "_out": F.array().cast(f"array<{kind}>")})
        return bound(F.aggregate(part, begun, one), lambda r: struct_of({**fields(r), "_lists": F.concat(s["_lists"], F.array(r["_out"]))}))

    def whole(n: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
        parts = bound(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / w).cast("int")), lambda k: F.slice(items, k * w + 1, w)))
        return F.aggregate(parts, struct_of({**start, "_lists": F.array().cast(lists)}), chunk, lambda s: finish(fields(s), F.flatten(s["_lists"])))

    return bound(F.size(items), whole)
