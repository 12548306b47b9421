"""Per-site content handlers: an ordered list of (predicate, transform); the first that matches takes a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Handler = tuple[Column, Callable[[DataFrame], DataFrame]]


def apply_handlers(pages: DataFrame, handlers: list[Handler], default: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows split by the first predicate that holds, transformed, and put together again.

    A handler that gives null ``text`` has failed; its row goes to the default.
    """
    choice = F.coalesce(*(F.when(p, i) for i, (p, _) in enumerate(handlers)), F.lit(-1))
    tagged = pages.withColumn("_handler", choice)
    out = default(tagged.filter("_handler = -1"))
    for i, (_, transform) in enumerate(handlers):
        done = transform(tagged.filter(F.col("_handler") == i))
        out = out.unionByName(done.filter("text is not null")).unionByName(default(done.filter("text is null").drop("text")))
    return out.drop("_handler")
