"""Engines by name: an unknown or missing one falls back to the first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Engines:
    """Strategies (pages -> rows) under names; the first that is added is the fallback."""

    def __init__(self):
        self._named: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, run: Callable[[DataFrame], DataFrame]) -> None:
        self._named[name.strip().lower()] = run

    def get(self, name: str | None) -> tuple[str, Callable[[DataFrame], DataFrame]]:
        """(name that is used, strategy)."""
        if not self._named:
            raise ValueError("no engine was added")
        key = (name or "").strip().lower()
        key = key if key in self._named else next(iter(self._named))
        return key, self._named[key]


def email_engines() -> Engines:
    """E-mails of pages by tree (all seven places) or by text alone."""
    from pyspark.sql import functions as F

    from tallyfold.functions.contacts import EMAIL, older_email
    from tallyfold.functions.dialect import Spark
    from tallyfold.operators.extraction import email_channels

    out = Engines()
    out.add("tree", email_channels)
    found = lambda pages: pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(EMAIL), F.lit(0))).alias("raw"))
    out.add("text", lambda pages: found(pages).select("page_id", F.expr(older_email(Spark(), "raw")).alias("email"), F.lit("raw").alias("channel")).where("email <> ''").distinct())
    return out
