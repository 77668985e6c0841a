"""Column names that clash with no other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(name: str, *taken: list[str]) -> str:
    """The name, with as many underscores before it as keep it apart from all of these, in any case."""
    used = {n.lower() for names in taken for n in names}
    while name.lower() in used:
        name = f"_{name}"
    return name


def exact(name: str) -> Column:
    """The column of this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")
