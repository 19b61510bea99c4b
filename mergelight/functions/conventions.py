"""Expressions over function names and docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naming_style(name: Column) -> Column:
    """``snake``, ``camel`` or ``none``."""
    snake = name.contains("_") & (name == F.lower(name)) & name.rlike(r"\p{Ll}")
    camel = name.rlike(r"(?s)\A\p{Ll}.*\p{Lu}")
    return F.when(snake, "snake").when(camel, "camel").otherwise("none")


def docstring_style(text: Column) -> Column:
    """``google``, ``numpy``, ``sphinx`` or ``none``, in this order of preference."""
    return (
        F.when(text.contains("Args:") | text.contains("Returns:"), "google")
        .when(text.contains("Parameters") & text.contains("---"), "numpy")
        .when(text.contains(":param") | text.contains(":type"), "sphinx")
        .otherwise("none")
    )
