"""Joins by predicates of the dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceLimitExceeded
from ..governance import Limits
from ..plans.lowering import joined, name
from ..sql import parse_expression


def join(left: DataFrame, right: DataFrame, predicate: str, left_name: str = "left", right_name: str = "right", limits: Limits | None = None) -> DataFrame:
    """Inner join on any predicate. Columns of ``right`` that ``left`` has too come out as ``<right_name>.<column>``.

    Names resolve plain where only one side has them (else to the left side),
    and qualified by either side's name. Equalities become hash or merge joins;
    a predicate without one is a nested loop, which Catalyst broadcasts only
    below its size threshold. With a limit on join rows, neither side, nor the
    product of their sizes, nor the result may have more.
    """
    if limits and limits.join_rows is not None:
        sides = [limits.checked("join rows", df).count() for df in (left, right)]
        if (pairs := sides[0] * sides[1]) > limits.join_rows:
            raise ResourceLimitExceeded("join rows", pairs, limits.join_rows)
    return joined(left, right, parse_expression(predicate), left_name, right_name)


def overlapping(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows whose closed integer ranges overlap, as an equi-join on bins of ``width``.

    A pair is kept in the first bin that both reach only, so it comes once. A
    range is repeated for each bin it reaches: choose ``width`` near the usual
    length. Empty and null ranges match nothing. Column names must differ.
    """
    bins = lambda low, high: F.sequence(F.floor(low / width), F.floor(high / width))
    a, b = F.col(name(left_range[0])), F.col(name(left_range[1]))
    c, d = F.col(name(right_range[0])), F.col(name(right_range[1]))
    l = left.where(a <= b).withColumn("__bin", F.explode(bins(a, b)))  # noqa: E741
    r = right.where(c <= d).withColumn("__right_bin", F.explode(bins(c, d)))
    first = F.col("__bin") == F.floor(F.greatest(a, c) / width)
    return l.join(r, (F.col("__bin") == F.col("__right_bin")) & first & (a <= d) & (c <= b)).drop("__bin", "__right_bin")
