"""Product identity. A product without a combination is the base product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product_key(product: str | Column, combination: str | Column) -> Column:
    """One string per identity; never NULL when the product id is set."""
    product = F.col(product) if isinstance(product, str) else product
    combination = F.col(combination) if isinstance(combination, str) else combination
    return F.concat(product, F.lit(":"), F.coalesce(combination, F.lit("")))


def identity_order(prefix: str = "") -> list[Column]:
    """Byte order of the product id, base product before its combinations."""
    return [
        F.col(f"{prefix}product_id").asc(),
        F.col(f"{prefix}combination_id").asc_nulls_first(),
    ]


def blank(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | (F.trim(column) == "")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that treats NULL keys as equal; keeps one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    condition = None
    for key in keys:
        term = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


# Ids joined by NUL sort like (product, combination) with the base product first.
_JOINT = "\u0000"


def pack(product: str = "product_id", combination: str = "combination_id") -> Column:
    """Identity as one string, for grouping and sorting inside an operator."""
    return F.concat(
        F.col(product),
        F.when(F.col(combination).isNotNull(), F.concat(F.lit(_JOINT), F.col(combination))).otherwise(F.lit("")),
    )


def unpack(key: str, prefix: str = "") -> list[Column]:
    """Product and combination id of a packed identity."""
    at = F.instr(F.col(key), _JOINT)
    product = F.when(at > 0, F.substring_index(key, _JOINT, 1)).otherwise(F.col(key))
    combination = F.when(at > 0, F.substring(F.col(key), at + 1, F.length(key)))
    return [product.alias(f"{prefix}product_id"), combination.alias(f"{prefix}combination_id")]


def sealed(product: str = "product_id", combination: str = "combination_id") -> Column:
    """Identity as one string that is never NULL, so that plain joins and groupings agree and treat NULL ids as equal."""
    given = lambda c, mark: F.coalesce(F.concat(F.lit(mark), F.col(c)), F.lit(""))
    return F.concat(given(product, "p"), F.lit(_JOINT), given(combination, "c"))


def unsealed(key: str) -> list[Column]:
    """Product and combination id of a sealed identity."""
    at = F.instr(F.col(key), _JOINT)
    product = F.when(at > 1, F.substring(F.col(key), F.lit(2), at - 2))
    combination = F.when(F.length(key) > at, F.substring(F.col(key), at + 2, F.length(key)))
    return [product.alias("product_id"), combination.alias("combination_id")]


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames of counters as one row; each of the others is a single broadcast row."""
    for other in others:
        first = first.join(F.broadcast(other))
    return first
