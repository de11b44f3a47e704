"""Token cost as exact decimal expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from ..schema import lookup

# USD per 1M tokens, (input, output).
PER_MILLION = {
    "claude-sonnet-4-20250514": ("3.00", "15.00"),
    "claude-3-5-sonnet-20241022": ("3.00", "15.00"),
    "claude-3-opus-20240229": ("15.00", "75.00"),
    "claude-3-haiku-20240307": ("0.25", "1.25"),
    "claude-opus-4-5-20251101": ("15.00", "75.00"),
    "gpt-4-turbo": ("10.00", "30.00"),
    "gpt-4o": ("5.00", "15.00"),
    "gpt-4o-mini": ("0.15", "0.60"),
    "gpt-3.5-turbo": ("0.50", "1.50"),
}
UNKNOWN_PER_MILLION = ("3.00", "15.00")

# The models priced in the hourly token rollup.
HOURLY_MODELS = [
    "claude-sonnet-4-20250514",
    "claude-3-5-sonnet-20241022",
    "claude-3-opus-20240229",
    "claude-3-haiku-20240307",
    "gpt-4-turbo",
    "gpt-4o",
    "gpt-3.5-turbo",
]

# USD per 1K tokens by model family, (input, output), in match order.
PER_THOUSAND = {
    "claude-3-opus": ("0.015", "0.075"),
    "claude-3-sonnet": ("0.003", "0.015"),
    "claude-3-haiku": ("0.00025", "0.00125"),
    "claude-sonnet-4": ("0.003", "0.015"),
    "claude-opus-4": ("0.015", "0.075"),
    "gpt-4": ("0.03", "0.06"),
    "gpt-4-turbo": ("0.01", "0.03"),
    "gpt-3.5-turbo": ("0.0005", "0.0015"),
}


def _tokens(col: Column) -> Column:
    return F.coalesce(col, F.lit(0)).cast("decimal(18,0)")


def _price(text: str, kind: str) -> Column:
    return F.lit(text).cast(kind)


def _bill(inp: Column, out: Column, p_in: Column, p_out: Column, unit: str) -> Column:
    return (_tokens(inp) * p_in + _tokens(out) * p_out) * F.lit(Decimal(unit))


def _rates(prices: dict, side: int, model: Column) -> Column:
    return lookup({m: Decimal(p[side]) for m, p in prices.items()}, model).cast("decimal(8,2)")


def cost_exact(model: Column, inp: Column, out: Column, unknown: str = "zero", prices=None) -> Column:
    """Cost by exact model name; ``unknown`` = ``zero`` | ``default`` | ``null``."""
    prices = prices or PER_MILLION
    p_in, p_out = _rates(prices, 0, model), _rates(prices, 1, model)
    if unknown == "null":
        return _bill(inp, out, p_in, p_out, "0.000001")
    d_in, d_out = ("0.00", "0.00") if unknown == "zero" else UNKNOWN_PER_MILLION
    p_in = F.coalesce(p_in, _price(d_in, "decimal(8,2)"))
    p_out = F.coalesce(p_out, _price(d_out, "decimal(8,2)"))
    return _bill(inp, out, p_in, p_out, "0.000001")


def cost_default(model: Column, inp: Column, out: Column) -> Column:
    """Unknown models are billed at the default rate."""
    return cost_exact(model, inp, out, unknown="default")


def cost_hourly(model: Column, inp: Column, out: Column) -> Column:
    """The hourly rollup's price list: fewer models, unknown ones cost nothing."""
    return cost_exact(model, inp, out, prices={m: PER_MILLION[m] for m in HOURLY_MODELS})


def cost_substring(model: Column, inp: Column, out: Column, longest_match: bool = False) -> Column:
    """Cost by the family name contained in the model name, unknown = 0.

    The first family in list order wins, so ``gpt-4-turbo-x`` is billed as
    ``gpt-4``; ``longest_match`` prefers the most specific family.
    """
    families = list(PER_THOUSAND)
    if longest_match:
        families = sorted(families, key=len, reverse=True)

    def pick(side: int) -> Column:
        hits = [
            F.when(F.lower(model).contains(f), _price(PER_THOUSAND[f][side], "decimal(9,5)"))
            for f in families
        ]
        return F.coalesce(*hits, _price("0", "decimal(9,5)"))

    return _bill(inp, out, pick(0), pick(1), "0.001")
