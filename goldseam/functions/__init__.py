"""Column functions: cleaning, prices and classifications.  All run as Spark built-ins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Labels a classification may give.
ACCOUNT_STATUSES = ("NEGATIVE", "POSITIVE")
SIZE_CATEGORIES = ("SMALL", "MEDIUM", "LARGE")
PERFORMANCE_TIERS = ("High Performer", "Medium Performer", "Low Performer")
STOCK_LEVELS = ("High Stock", "Medium Stock", "Low Stock")
COST_CATEGORIES = ("Low Cost", "Medium Cost", "High Cost")


def strip_whitespace(text: Column) -> Column:
    """Strip every kind of whitespace; ``F.trim`` strips spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def account_status(balance: Column) -> Column:
    """A missing balance counts as positive."""
    return F.when(balance < 0, "NEGATIVE").otherwise("POSITIVE")


def size_category(size: Column) -> Column:
    """A missing size counts as large."""
    return F.when(size < 10, "SMALL").when(size < 30, "MEDIUM").otherwise("LARGE")


def performance_tier(net_revenue: Column) -> Column:
    return (
        F.when(net_revenue > 50_000, "High Performer")
        .when(net_revenue > 10_000, "Medium Performer")
        .otherwise("Low Performer")
    )


def stock_level(quantity: Column) -> Column:
    return (
        F.when(quantity > 1000, "High Stock")
        .when(quantity > 100, "Medium Stock")
        .otherwise("Low Stock")
    )


def cost_category(cost: Column, retail_price: Column) -> Column:
    """Thresholds are decimals, so the comparison is exact; no retail price means high cost."""
    return (
        F.when(cost < retail_price * F.lit(Decimal("0.5")), "Low Cost")
        .when(cost < retail_price * F.lit(Decimal("0.7")), "Medium Cost")
        .otherwise("High Cost")
    )


def net_price(price: Column, discount: Column) -> Column:
    return price * (1 - discount)


def total_price(price: Column, discount: Column, tax: Column) -> Column:
    return net_price(price, discount) * (1 + tax)


def discount_amount(price: Column, discount: Column) -> Column:
    return price * discount


def is_weekend(date: Column) -> Column:
    """``dayofweek`` counts from 1 = Sunday to 7 = Saturday."""
    return F.dayofweek(date).isin(1, 7)
