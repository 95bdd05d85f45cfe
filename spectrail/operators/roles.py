"""What the columns beside the spectra are for: targets t_, classes c_, groups g_, and plain metadata m_."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions.arrays import Refused

PREFIX = {"target": "t_", "class": "c_", "group": "g_", "metadata": "m_"}


def roles_of(df: DataFrame) -> dict[str, str]:
    """Role of each named column."""
    return {c[2:]: role for c in df.columns for role, p in PREFIX.items() if c.startswith(p)}


def _as_label(value: Column) -> Column:
    """A number as the name of a class: 1.0 is the class 1."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def change_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """The table with these columns in these roles (target, class, group, metadata or ignore).

    A target's text must be a number in every sample; the first that isn't is
    named when the rows are read.  A class needs two values.  Columns that
    aren't there, and changes that change nothing, are refused.
    """
    now = roles_of(df)
    if unknown := sorted(set(roles) - set(now)):
        raise Refused(f"no column {', '.join(unknown)}; there are {', '.join(sorted(now)) or 'none'}")
    if bad := sorted(set(roles.values()) - {*PREFIX, "ignore"}):
        raise Refused(f"no role {', '.join(bad)}")
    changes = {k: r for k, r in roles.items() if now[k] != r}
    if not changes:
        raise Refused("the columns have these roles already")
    sample = F.col("sample_id" if "sample_id" in df.columns else "sample_idx").cast("string")
    for name, role in changes.items():
        old = PREFIX[now[name]] + name
        value = F.col(f"`{old}`")
        if role == "target":
            number = F.coalesce(value.try_cast("double"), F.raise_error(F.concat(F.lit(f"column {name}, sample "), sample, F.lit(": not a number"))).cast("double"))
            df = df.withColumn(f"t_{name}", number)
        elif role != "ignore":
            df = df.withColumn(PREFIX[role] + name, _as_label(value) if now[name] == "target" else value)
            if role == "class" and df.select(f"`c_{name}`").distinct().limit(2).count() < 2:
                raise Refused(f"column {name} has one value, and a class needs two")
        df = df.drop(old)
    return df
