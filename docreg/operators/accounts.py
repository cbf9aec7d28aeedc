"""Checks on staff accounts (names and roles only, no secrets)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts by name without regard to case."""
    return accounts.select("username", "is_admin").orderBy(F.lower("username"), "username")


def duplicate_names(accounts: DataFrame) -> DataFrame:
    """Names used more than once, compared without case and outer blanks."""
    name = F.lower(F.trim("username"))
    return accounts.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def account_counts(accounts: DataFrame) -> DataFrame:
    """Users, admins and whether the last admin is at stake."""
    counts = accounts.agg(F.count(F.lit(1)).alias("users"), F.count_if("is_admin").alias("admins"))
    return counts.withColumn("last_admin", F.col("admins") <= 1)


def account_checks(accounts: DataFrame) -> DataFrame:
    """One row per distinct name: how often it is used, and whether an admin
    change to it would leave no admin account."""
    name = F.lower(F.trim("username"))
    names = accounts.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_admin").alias("n_admins")
    )
    totals = names.agg(F.sum("n_admins").alias("admins"))
    return names.join(F.broadcast(totals)).select(
        "name", "n", (F.col("n") > 1).alias("duplicate"), (F.col("n_admins") > 0).alias("is_admin"),
        ((F.col("n_admins") > 0) & (F.col("admins") <= 1)).alias("last_admin"),
    )
