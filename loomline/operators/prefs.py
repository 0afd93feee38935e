"""Personal lists as sets of ids: following, watching, completed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(ids: Column) -> Column:
    """Distinct ids that aren't empty, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: i.isNotNull() & (F.length(i) > 0))))


def toggled(ids: Column, one: Column) -> Column:
    """With the id if it was missing, without it if it was there."""
    return F.when(F.array_contains(ids, one), F.array_remove(ids, one)).otherwise(F.array_append(ids, one))


def consistent(followed: Column, watching: Column, completed: Column) -> Column:
    """struct of the three lists; what is completed is not being watched."""
    done = normal(completed)
    return F.struct(normal(followed).alias("followed"), F.array_except(normal(watching), done).alias("watching"), done.alias("completed"))


def toggle_watching(lists: Column, one: Column) -> Column:
    """Nothing changes for what is completed."""
    watching = F.when(F.array_contains(lists["completed"], one), lists["watching"]).otherwise(toggled(lists["watching"], one))
    return consistent(lists["followed"], watching, lists["completed"])


def toggle_completed(lists: Column, one: Column) -> Column:
    return consistent(lists["followed"], lists["watching"], toggled(lists["completed"], one))


def toggle_follow(lists: Column, one: Column) -> Column:
    return consistent(toggled(lists["followed"], one), lists["watching"], lists["completed"])


def reconciled(lists: Column, known: Column, finished: Column) -> Column:
    """After a refresh: finished items are no longer followed, and only finished or unknown ones watched."""
    running = F.array_except(normal(known), normal(finished))
    return consistent(F.array_except(normal(lists["followed"]), normal(finished)), F.array_except(normal(lists["watching"]), running), lists["completed"])
