"""Directory and file names of the log layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """NULL for an empty id."""
    return F.nullif(c, F.lit(""))


def slug(c: Column) -> Column:
    """Letters, digits and `-_.` stay, all else becomes `_`; an absent id is `_`.

    A slug of dots only would name a parent directory, so it is prefixed.
    """
    safe = F.regexp_replace(present(c), r"[^\p{L}\p{N}_.-]", "_")
    return F.coalesce(F.when(safe.rlike(r"^\.+$"), F.concat(F.lit("_"), safe)).otherwise(safe), F.lit("_"))


def log_dirs(client: Column, lead: Column, website: Column, user: Column) -> tuple[Column, Column]:
    """(client_dir, lead_dir): by client and lead, else under `_unfiled` by website or user."""
    filed = present(client).isNotNull() | present(lead).isNotNull()
    return (
        F.when(filed, slug(client)).otherwise("_unfiled"),
        F.when(filed, slug(lead)).otherwise(slug(F.coalesce(present(website), user))),
    )
