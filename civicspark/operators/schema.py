"""Schema and projection operators (survey C2-C6, C9-C11).

All checks are on the schema (driver side, no job); the transformations
are single projections or unions that Catalyst folds into neighbouring
stages.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.errors import SchemaError

log = logging.getLogger(__name__)

# Storage type names of the reference and their Spark types.
STORAGE_TYPES = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}
# Stamp columns the yearly vendor removes from payloads before stamping.
RESERVED_STAMPS = ("municipio", "prefeitura", "unidadegestora", "ano")


def _q(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Many renames at once. Old names must exist; a new name may not
    already exist unless it is itself renamed away (so swaps are legal).
    Positional, so ``{a: b, b: a}`` swaps instead of colliding."""
    cols = df.columns
    missing = [o for o in mapping if o not in cols]
    if missing:
        raise SchemaError(f"columns not found: {missing}; have {cols}")
    for new in mapping.values():
        if new in cols and new not in mapping:
            raise SchemaError(f"column {new!r} already exists")
    renamed = [mapping.get(c, c) for c in cols]
    if len(set(renamed)) != len(renamed):
        raise SchemaError(f"renaming would duplicate a column: {renamed}")
    return df.toDF(*renamed)


def spark_type(name: str) -> str:
    return STORAGE_TYPES.get(name.strip().upper(), name)


def retype_columns(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Retype columns with ``try_cast`` (a value that does not convert
    becomes NULL; count them with :func:`retype_rejects`). Accepts the
    storage names INTEGER / REAL / TEXT or any Spark type."""
    missing = [c for c in changes if c not in df.columns]
    if missing:
        raise SchemaError(f"columns not found: {missing}; have {df.columns}")
    return df.select([
        F.col(_q(c)).try_cast(spark_type(changes[c])).alias(c) if c in changes else F.col(_q(c))
        for c in df.columns
    ])


def retype_rejects(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Per retyped column, how many present values failed to convert
    (one aggregate pass, partial aggregation map side)."""
    aggs = [
        F.count_if(F.col(_q(c)).isNotNull() & F.col(_q(c)).try_cast(spark_type(t)).isNull()).alias(c)
        for c, t in changes.items()
    ]
    row = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(_q(c)).alias("rejects")) for c in changes])
    return row.select(F.inline(pairs))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """C4: checked drop; every name must exist and one column must remain."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"columns not found: {missing}; have {df.columns}")
    if len(set(df.columns) - set(columns)) < 1:
        raise SchemaError("at least one column must remain")
    return df.select([F.col(_q(c)) for c in df.columns if c not in columns])


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Strip and lower-case names, keep the first of duplicates.
    Positional, because name lookup is ambiguous once two columns differ
    only in case."""
    cleaned = [c.strip().lower() for c in df.columns]
    tmp = [f"__c{i}" for i in range(len(cleaned))]
    seen: dict[str, int] = {}
    for i, name in enumerate(cleaned):
        seen.setdefault(name, i)
    keep = sorted(seen.values())
    return df.toDF(*tmp).select([F.col(tmp[i]).alias(cleaned[i]) for i in keep])


def fold_case_like(batch: DataFrame, target_columns: list[str]) -> DataFrame:
    """Rename batch columns to the target's spelling when they match
    ignoring case; among batch columns equal ignoring case keep the first
    (D9)."""
    by_lower = {}
    for c in target_columns:
        by_lower.setdefault(c.lower(), c)
    seen, select = set(), []
    for c in batch.columns:
        key = c.lower()
        if key in seen:
            continue
        seen.add(key)
        select.append(F.col(_q(c)).alias(by_lower.get(key, c)))
    return batch.select(select)


def evolve_union(existing: DataFrame, batch: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Append ``batch`` to ``existing`` adding columns not seen yet
    (missing values NULL, types widened by Spark's union rules). With
    ``case_sensitive=False`` a batch column that matches an existing one
    ignoring case lands in it (yearly-vendor behaviour)."""
    if not case_sensitive:
        batch = fold_case_like(batch, existing.columns)
    return existing.unionByName(batch, allowMissingColumns=True)


def stamp_responses(responses: DataFrame, plan: DataFrame, key: str = "url",
                    stamps: tuple[str, ...] = ("municipio", "prefeitura", "ano", "mes")) -> DataFrame:
    """Attach municipality and period of the plan cell that produced
    each response - an equi-join on the request URL at one row per
    *response*, before payloads are exploded into rows. AQE picks the join
    from measured sizes."""
    return responses.join(cells_by_url(plan, key, stamps), on=key, how="inner")


def cells_by_url(plan: DataFrame, key: str = "url",
                 stamps: tuple[str, ...] = ("municipio", "prefeitura", "ano", "mes")) -> DataFrame:
    """One plan cell per request URL. A URL shared by several cells (a
    yearly template without the year) maps to its first cell in stamp order,
    deterministically."""
    first = plan.groupBy(key).agg(F.min(F.struct(*[F.col(_q(c)) for c in stamps])).alias("__cell"))
    return first.select(key, *[F.col("__cell").getField(c).alias(c) for c in stamps])


def stamp_metadata(rows: DataFrame, plan: DataFrame, key: str = "url",
                   stamps: tuple[str, ...] = ("municipio", "prefeitura", "ano", "mes"),
                   reserved: tuple[str, ...] = RESERVED_STAMPS) -> DataFrame:
    """C9 + C10 on rows that are already exploded: drop payload columns
    named like the stamps, then attach the plan cell's stamps by URL.
    Prefer :func:`stamp_responses` before exploding (fewer rows to join)."""
    drop = [c for c in rows.columns if c.lower() in {r.lower() for r in (*reserved, *stamps)}]
    return stamp_responses(rows.drop(*drop), plan, key, stamps)


def surrogate_id(df: DataFrame, source_col: str = "url", pos_col: str = "pos",
                 out: str = "row_id") -> DataFrame:
    """C11: a key stable on replay without a global sort: SHA-256 of
    the source (response URL; NULL: empty) plus the row position inside
    that response."""
    rid = F.concat_ws(":", F.sha2(F.coalesce(F.col(source_col), F.lit("")), 256), F.col(pos_col).cast("string"))
    return df.withColumn(out, rid)
