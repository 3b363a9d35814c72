"""Failed-request lookup (survey K3, K4, D1).

The intent of the reference's retry lookup: a failed URL belongs to the
catalog entry whose base URL is a prefix of it; the longest prefix wins,
then the lowest catalog id. Kept an equi-join: each failed URL is expanded
into its few path prefixes (scheme://authority, then one more path part at
a time) and hash-joined with the catalog - no theta or nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.urls import base_of, normalize_url, repair_retry_url, url_part


def url_prefixes(url: Column) -> Column:
    """``scheme://authority`` (lower case) plus every longer path prefix,
    without query or fragment."""
    segs = F.filter(F.split(F.coalesce(url_part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(segs)),
        lambda n: F.concat(base_of(url), F.array_join(F.transform(F.slice(segs, 1, n), lambda s: F.concat(F.lit("/"), s)), "")),
    )


def catalog_key(url: Column) -> Column:
    """Normalised catalog base URL in the same form as :func:`url_prefixes`."""
    u = normalize_url(url)
    path = F.rtrim(F.coalesce(url_part(u, "PATH"), F.lit("")), F.lit("/"))
    return F.when(url_part(u, "AUTHORITY").isNotNull(), F.concat(base_of(u), path))


def retry_lookup(failed: DataFrame, catalog: DataFrame, failed_id: str, failed_url: str = "url",
                 catalog_id: str = "id", catalog_url: str = "url",
                 catalog_cols: list[str] | None = None,
                 failed_unit: Column | None = None, catalog_unit: str | None = None) -> DataFrame:
    """K3: failed rows with their catalog entry (``catalog_cols`` attached).
    Optional unit match (yearly vendor): ``failed_unit`` must equal the
    catalog's ``catalog_unit`` as text."""
    catalog_cols = list(catalog_cols or [])
    repaired = repair_retry_url(F.col(failed_url))
    f = failed.select(failed_id, F.explode(url_prefixes(repaired)).alias("__prefix"),
                      *([failed_unit.cast("string").alias("__unit")] if failed_unit is not None else []))
    cat_sel = [F.col(catalog_id).alias("__cid"), catalog_key(F.col(catalog_url)).alias("__prefix"),
               *[F.col(c).alias(f"__cat_{c}") for c in catalog_cols]]
    if catalog_unit:
        cat_sel.append(F.col(catalog_unit).cast("string").alias("__unit"))
    c = catalog.select(*cat_sel).filter(F.col("__prefix").isNotNull())
    on = ["__prefix"] + (["__unit"] if failed_unit is not None and catalog_unit else [])
    cand = f.join(c, on, "inner")
    best = cand.groupBy(failed_id).agg(F.min(F.struct(
        (-F.length("__prefix")).alias("neg_len"), F.col("__cid").alias("cid"),
        F.col("__prefix").alias("base"), *[F.col(f"__cat_{x}").alias(x) for x in catalog_cols])).alias("__b"))
    picked = best.select(failed_id, F.col("__b.cid").alias(f"catalog_{catalog_id}"),
                         F.col("__b.base").alias("catalog_base"),
                         *[F.col(f"__b.{x}").alias(x) for x in catalog_cols])
    return failed.join(picked, failed_id, "inner")


def retry_unmatched(failed: DataFrame, matched: DataFrame, failed_id: str) -> DataFrame:
    """K4: failed rows with no catalog entry."""
    return failed.join(matched.select(failed_id), failed_id, "left_anti")
