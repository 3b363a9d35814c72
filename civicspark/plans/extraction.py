"""Extraction plan and its ledger (survey G3, K1, K2, X4, X5, A6, I2).

A *cell* is one request: (topic, municipality, period). The reference
walks cells in three nested Python loops and asks SQLite, per cell, whether
rows already exist. Here the plan is one DataFrame and the existence test
is a single anti join against the distinct loaded cells.

Municipalities and topics are paired inside their vendor (an equi-join on
the vendor column; topic lists are per vendor in the reference), and the
periods are generated inside each row with ``sequence`` - the plan never
uses a cross join. AQE picks the joins from measured sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.errors import EmptySelection
from civicspark.functions.urls import month_url, normalize_url, template_url
from civicspark.plans.periods import month_cells, months_between_dates

MONTH_CELL = ("topic", "municipio", "prefeitura", "ano", "mes")
YEAR_CELL = ("topic", "municipio", "prefeitura", "unidadegestora", "ano")


def vendor_filter(catalog: DataFrame, vendor: str, vendor_col: str = "empresa",
                  require: bool = False) -> DataFrame:
    """exact, case-sensitive vendor match (pushed to the scan). With
    ``require`` an empty selection raises, as the reference stops; that runs
    a small job while the plan is built."""
    out = catalog.filter(F.col(vendor_col) == F.lit(vendor))
    if require and out.isEmpty():
        raise EmptySelection(f"no municipality with {vendor_col} == {vendor!r}")
    return out


def monthly_plan(catalog: DataFrame, topics: DataFrame, start: tuple[int, int], end: tuple[int, int],
                 vendor_col: str = "empresa", topic_col: str = "topic") -> DataFrame:
    """G3 (monthly vendors) + X4: one row per (topic, municipality, month)
    with its request URL ``base/topic?ano=Y&mes=MM``."""
    pairs = catalog.join(topics.select(vendor_col, topic_col), vendor_col, "inner")
    cells = pairs.select("*", F.explode(month_cells(start, end)).alias("__m"))
    return cells.select(
        F.col(topic_col).alias("topic"), "municipio", "prefeitura", vendor_col,
        F.year("__m").alias("ano"), F.month("__m").alias("mes"),
        month_url(normalize_url(F.col("url")), F.col(topic_col), F.year("__m"), F.month("__m")).alias("url"),
    )


def yearly_plan(catalog: DataFrame, topics: DataFrame, first_year: int, last_year: int,
                vendor_col: str = "empresa", topic_col: str = "assunto",
                template_col: str = "parametros") -> DataFrame:
    """G3 (yearly vendor) + G2 + X5: one row per (topic, municipality/unit,
    year) with its templated request URL."""
    pairs = catalog.join(topics.select(vendor_col, topic_col, template_col), vendor_col, "inner")
    years = F.when(F.lit(first_year) <= F.lit(last_year), F.sequence(F.lit(first_year), F.lit(last_year)))
    cells = pairs.select("*", F.explode(years).alias("ano"))
    unit = F.col("unidadegestora").cast("bigint").cast("string")
    return cells.select(
        F.col(topic_col).alias("topic"), "municipio", "prefeitura", unit.alias("unidadegestora"),
        vendor_col, "ano",
        template_url(F.col("url"), F.col(topic_col), F.col(template_col), unit, F.col("ano")).alias("url"),
    )


def loaded_cell_keys(loaded: DataFrame, keys) -> DataFrame:
    """Distinct cells present in the loaded table (map-side partial
    de-duplication, so a cell holding many rows ships one row per task)."""
    return loaded.select(*keys).distinct()


BROADCAST_BYTES = 32 << 20


def _known_cells(loaded: DataFrame, keys) -> DataFrame:
    """:func:`loaded_cell_keys`, broadcast if the counted cells hold at most
    ``BROADCAST_BYTES``: the plan, many rows a cell with their URLs, is then not
    shuffled by cell. Counting is a small job while the plan is built."""
    cells = loaded_cell_keys(loaded, keys)
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 16 for k in keys])
    size = cells.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(cells) if size <= BROADCAST_BYTES else cells


def pending_cells(plan: DataFrame, loaded: DataFrame, keys=MONTH_CELL) -> DataFrame:
    """K1: plan cells with no loaded row (NOT EXISTS as a left anti join)."""
    return plan.join(_known_cells(loaded, keys), list(keys), "left_anti")


def loaded_cells(plan: DataFrame, loaded: DataFrame, keys=MONTH_CELL) -> DataFrame:
    """K2: plan cells that already have rows (left semi join)."""
    return plan.join(_known_cells(loaded, keys), list(keys), "left_semi")


def high_water_mark(ledger: DataFrame, by: list[str], ano: str = "ano", mes: str | None = "mes") -> DataFrame:
    """Last loaded period per group, as (ano, mes) or (ano)."""
    if mes is None:
        return ledger.groupBy(*by).agg(F.max(ano).alias("ano"))
    idx = F.max(F.col(ano) * 12 + F.col(mes) - 1)
    agg = ledger.groupBy(*by).agg(idx.alias("__i"))
    return agg.select(*by, F.floor(F.col("__i") / 12).cast("int").alias("ano"),
                      (F.col("__i") % 12 + 1).cast("int").alias("mes"))


def resume_months(marks: DataFrame, catalog: DataFrame, end: tuple[int, int],
                  vendor_col: str = "empresa", topic_col: str = "topic") -> DataFrame:
    """I2 (monthly): cells from each topic's last loaded month *inclusive*
    through ``end``; ``marks`` holds (vendor, topic, ano, mes)."""
    start = F.make_date(F.col("ano"), F.col("mes"), F.lit(1))
    stop = F.make_date(F.lit(end[0]), F.lit(end[1]), F.lit(1))
    months = marks.select(vendor_col, topic_col, F.explode(months_between_dates(start, stop)).alias("__m"))
    cells = catalog.join(months, vendor_col, "inner")
    return cells.select(F.col(topic_col).alias("topic"), "municipio", "prefeitura", vendor_col,
                        F.year("__m").alias("ano"), F.month("__m").alias("mes"),
                        month_url(normalize_url(F.col("url")), F.col(topic_col), F.year("__m"),
                                  F.month("__m")).alias("url"))


def resume_plan(ledger: DataFrame, catalog: DataFrame, end: tuple[int, int],
                vendor_col: str = "empresa", keys=MONTH_CELL, topics: DataFrame | None = None,
                first: tuple[int, int] | None = None) -> DataFrame:
    """A6 -> G1 -> K1. High-water mark per (vendor, topic) from the
    ledger, months from there (inclusive) to ``end``, minus loaded cells.
    With ``topics`` (vendor, topic) and ``first`` (ano, mes), topics without
    a loaded row are planned from ``first``."""
    marks = high_water_mark(ledger, [vendor_col, "topic"])
    if topics is not None:
        marks = topics.select(vendor_col, "topic").distinct().join(marks, [vendor_col, "topic"], "left").select(
            vendor_col, "topic", F.coalesce("ano", F.lit(first[0])).alias("ano"), F.coalesce("mes", F.lit(first[1])).alias("mes"))
    cells = resume_months(marks, catalog, end, vendor_col)
    return pending_cells(cells, ledger, keys)


def resume_years(marks: DataFrame, catalog: DataFrame, topics: DataFrame, last_year: int,
                 vendor_col: str = "empresa", topic_col: str = "assunto",
                 template_col: str = "parametros") -> DataFrame:
    """I2 (yearly vendor): cells from each topic's last loaded year **+ 1**
    through ``last_year`` with their templated URLs; ``marks`` holds
    (vendor, topic, ano) from :func:`high_water_mark` with ``mes=None``."""
    years = F.sequence(F.col("ano") + 1, F.lit(last_year))
    todo = (marks.filter(F.col("ano") + 1 <= F.lit(last_year))
            .select(vendor_col, F.col("topic").alias(topic_col), F.explode(years).alias("ano"))
            .join(topics.select(vendor_col, topic_col, template_col), [vendor_col, topic_col], "inner"))
    cells = catalog.join(todo, vendor_col, "inner")
    unit = F.col("unidadegestora").cast("bigint").cast("string")
    return cells.select(
        F.col(topic_col).alias("topic"), "municipio", "prefeitura", unit.alias("unidadegestora"),
        vendor_col, "ano",
        template_url(F.col("url"), F.col(topic_col), F.col(template_col), unit, F.col("ano")).alias("url"),
    )


def pending_ranges(pending: DataFrame, by: tuple[str, ...] = ("topic", "municipio", "prefeitura"),
                   ano: str = "ano", mes: str | None = "mes") -> DataFrame:
    """K1 in short form: runs of consecutive missing periods per ``by`` (gaps
    and islands: a period's number less its rank is one value a run). A group
    has one row a period, so a window holds months, not table rows. Repeated
    cells count once."""
    number = F.col(ano) * 12 + F.col(mes) - 1 if mes else F.col(ano)
    cells = pending.select(*by, number.alias("__i")).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__i"))
    runs = cells.withColumn("__run", F.col("__i") - place).groupBy(*by, "__run").agg(
        F.min("__i").alias("__a"), F.max("__i").alias("__b"), F.count(F.lit(1)).alias("n_periods"))
    if not mes:
        return runs.select(*by, F.col("__a").alias("first_ano"), F.col("__b").alias("last_ano"), "n_periods")

    def year(c):
        return F.floor(F.col(c) / 12).cast("int")

    def month(c):
        return (F.col(c) % 12 + 1).cast("int")

    return runs.select(*by, year("__a").alias("first_ano"), month("__a").alias("first_mes"), year("__b").alias("last_ano"), month("__b").alias("last_mes"), "n_periods")


def expand_ranges(ranges: DataFrame, by: tuple[str, ...] = ("topic", "municipio", "prefeitura"), monthly: bool = True) -> DataFrame:
    """The cells of :func:`pending_ranges`, one row a period."""
    if not monthly:
        return ranges.select(*by, F.explode(F.sequence("first_ano", "last_ano")).alias("ano"))
    first, last = F.col("first_ano") * 12 + F.col("first_mes") - 1, F.col("last_ano") * 12 + F.col("last_mes") - 1
    cells = ranges.select(*by, F.explode(F.sequence(first, last)).alias("__i"))
    return cells.select(*by, F.floor(F.col("__i") / 12).cast("int").alias("ano"), (F.col("__i") % 12 + 1).cast("int").alias("mes"))


def resume_by_municipality(ledger: DataFrame, plan: DataFrame, keys=MONTH_CELL) -> DataFrame:
    """I2 per municipality: the cells of ``plan`` from the last loaded period
    of their own (topic, municipality) on, loaded ones left out; a
    municipality without a loaded row of the topic keeps all its cells. (The
    mark of a topic over all municipalities, as in :func:`resume_plan`, skips
    the older gaps of those that are behind.)"""
    period = [k for k in keys if k in ("ano", "mes")]
    group = [k for k in keys if k not in period]
    marks = high_water_mark(ledger, group, "ano", "mes" if "mes" in period else None)
    marks = marks.select(*group, F.struct(*[F.col(p) for p in period]).alias("__mark"))
    ahead = plan.join(marks, group, "left").filter(F.col("__mark").isNull() | (F.struct(*[F.col(p) for p in period]) >= F.col("__mark"))).drop("__mark")
    return pending_cells(ahead, ledger, keys)
