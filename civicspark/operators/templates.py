"""Error templates (survey S4, A3): log messages grouped by what they say.

A message becomes its tokens with changing ones masked; equal sequences are
counted map side, so a message that fills the log is one row a task. Of the
few sequences left, those that differ in one position only are one template
with that position masked, if there are ``min_variants`` of them: each
sequence is filed under itself with one position masked at a time, so they
meet by equality and no two sequences are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The mask, and what a token holds that changes from one message to the next.
MASK = "<*>"
CHANGING = r"[0-9]|://|@"
MOST_TOKENS = 256  # longer messages are counted by their sequence, and not merged


def masked_tokens(message: Column) -> Column:
    """Tokens between white space, those with digits, URLs or addresses masked."""
    tokens = F.filter(F.split(F.coalesce(message, F.lit("")), r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.when(t.rlike(CHANGING), MASK).otherwise(t))


def error_templates(errors: DataFrame, by: str = "error_type", message: str = "message", at: str = "logged_at", min_variants: int = 3) -> DataFrame:
    """(by, template, n, n_variants, share of the rows of ``by``, first_at,
    last_at). A sequence that fits several templates joins the one of most
    variants, then the one masked furthest left. NULL and blank messages are
    the empty template."""
    base = errors.groupBy(F.col(by).alias("by"), masked_tokens(F.col(message)).alias("tokens")).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    places = base.filter(F.size("tokens") <= MOST_TOKENS).select("by", "tokens", F.posexplode("tokens").alias("place", "token")).filter(F.col("token") != MASK)
    filed = places.select("by", "tokens", "place", F.transform("tokens", lambda t, i: F.when(i == F.col("place"), MASK).otherwise(t)).alias("wild"))
    wild = filed.groupBy("by", "wild").agg(F.count(F.lit(1)).alias("variants")).filter(F.col("variants") >= min_variants)
    same = F.col("f.by").eqNullSafe(F.col("w.by")) & (F.col("f.wild") == F.col("w.wild"))
    best = filed.alias("f").join(wild.alias("w"), same).groupBy(F.col("f.by").alias("b_by"), F.col("f.tokens").alias("b_tokens")).agg(
        F.max(F.struct(F.col("w.variants"), -F.col("f.place"), F.col("f.wild"))).getField("wild").alias("wild"))
    named = base.join(best, F.col("by").eqNullSafe(F.col("b_by")) & (F.col("tokens") == F.col("b_tokens")), "left")
    out = named.groupBy("by", F.array_join(F.coalesce("wild", "tokens"), " ").alias("template")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_variants"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("by"))
    return out.select(F.col("by").alias(by), "template", "n", "n_variants", share.alias("share"), "first_at", "last_at")
