"""Person resolution for the two-jobs indicator (survey T1).

Two written names are one person's if, after normalisation, they hold the same
tokens but for one, and that token is one edit away (a letter changed, missing
or added). Names are filed by all their tokens but one; the odd token goes into
the key without one letter, so one edit away means an equal key:

* changed letter: the key holds the rest and the place of the letter that is
  left out. All names of such a block are one edit from each other, so each is
  linked to the least one, and no two of them need comparing;
* missing letter: the shorter token itself is the key, and the names that
  leave out a letter to reach it are linked to the name that has it.

Links are verified by their edit distance and joined to components.

A name becomes a row for each letter, which Spark's size estimates do not see
(they follow the file's size), so the joins are hinted to shuffle: a broadcast
would gather these rows in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.operators.components import connected_components
from civicspark.operators.indicators import multi_employment

# Letters without their accents, and particles that names do not always carry.
ACCENTED, PLAIN = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN"
PARTICLES = ("DA", "DAS", "DE", "DO", "DOS", "E")
FUZZY_LETTERS = 5  # shorter tokens must be equal


def name_tokens(name: Column) -> Column:
    """Sorted tokens: upper case, no accents, letters and digits only, no particles."""
    text = F.regexp_replace(F.translate(F.upper(name), ACCENTED, PLAIN), r"[^A-Z0-9]+", " ")
    return F.array_sort(F.filter(F.split(text, " "), lambda t: (t != "") & ~t.isin(*PARTICLES)))


def name_links(names: DataFrame) -> DataFrame:
    """(a, b): names (``names``: distinct name, tokens) one edit apart."""
    odd = names.select("name", "tokens", F.posexplode("tokens").alias("at", "token"))
    odd = odd.select("name", "token", F.concat_ws(" ", F.filter("tokens", lambda t, i: i != F.col("at"))).alias("rest"))
    odd = odd.filter((F.length("token") >= FUZZY_LETTERS) & ~F.col("token").rlike("[0-9]"))
    cuts = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.named_struct(
        F.lit("left"), F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token"))), F.lit("place"), i))
    cut = odd.select("name", "token", "rest", F.explode(cuts).alias("c")).select("name", "token", "rest", "c.left", "c.place")
    # changed letter
    least = cut.groupBy("rest", "left", "place").agg(F.min(F.struct("name", "token")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    changed = cut.join(least.hint("merge"), ["rest", "left", "place"]).select(F.col("least.name").alias("a"), F.col("least.token").alias("x"), F.col("name").alias("b"), F.col("token").alias("y"))
    # missing letter (the shorter token may be below the fuzzy length, too)
    whole = names.select("name", "tokens", F.posexplode("tokens").alias("at", "left"))
    whole = whole.select(F.col("name").alias("a"), "left", F.concat_ws(" ", F.filter("tokens", lambda t, i: i != F.col("at"))).alias("rest")).distinct()
    missing = cut.select("name", "token", "rest", "left").distinct().join(whole.hint("merge"), ["rest", "left"]).select("a", F.col("left").alias("x"), F.col("name").alias("b"), F.col("token").alias("y"))
    return changed.unionByName(missing).filter((F.col("a") != F.col("b")) & (F.levenshtein("x", "y") <= 1)).select("a", "b").distinct()


def resolve_people(rows: DataFrame, name: str = "name", out: str = "person") -> DataFrame:
    """``rows`` with ``out``, the least normalised name of the person's
    component. Names without a token (NULL, blank) have no person; names that
    normalise alike are one before any link. Distinct names are found map
    side, so a name that fills the table is one row a task."""
    tokens = name_tokens(F.col(name))
    text = F.when(F.size(tokens) > 0, F.array_join(tokens, " "))
    named = rows.withColumn("__name", text)
    names = named.filter(F.col("__name").isNotNull()).select(F.col("__name").alias("name")).distinct().withColumn("tokens", F.split("name", " "))
    who = connected_components(name_links(names)).select(F.col("node").alias("__name"), F.col("component").alias("__who"))
    return named.join(who.hint("merge"), "__name", "left").withColumn(out, F.coalesce("__who", "__name")).drop("__name", "__who")


def multi_employment_resolved(payroll: DataFrame, name: str, employer: str, period: tuple[str, ...] = ("ano", "mes"), min_employers: int = 2) -> DataFrame:
    """T1 on resolved persons: people, however their name is written, on the
    payroll of ``min_employers`` employers in one period."""
    people = resolve_people(payroll, name).filter(F.col("person").isNotNull())
    return multi_employment(people, "person", employer, period, min_employers)
