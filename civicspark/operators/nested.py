"""Responses and nested payloads (survey F2, S5, J1-J7, A4, A5).

A landing table holds one row per fetched response (``url``, ``status``,
``body``). Bodies are parsed with Spark's JSON reader; the row schema is
inferred once per call with ``schema_of_variant_agg`` (a single-row
aggregate with partial aggregation), then every body is read with
``from_json`` and exploded - two parses per body, no Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.functions.text import BLANKS, BOM, json_text

# Response classes.
OK, EMPTY, ERROR, INVALID = "ok", "empty", "error", "invalid"
ZIP_LENGTH_ERROR = "lists of one response differ in length"

# Stamp columns: a payload field of the same name gives way to the stamp.
STAMPS = ("municipio", "prefeitura", "unidadegestora", "ano", "mes")
SAME = "\x01"  # marks a struct field whose name repeats an earlier one in another case


def clean_body(body="body") -> Column:
    """The body without blanks and byte-order marks at its ends (one trim
    over characters)."""
    return F.btrim(F.col(body) if isinstance(body, str) else body, F.lit(BLANKS + BOM))


def classify_responses(landing: DataFrame, status: str = "status", body: str = "body",
                       out: str = "response_class") -> DataFrame:
    """HTTP error -> ``error``; blank body -> ``empty``; body that is not
    JSON -> ``invalid``; otherwise ``ok``."""
    b = clean_body(body)
    klass = (F.when(F.col(status) >= 400, F.lit(ERROR))
             .when(b.isNull() | (b == ""), F.lit(EMPTY))
             .when(F.try_parse_json(b).isNull(), F.lit(INVALID))
             .otherwise(F.lit(OK)))
    return landing.withColumn(out, klass)


def fetched_bodies(landing: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """Responses worth parsing, bodies cleaned: no HTTP error (a missing
    status is none, as in :func:`classify_responses`), non-blank body.
    Malformed JSON needs no separate test here - it yields no rows."""
    cleaned = landing.withColumn(body, clean_body(body))
    return cleaned.filter((F.coalesce(F.col(status), F.lit(0)) < 400) & (F.col(body) != ""))


def body_shape(body="body") -> Column:
    b = clean_body(body)
    return (F.when(b.startswith("["), F.lit("array"))
            .when(b.startswith("{"), F.lit("object"))
            .otherwise(F.lit("scalar")))


def as_array_text(body="body") -> Column:
    """A single object becomes a one-element array, so objects and
    lists share one schema and one code path."""
    b = clean_body(body)
    return F.when(b.startswith("{"), F.concat(F.lit("["), b, F.lit("]"))).otherwise(b)


_TYPE_TEXT = re.compile(r"`(?:[^`]|``)*`|(\w+)(?=: )|OBJECT<|DECIMAL\(\d+,\s*\d+\)|\bVARIANT\b|\bVOID\b")


def variant_schema_to_ddl(schema: str) -> str:
    """Turn ``schema_of_variant`` text into a ``from_json`` DDL type: objects
    become structs, decimals doubles (pandas floats), and VARIANT (mixed
    types) / VOID (only nulls) become STRING. Field names stay as they are."""
    def word(m):
        text = m.group(0)
        if text.startswith("`"):
            return text
        if m.group(1):
            return f"`{text}`"
        return "STRUCT<" if text == "OBJECT<" else "DOUBLE" if text.startswith("DECIMAL") else "STRING"

    return _TYPE_TEXT.sub(word, schema)


def _parsed(body="body") -> Column:
    """The body parsed once into a VARIANT (objects wrapped into a list);
    NULL when blank or not JSON."""
    return F.try_parse_json(as_array_text(body))


def infer_payload(responses: DataFrame, body: str = "body") -> tuple[str | None, bool]:
    """:func:`infer_payloads` over all responses together."""
    return infer_payloads(responses, body).get(None, (None, False))


def infer_payloads(responses: DataFrame, body: str = "body", by: str | None = None) -> dict:
    """One aggregate pass: for each value of ``by`` (``None``: all responses
    together) the merged element type (DDL) of array-wrapped bodies - None
    when no body holds objects - and whether any body is a plain JSON value.
    Only one row a group reaches the driver.

    Lists of plain values give no rows (D10) and must not blur the merged
    object type into VARIANT: bodies whose text opens a list with an object
    feed the schema (a cheap text test); only for groups where some list
    still mixes objects with other values is the exact per-row schema test
    used."""
    shape = body_shape(body)
    v = _parsed(body)
    b = clean_body(body)
    opens_objects = (shape == "object") | b.rlike(r"^\[\s*\{")
    group = F.lit(None).cast("string") if by is None else F.col(by)

    def run(rows, feed):
        return {r["g"]: (r["s"], bool(r["has_scalar"])) for r in rows.groupBy(*([] if by is None else [group.alias("g")])).agg(
            *([group.alias("g")] if by is None else []),
            F.schema_of_variant_agg(F.when(feed, v)).alias("s"),
            F.max(F.when(shape == "scalar", v.isNotNull())).alias("has_scalar")).collect()}

    def objects(schema):
        return schema is not None and schema.startswith("ARRAY<OBJECT<")

    found = run(responses, opens_objects)
    mixed = [g for g, (schema, _) in found.items() if schema is not None and not objects(schema)]
    if mixed:
        exact = (shape != "scalar") & F.schema_of_variant(v).startswith("ARRAY<OBJECT<")
        found |= run(responses if by is None else responses.filter(group.isin(mixed)), exact)
    return {g: (variant_schema_to_ddl(schema)[len("ARRAY<"):-1] if objects(schema) else None, has_scalar)
            for g, (schema, has_scalar) in found.items()}


def infer_rows_schema(responses: DataFrame, body: str = "body") -> str | None:
    """Element type (DDL) of the array-wrapped bodies, merged over all rows."""
    return infer_payload(responses, body)[0]


def _told_apart(dtype: T.DataType) -> T.DataType:
    """The struct type with a mark on fields that repeat a name in another case."""
    if not isinstance(dtype, T.StructType):
        return dtype
    times: dict[str, int] = {}
    fields = []
    for f in dtype.fields:
        k = times.get(f.name.lower(), 0)
        times[f.name.lower()] = k + 1
        fields.append(T.StructField(f.name + SAME * k, _told_apart(f.dataType)))
    return T.StructType(fields)


def _first_present(cols: list[tuple[Column, T.DataType]]) -> Column:
    """The first present value; as text where the types differ."""
    if len(cols) == 1:
        return cols[0][0]
    if any(t != cols[0][1] for _, t in cols):
        return F.coalesce(*[json_text(c, t).cast("string") for c, t in cols])
    return F.coalesce(*[c for c, _ in cols])


def _no_rows(responses: DataFrame, keep: list[str], pos: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, responses.schema[c].dataType) for c in keep] + [T.StructField(pos, T.IntegerType())])
    return responses.sparkSession.createDataFrame([], schema)


def json_rows(responses: DataFrame, body: str = "body", keep: list[str] | None = None,
              element_ddl: str | None = None, pos: str = "pos") -> DataFrame:
    """Every object of a list (or a single object) becomes one row;
    keys are unioned over all responses, a missing key is NULL. Names that
    differ only in case are one column, the first present value wins (D9).
    Bodies that hold a list of plain scalars give no rows (D10); scalars go
    through :func:`scalar_valor`. ``pos`` is the object's position in its
    response. A payload field named like a kept stamp (:data:`STAMPS`) is
    dropped (C9); one named like another kept column, or like ``pos``, gets
    the prefix ``payload_``.
    Bodies that are not JSON give no rows (``from_json`` is permissive)."""
    keep = list(keep if keep is not None else [c for c in responses.columns if c != body])
    element_ddl = element_ddl or infer_rows_schema(responses, body)
    if element_ddl is None:
        return _no_rows(responses, keep, pos)
    items = F.from_json(as_array_text(body), f"ARRAY<{element_ddl}>")
    parsed = responses.filter(body_shape(body) != "scalar").select(*keep, items.alias("__items"))
    element = _told_apart(parsed.schema["__items"].dataType.elementType)
    exploded = parsed.select(*keep, F.posexplode(F.col("__items").cast(T.ArrayType(element))).alias(pos, "__item"))
    columns: dict[str, tuple[str, list]] = {}
    for f in element.fields:
        name = f.name.rstrip(SAME)
        columns.setdefault(name.lower(), (name, []))[1].append((F.col("__item").getField(f.name), f.dataType))
    stamps = {c.lower() for c in keep if c.lower() in STAMPS}
    taken = {c.lower() for c in (*keep, pos)}
    out = []
    for low, (name, found) in columns.items():
        if low in stamps:
            continue
        while name.lower() in taken:
            name = f"payload_{name}"
            if name.lower() in columns:
                taken.add(name.lower())
        out.append(_first_present(found).alias(name))
    return exploded.select(*keep, pos, *out)


def scalar_valor(responses: DataFrame, body: str = "body", keep: list[str] | None = None,
                 out: str = "valor") -> DataFrame:
    """A payload that is a plain JSON value becomes one row with the
    value's text in ``valor``."""
    keep = list(keep if keep is not None else [c for c in responses.columns if c != body])
    scalars = responses.filter(body_shape(body) == "scalar")
    return scalars.select(*keep, F.variant_get(F.try_parse_json(clean_body(body)), "$", "string").alias(out))


def _fields(dtype: T.StructType):
    return [(f.name, f.dataType) for f in dtype.fields]


def _object_arrays(df: DataFrame, sep: str = "_") -> list[tuple[str, Column, T.ArrayType]]:
    """(path, column, type) of every array of objects that lies in no other array."""
    found = []

    def find(c, dtype, path):
        if isinstance(dtype, T.StructType):
            for name, sub in _fields(dtype):
                find(c.getField(name), sub, path + [name])
        elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            found.append((sep.join(path), c, dtype))

    for f in df.schema.fields:
        find(F.col(f"`{f.name}`"), f.dataType, [f.name])
    return found


def indexed_values(df: DataFrame, keep: list[str], sep: str = "_", from_index: dict[str, int] | None = None) -> DataFrame:
    """J3 in long form: one row for each field of each object of each array of
    objects - (keep, path, idx, field, value as text; deeper objects by their
    joined names, deeper arrays as JSON text). The width of the table does not
    depend on the longest list. ``from_index``: per path the first index that
    is wanted."""
    def leaves(x: Column, dtype: T.StructType, prefix: str) -> list[Column]:
        out = []
        for name, sub in _fields(dtype):
            if isinstance(sub, T.StructType):
                out += leaves(x.getField(name), sub, f"{prefix}{name}{sep}")
            else:
                out.append(F.struct(F.lit(prefix + name).alias("field"), json_text(x.getField(name), sub).cast("string").alias("value")))
        return out

    per_path = []
    for path, c, dtype in _object_arrays(df, sep):
        first = (from_index or {}).get(path, 0)
        tail = F.slice(c, first + 1, F.greatest(F.size(c) - first, F.lit(0))) if first else c
        per_path.append(F.flatten(F.transform(F.coalesce(tail, F.array().cast(dtype)), lambda x, i: F.transform(
            F.array(*leaves(x, dtype.elementType, "")), lambda v: F.struct(F.lit(path).alias("path"), (i + first).alias("idx"), v["field"].alias("field"), v["value"].alias("value"))))))
    entries = F.concat(*per_path) if per_path else F.array().cast("array<struct<path:string,idx:int,field:string,value:string>>")
    return df.select(*keep, F.explode(entries).alias("__e")).select(*keep, "__e.path", "__e.idx", "__e.field", "__e.value")


def array_widths(df: DataFrame, quantile: float = 0.99, sep: str = "_") -> dict[str, int]:
    """For each array of objects the ``quantile`` of its lengths, from one
    mergeable sketch a path (KLL; one row reaches the driver). An array that
    is NULL has no length."""
    paths = _object_arrays(df, sep)
    if not paths:
        return {}
    size = lambda c: F.when(c.isNotNull(), F.size(c).cast("long"))
    row = df.agg(*[F.kll_sketch_agg_bigint(size(c)).alias(f"s{i}") for i, (_, c, _) in enumerate(paths)],
                 *[F.count(size(c)).alias(f"n{i}") for i, (_, c, _) in enumerate(paths)])
    row = row.select(*[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_bigint(f"s{i}", F.lit(quantile))).alias(f"w{i}") for i in range(len(paths))]).first()
    return {path: int(row[f"w{i}"] or 0) for i, (path, _, _) in enumerate(paths)}


def pivot_indexed(df: DataFrame, keep: list[str], quantile: float = 0.99, sep: str = "_") -> tuple[DataFrame, DataFrame]:
    """J3 with a bounded width: (the flat table with as many indexed columns
    a list as ``quantile`` of the lists need, the entries beyond in long
    form). One list of many entries lengthens the second and leaves the plan
    of the first as it is."""
    widths = array_widths(df, quantile, sep)
    return flatten_struct(df, sep, index_arrays=True, index_widths=widths), indexed_values(df, keep, sep, from_index=widths)


def flatten_struct(df: DataFrame, sep: str = "_", index_arrays: bool = False,
                   max_index_width: int | None = None, index_widths: dict[str, int] | None = None) -> DataFrame:
    """Nested objects -> ``a_b_c`` columns. Arrays of objects
    become indexed columns ``key_0_sub``, ``key_1_sub``... when
    ``index_arrays`` (width = largest array, measured by one aggregate row);
    beyond ``max_index_width`` the remaining elements stay whole, as JSON
    text in ``key_rest``; ``index_widths`` gives the widths without measuring,
    and elements beyond are left to :func:`indexed_values`. Other arrays become JSON text (empty -> NULL).
    On a name clash the first column wins."""
    widths = dict(index_widths or {})
    if index_arrays and index_widths is None:
        paths = _object_arrays(df, sep)
        if paths:
            row = df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(f"w{i}") for i, (_, c, _) in enumerate(paths)]).first()
            widths = {name: int(row[f"w{i}"]) for i, (name, _, _) in enumerate(paths)}

    found: dict[str, tuple[str, list]] = {}

    def emit(c: Column, name: str, dtype: T.DataType):
        plain = name.replace(SAME, "")
        cols = found.setdefault(plain.lower(), (plain, []))[1]
        if not cols or SAME in name:
            cols.append((c, dtype))

    def walk(c: Column, dtype: T.DataType, name: str):
        if isinstance(dtype, T.StructType):
            for sub, subtype in _fields(dtype):
                walk(c.getField(sub), subtype, f"{name}{sep}{sub}")
        elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType) and index_arrays:
            width = widths.get(name, 0)
            shown = width if max_index_width is None else min(width, max_index_width)
            for i in range(shown):
                walk(F.get(c, i), dtype.elementType, f"{name}{sep}{i}")
            if shown < width:
                rest = F.slice(c, shown + 1, F.greatest(F.size(c) - shown, F.lit(0)))
                emit(json_text(rest, dtype), f"{name}{sep}rest", T.StringType())
        elif isinstance(dtype, (T.ArrayType, T.MapType)):
            emit(json_text(c, dtype), name, T.StringType())
        else:
            emit(c, name, dtype)

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select([_first_present(cols).alias(name) for name, cols in found.values()])


def zip_columns_to_rows(df: DataFrame, col: str, keep: list[str],
                        pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """An object of equal-length arrays ``{k: [...], ...}`` becomes
    one row per index. Returns ``(rows, errors)``; a response whose arrays
    differ in length goes to ``errors`` whole, none of it is dropped."""
    dtype = df.schema[col].dataType
    names = [n for n, t in _fields(dtype) if isinstance(t, T.ArrayType)]
    if not names or len(names) != len(dtype.fields):
        raise ValueError(f"{col} must be an object whose values are all arrays")
    sizes = [F.coalesce(F.size(F.col(col).getField(n)), F.lit(0)) for n in names]
    same = F.lit(True) if len(sizes) == 1 else (F.greatest(*sizes) == F.least(*sizes))
    flagged = df.withColumn("__same", same)
    zipped = F.arrays_zip(*[F.col(col).getField(n).alias(n) for n in names])
    rows = (flagged.filter("__same")
            .select(*keep, F.posexplode(zipped).alias(pos, "__z"))
            .select(*keep, pos, *[F.col("__z").getField(n).alias(n) for n in names]))
    errors = flagged.filter(~F.col("__same")).select(*keep, F.lit(ZIP_LENGTH_ERROR).alias("error"))
    return rows, errors


def unpack_columnar(responses: DataFrame, body: str = "body", uneven: str = "uneven") -> DataFrame:
    """J5 on raw bodies: an object whose values are all lists of plain values
    becomes the text of a list of objects, one per index; other bodies stay
    (an object of lists of objects is one row, J3). ``uneven`` is true, and
    the body NULL, where the lists differ in length."""
    b = clean_body(body)
    first_is_list = b.rlike(r'^\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\[')

    def kind(m: Column) -> Column:
        names, lists = F.map_keys(m), F.map_values(m)
        plain = F.forall(lists, lambda x: x.isNotNull() & ~F.exists(x, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))))
        columnar = F.coalesce(F.size(m) > 0, F.lit(False)) & plain & (F.size(F.array_distinct(names)) == F.size(names))
        sizes = F.transform(lists, lambda x: F.size(x))
        return F.struct(m.alias("m"), columnar.alias("columnar"), F.array_max(sizes).alias("last"), F.array_min(sizes).alias("least"))

    def text(k: Column) -> Column:
        names, lists, last = F.map_keys(k["m"]), F.map_values(k["m"]), k["last"]
        objects = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.map_from_arrays(names, F.transform(lists, lambda x: F.get(x, i))))
        odd = F.coalesce(k["columnar"] & (last != k["least"]), F.lit(False))
        return F.struct(odd.alias("odd"), F.when(odd, F.lit(None).cast("string")).when(
            k["columnar"], F.when(last > 0, F.to_json(objects)).otherwise("[]")).otherwise(F.col(body)).alias("text"))

    # each value is bound by a transform and the result leaves by an explode, which no later filter or
    # projection is pushed through: the body is parsed here once, however often its text is used below
    lists = F.when(first_is_list, F.from_json(b, "map<string,array<variant>>"))
    told = responses.select("*", F.explode(F.transform(F.transform(F.array(lists), kind), text)).alias("__told"))
    return told.withColumn(uneven, F.col("__told.odd")).withColumn(body, F.col("__told.text")).drop("__told")


def payload_errors(landing: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """The fetched responses whose columnar payload cannot be unpacked."""
    keep = list(keep if keep is not None else [c for c in landing.columns if c != body])
    return (unpack_columnar(fetched_bodies(landing, body=body), body, "__uneven").filter("__uneven")
            .select(*keep, F.lit(ZIP_LENGTH_ERROR).alias("error")))


def payload_table(ok: DataFrame, body: str, keep: list[str], index_arrays: bool = False, pos: str = "pos",
                  inferred: tuple[str | None, bool] | None = None) -> DataFrame:
    """Flat rows of bodies that were fetched and unpacked: objects (J1/J6,
    J2-J4) and plain values in ``valor`` (J7); a ``valor`` of both kinds with
    different types is text. ``inferred``: what :func:`infer_payload` says
    of them, where it is known."""
    ddl, has_scalar = inferred or infer_payload(ok, body)
    found = json_rows(ok, body=body, keep=keep, element_ddl=ddl, pos=pos) if ddl else _no_rows(ok, keep, pos)
    rows = flatten_struct(found, index_arrays=index_arrays)
    if not has_scalar:
        return rows
    name = next((c for c in rows.columns if c.lower() == "valor"), "valor")
    scalars = scalar_valor(ok, body=body, keep=keep, out=name)
    scalars = scalars.filter(F.col(name).isNotNull()).withColumn(pos, F.lit(0))
    if name in rows.columns:
        rows = rows.withColumn(name, F.col(name).cast("string"))
    return rows.unionByName(scalars, allowMissingColumns=True)


def scan_json_payload(landing: DataFrame, body: str = "body", keep: list[str] | None = None,
                      index_arrays: bool = False) -> DataFrame:
    """Landing responses -> flat typed rows: fetched, non-blank bodies
    (F2's ``ok`` class: malformed ones yield nothing), columnar ones unpacked
    (J5; :func:`payload_errors` gives those that cannot be), lists/objects
    exploded (J1/J6) and flattened (J2-J4); plain-value bodies land in
    ``valor`` (J7). Two passes over the landing table: one aggregate for the
    schema, one to extract."""
    keep = list(keep if keep is not None else [c for c in landing.columns if c != body])
    ok = unpack_columnar(fetched_bodies(landing, body=body), body, "__uneven").filter("NOT __uneven")
    return payload_table(ok, body, keep, index_arrays)
