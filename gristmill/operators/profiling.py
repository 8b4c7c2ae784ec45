"""Column profiles and relationships between tables, from whole columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.columns import is_date, is_number, is_text, number, qcol, stripped, visible
from gristmill.functions.text import strip_upper

COVERAGE, PARENT_UNIQUE, LEAST_DISTINCT, MOST_DISTINCT = 0.95, 0.95, 3, 50_000
# What each way of finding shared keys asks for.
JACCARD = {"same_name": 0.7, "similar_name": 0.8, "id_pattern": 0.75}
SHARED_COVERAGE, SHARED_DISTINCT = 0.6, 8


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column, from one aggregate over the table.

    (column, kind, rows, nulls, distinct, null_rate, unique_ratio, least, most,
    numeric_rate, year_share). Distinct values are counted exactly; ``numeric_rate`` is
    the share of values that read as numbers, ``year_share`` that of whole numbers from
    1900 to 2100. Exact distinct counts of several columns make Spark expand every row once
    per column; without ``exact`` they are sketched to about one in a hundred instead, in
    one pass that shuffles nothing but sketches.
    """
    fields = [f for f in df.schema if f.name in visible(df)]
    parts: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = qcol(f.name)
        simple = is_number(f.dataType) or is_text(f.dataType)
        value = number(c) if simple else F.lit(None).cast("double")
        comparable = c if simple or is_date(f.dataType) else c.cast("string")
        parts += [
            F.count(c).alias(f"n{i}"),
            (F.count_distinct(comparable) if exact else F.least(F.hll_sketch_estimate(F.hll_sketch_agg(comparable.cast("string"), 14)), F.count(c))).alias(f"d{i}"),
            F.min(comparable).cast("string").alias(f"lo{i}"),
            F.max(comparable).cast("string").alias(f"hi{i}"),
            F.count(value).alias(f"num{i}"),
            F.count_if((value == F.floor(value)) & value.between(1900, 2100)).alias(f"y{i}"),
        ]
    one = df.agg(*parts)

    def kind(f) -> str:
        return "number" if is_number(f.dataType) else "date" if is_date(f.dataType) else "bool" if f.dataType.typeName() == "boolean" else "text"

    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(kind(f)).alias("kind"),
                (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
                F.col(f"d{i}").alias("distinct"),
                F.round(F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")), 4).alias("null_rate"),
                F.round(F.try_divide(F.col(f"d{i}"), F.col(f"n{i}")), 4).alias("unique_ratio"),
                F.col(f"lo{i}").alias("least"),
                F.col(f"hi{i}").alias("most"),
                F.round(F.try_divide(F.col(f"num{i}"), F.col(f"n{i}")), 4).alias("numeric_rate"),
                F.round(F.try_divide(F.col(f"y{i}"), F.col(f"num{i}")), 4).alias("year_share"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return one.select("rows", F.explode(rows).alias("p")).select("p.*", "rows")


def year_like(profile: DataFrame) -> DataFrame:
    """Columns that hold years: named so, or numbers of which 80 % lie in 1900-2100 and at most 150 differ."""
    named = F.lower("column").rlike(r"(^|[^a-z])(year|yr|έτος|ετος)([^a-z]|$)")
    return profile.select("column", ((F.col("kind") == "number") & (F.col("distinct") <= 150) & (named | (F.col("year_share") >= 0.8))).alias("year_like"))


def key_uniqueness(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """(key, rows, distinct, ratio) for each candidate key, composite ones joined by ``+``."""
    parts = [F.count_distinct(F.struct(*[qcol(c) for c in k])).alias(str(i)) for i, k in enumerate(keys)]
    rows = F.array(*[F.struct(F.lit("+".join(k)).alias("key"), F.col(str(i)).alias("distinct")) for i, k in enumerate(keys)])
    one = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    return one.select("rows", F.explode(rows).alias("k")).select("k.key", "rows", "k.distinct", F.round(F.try_divide(F.col("k.distinct"), F.col("rows")), 4).alias("ratio"))


def column_values(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Distinct ``(table, column, value)`` of the named columns; values upper-cased and trimmed."""
    parts = []
    for table, df in sorted(tables.items()):
        names = columns[table]
        text = df.select(*[strip_upper(qcol(c).cast("string")).alias(c) for c in names])
        parts.append(text.unpivot([], [qcol(c) for c in names], "column", "value").where("value is not null and value <> ''").select(F.lit(table).alias("table"), "column", "value"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _pairs(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of all columns, and the number of values that two columns of different tables share.

    The value's own columns are gathered, of which a catalogue has a bounded number, so
    a frequent value costs one row and pairs are made within it.
    """
    sizes = values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("distinct"))
    owners = values.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("o")).where(F.size("o") > 1)
    both = owners.select(F.explode("o").alias("a"), "o").select("a", F.explode("o").alias("b")).where("a.table <> b.table")
    shared = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return sizes, shared


def relationships(tables: dict[str, DataFrame], columns: dict[str, list[str]], rows: dict[str, int] | None = None, most: int | None = MOST_DISTINCT) -> DataFrame:
    """``(child_table, child_column, parent_table, parent_column, coverage)``: the child's values lie in the parent's.

    The parent is unique to PARENT_UNIQUE, the coverage at least COVERAGE, both have
    LEAST_DISTINCT to ``most`` values (None: or more). Of several parents of a child column in
    one table the best covering (then first named) stays.
    """
    sizes, shared = _pairs(column_values(tables, columns))
    filled = reduce(
        DataFrame.unionByName,
        [df.agg(*[F.count(qcol(c)).alias(c) for c in columns[t]]).unpivot([], [qcol(c) for c in columns[t]], "column", "filled").select(F.lit(t).alias("table"), "column", "filled") for t, df in sorted(tables.items())],
    )
    known = sizes.join(filled, ["table", "column"]).where(F.col("distinct") >= LEAST_DISTINCT)
    known = known if most is None else known.where(F.col("distinct") <= most)
    child = known.select(F.col("table").alias("ct"), F.col("column").alias("cc"), F.col("distinct").alias("cd"))
    parent = known.where(F.col("distinct") >= PARENT_UNIQUE * F.col("filled")).select(F.col("table").alias("pt"), F.col("column").alias("pc"))
    found = (
        shared.select(F.col("a.table").alias("ct"), F.col("a.column").alias("cc"), F.col("b.table").alias("pt"), F.col("b.column").alias("pc"), "shared")
        .join(child, ["ct", "cc"])
        .join(parent, ["pt", "pc"])
        .withColumn("coverage", F.round(F.col("shared") / F.col("cd"), 4))
        .where(F.col("shared") >= COVERAGE * F.col("cd"))
    )
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("ct", "cc", "pt").orderBy(F.desc("coverage"), "pc"))).where("_r = 1")
    return best.select(F.col("ct").alias("child_table"), F.col("cc").alias("child_column"), F.col("pt").alias("parent_table"), F.col("pc").alias("parent_column"), "coverage")


def jaccard_columns(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """``(left_table, left_column, right_table, right_column, shared, jaccard, coverage)`` of columns with common values."""
    sizes, shared = _pairs(column_values(tables, columns))
    a = sizes.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), F.col("distinct").alias("dl"))
    b = sizes.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), F.col("distinct").alias("dr"))
    one_way = shared.where("a.table < b.table").select(F.col("a.table").alias("left_table"), F.col("a.column").alias("left_column"), F.col("b.table").alias("right_table"), F.col("b.column").alias("right_column"), "shared")
    out = one_way.join(a, ["left_table", "left_column"]).join(b, ["right_table", "right_column"])
    return out.select(
        "left_table", "left_column", "right_table", "right_column", "shared",
        F.round(F.col("shared") / (F.col("dl") + F.col("dr") - F.col("shared")), 4).alias("jaccard"),
        F.round(F.col("shared") / F.least("dl", "dr"), 4).alias("coverage"),
        F.least("dl", "dr").alias("least_distinct"),
    )


def shared_keys(pairs: DataFrame) -> DataFrame:
    """Pairs of ``jaccard_columns`` that count as keys, with the way they were found and its strength."""
    same = F.lower("left_column") == F.lower("right_column")
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\W_]|code|id|key|no", "")
    similar = (bare("left_column") == bare("right_column")) & (bare("left_column") != "")
    ids = F.lower("left_column").rlike("(id|key|code)$") & F.lower("right_column").rlike("(id|key|code)$")
    way = (
        F.when(same & (F.col("jaccard") > JACCARD["same_name"]), "same_name")
        .when(similar & (F.col("jaccard") > JACCARD["similar_name"]), "similar_name")
        .when(ids & (F.col("jaccard") > JACCARD["id_pattern"]), "id_pattern")
        .when((F.col("coverage") >= SHARED_COVERAGE) & (F.col("least_distinct") >= SHARED_DISTINCT), "shared_values")
    )
    found = pairs.withColumn("way", way).where("way is not null")
    return found.withColumn("strength", F.when(F.col("way") == "shared_values", F.col("coverage")).otherwise(F.col("jaccard")))


def strongest(found: DataFrame) -> DataFrame:
    """One row per pair of columns: the strongest, then the first way by name."""
    pair = Window.partitionBy("left_table", "left_column", "right_table", "right_column").orderBy(F.desc("strength"), "way")
    return found.withColumn("_r", F.row_number().over(pair)).where("_r = 1").drop("_r")


def names_to_strip(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def strip_cells(df: DataFrame) -> DataFrame:
    """Every text cell without surrounding white space."""
    texts = set(names_to_strip(df))
    return df.select(*[stripped(qcol(c)).alias(c) if c in texts else qcol(c) for c in df.columns])


def dropna_all(df: DataFrame) -> DataFrame:
    """Without the rows and the columns that are null throughout."""
    names = visible(df)
    counts = df.agg(*[F.count(qcol(c)).alias(str(i)) for i, c in enumerate(names)]).first()
    full = [c for i, c in enumerate(names) if counts[i]]
    kept = df.select(*[qcol(c) for c in df.columns if c in full or c not in names])
    some = reduce(lambda a, b: a | b, [qcol(c).isNotNull() for c in full], F.lit(False))
    return kept.where(some)


KEEP_RATIO, TEXT_IS_NUMBER = 0.8, 0.95


def coercions(df: DataFrame, verdicts: dict[str, str] | None = None) -> DataFrame:
    """(column, filled, as_number, as_date, type): what each text column can become, in one pass.

    A wanted type (number, date, text) holds if KEEP_RATIO of the values survive it;
    otherwise number, then date, then text are tried. Text is overruled where
    TEXT_IS_NUMBER of the values are numbers.
    """
    from gristmill.functions.dates import parse_date

    names = names_to_strip(df)
    parts = []
    for i, c in enumerate(names):
        some = F.nullif(stripped(qcol(c)), F.lit(""))
        parts += [F.count(some).alias(f"n{i}"), F.count(number(some)).alias(f"num{i}"), F.count(parse_date(some)).alias(f"day{i}")]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, filled long, as_number long, as_date long, type string")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("filled"), F.col(f"num{i}").alias("as_number"), F.col(f"day{i}").alias("as_date"), F.lit((verdicts or {}).get(c)).cast("string").alias("wanted")) for i, c in enumerate(names)])
    found = df.agg(*parts).select(F.explode(rows).alias("c")).select("c.*")
    keeps = lambda c: (F.col("filled") > 0) & (F.col(c) >= KEEP_RATIO * F.col("filled"))
    kind = (
        F.when((F.col("wanted") == "number") & keeps("as_number"), "number")
        .when((F.col("wanted") == "date") & keeps("as_date"), "date")
        .when((F.col("wanted") == "text") & ~((F.col("filled") > 0) & (F.col("as_number") >= TEXT_IS_NUMBER * F.col("filled"))), "text")
        .when(keeps("as_number"), "number")
        .when(keeps("as_date"), "date")
        .otherwise("text")
    )
    return found.withColumn("type", kind).drop("wanted")


def coerce(df: DataFrame, verdicts: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its text columns turned into what ``coercions`` says."""
    from gristmill.functions.dates import parse_date

    kinds = {r["column"]: r["type"] for r in coercions(df, verdicts).collect()}
    change = {"number": lambda c: number(stripped(qcol(c))), "date": lambda c: parse_date(qcol(c)), "text": qcol}
    return df.select(*[change[kinds.get(c, "text")](c).alias(c) for c in df.columns])


def typed_if_all_numeric(df: DataFrame) -> DataFrame:
    """Text columns become numbers where every cell that is not blank reads as one (commas allowed)."""
    names = names_to_strip(df)
    value = lambda c: F.translate(stripped(qcol(c)), ",", "").try_cast("double")
    if not names:
        return df
    stats = df.agg(*[F.count_if((stripped(qcol(c)) != "") & value(c).isNull()).alias(f"b{i}") for i, c in enumerate(names)], *[F.count(value(c)).alias(f"g{i}") for i, c in enumerate(names)]).first()
    good = {c for i, c in enumerate(names) if stats[f"b{i}"] == 0 and stats[f"g{i}"] > 0}
    return df.select(*[value(c).alias(c) if c in good else qcol(c) for c in df.columns])


#: Rows of a range, and ranges that are put in order in one place.
RANGE, RANGES = 65_536, 4096


def regions(df: DataFrame, order: str, blank: Column, blanks: int = 2) -> DataFrame:
    """Rows with the number of their region; ``blanks`` or more blank rows begin a new one.

    A cumulative count over the whole order would put every row in one task. Instead
    ranges of ``order`` are counted first, ranges of ranges on top of them, and so on up to
    a single one; each row adds what its ranges have before them, so no window is over more
    than RANGE rows. ``order`` must be dense integers, as a sheet's row numbers are: a gap of
    ``blanks`` or more missing or blank rows ends a region.
    """
    filled = df.where(~blank)
    least, most = filled.agg(F.min(qcol(order)), F.max(qcol(order))).first()
    part = F.floor((qcol(order) - F.lit(least or 0)) / RANGE)
    inside = Window.partitionBy(part).orderBy(qcol(order))
    marked = filled.withColumn("_p", part).withColumn("_gap", (qcol(order) - F.lag(qcol(order)).over(inside) > blanks).cast("long"))
    ends = marked.groupBy("_p").agg(F.min(qcol(order)).alias("lo"), F.max(qcol(order)).alias("hi"), F.sum(F.coalesce("_gap", F.lit(0))).alias("n"))
    before = _before(ends, blanks, ((most or 0) - (least or 0)) // RANGE)
    inner = Window.partitionBy("_p").orderBy(qcol(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("_in", F.sum(F.coalesce("_gap", F.lit(0))).over(inner)).join(before, "_p")
    return numbered.withColumn("region", F.col("_before") + F.col("_in")).drop("_p", "_gap", "_in", "_before")


def _before(ends: DataFrame, blanks: int, most: int) -> DataFrame:
    """``(_p, _before)``: the regions begun before each range from 0 to ``most``, at its first row
    included; of a range ``lo`` and ``hi`` are the first and last row, ``n`` what begins inside."""
    near = Window.partitionBy("_q").orderBy("_p")
    placed = ends.withColumn("_q", F.floor(F.col("_p") / RANGES))
    jump = F.coalesce((F.col("lo") - F.lag("hi").over(near) > blanks).cast("long"), F.lit(0))
    placed = placed.withColumn("_step", jump + F.coalesce(F.lag("n").over(near), F.lit(0))).withColumn("_here", F.sum("_step").over(near))
    if most < RANGES:
        return placed.select("_p", F.col("_here").alias("_before"))
    above = placed.groupBy("_q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max_by("_here", "_p") + F.max_by("n", "_p")).alias("n"))
    outer = _before(above.withColumnRenamed("_q", "_p"), blanks, most // RANGES).withColumnsRenamed({"_p": "_q", "_before": "_outer"})
    return placed.join(outer, "_q").select("_p", (F.col("_here") + F.col("_outer")).alias("_before"))
