"""The value index: which stored values a word may mean, and in which columns they are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.columns import is_text, qcol, stripped, visible
from gristmill.functions.text import acronym, norm_text, plain, similarity_ratio, tokenize, tokens_of

CARDINALITY, BUCKET = 50_000, 4
HITS, HITS_PER_COLUMN = 12, 3
CONTAINED, FUZZY = 0.6, 0.6
INDEX_SCHEMA = "table string, column string, norm string, display string, count long"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType) and f.name in visible(df)]


def value_index(tables: dict[str, DataFrame], most: int = CARDINALITY) -> DataFrame:
    """``(table, column, norm, display, count)`` of every text column of at most ``most`` values.

    Values are counted before they are normalised, so the Unicode function sees each
    distinct value once. Columns beyond the limit are left out whole; ``column_domain``
    serves them on demand.
    """
    parts = []
    for name, df in sorted(tables.items()):
        columns = text_columns(df)
        if columns:
            long = df.select(*[stripped(qcol(c)).alias(c) for c in columns]).unpivot([], [qcol(c) for c in columns], "column", "display")
            parts.append(long.where("display is not null and display <> ''").groupBy("column", "display").count().withColumn("table", F.lit(name)))
    if not parts:
        raise ValueError("no text columns")
    counted = reduce(DataFrame.unionByName, parts)
    small = counted.groupBy("table", "column").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).drop("_n")
    return counted.join(small, ["table", "column"], "left_semi").select("table", "column", norm_text("display").alias("norm"), "display", "count")


def column_domain(df: DataFrame, column: str) -> DataFrame:
    """``(norm, spellings)``: the spellings of each normal form of a column, exactly as stored,
    so that a filter on them needs no function of the column."""
    shown = df.select(qcol(column).cast("string").alias("display")).where("display is not null and trim(display) <> ''").distinct()
    return shown.select("display", norm_text("display").alias("norm")).groupBy("norm").agg(F.sort_array(F.collect_list("display")).alias("spellings"))


def token_index(index: DataFrame, least: int = 4, bucket: int = BUCKET) -> DataFrame:
    """``(token, norm, count)``: for every token of four letters or more of a value with two such
    tokens, the ``bucket`` most frequent values that have it."""
    values = index.groupBy("norm").agg(F.sum("count").alias("count"))
    long = values.withColumn("tokens", F.array_distinct(F.filter(tokenize(F.col("norm")), lambda t: F.length(t) >= least))).where(F.size("tokens") >= 2)
    each = long.select(F.explode("tokens").alias("token"), "norm", "count")
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "norm"))
    return each.withColumn("_r", place).where(F.col("_r") <= bucket).drop("_r")


def token_table(index: DataFrame) -> DataFrame:
    """``(table, column, norm, display, count, token, initial, size)``: a row for each distinct token of each value.

    The index for misspelt words: sorted by initial and size when it is stored, so a word
    reads the tokens of its own initial and of lengths that can be like it.
    """
    each = index.select(*[c for c in ("table", "column", "norm", "display", "count")], F.explode(F.array_distinct(tokenize(F.col("norm")))).alias("token"))
    return each.withColumns({"initial": F.substring("token", 1, 1), "size": F.length("token")})


def likeness_bound(token: Column, word: str) -> Column:
    """No less than ``similarity_ratio``: matching blocks hold no letter oftener than both have it."""
    size = F.length(token)
    shared = F.lit(0)
    for letter in sorted(set(word)):
        shared = shared + F.least(F.lit(word.count(letter)), size - F.length(F.replace(token, F.lit(letter), F.lit(""))))
    return F.lit(2.0) * shared / (size + len(word))


def may_be_like(token: Column, word: str, ratio: float) -> Column:
    """Whether a token can have the ratio: by its length, its letters, and the edits that part it
    from the word. All compiled; what matches is a common subsequence, and what is left over of
    both is no less than the edit distance."""
    size, n = F.length(token), len(word)
    edits = F.levenshtein(token, F.lit(word))
    return size.between(F.lit(n * ratio / (2 - ratio) - 1e-9), F.lit(n * (2 - ratio) / ratio + 1e-9)) & (likeness_bound(token, word) >= ratio - 1e-9) & (edits <= (1 - ratio) * (size + n) + 1e-9)


def like_candidates(tokens: DataFrame, words: Sequence[str], ratio: float, initial: bool = True) -> DataFrame:
    """``(token, word)``: the pairs of distinct tokens and words whose similarity must be worked out."""
    words = list(dict.fromkeys(words))
    some = tokens.select("token").distinct()
    if initial:
        some = tokens.where(F.substring("token", 1, 1).isin(sorted({w[0] for w in words}))).select("token").distinct()
    fits = [F.when(may_be_like(F.col("token"), w, ratio) & (F.startswith("token", F.lit(w[0])) if initial else F.lit(True)), F.lit(w)) for w in words]
    return some.select("token", F.explode(F.array_compact(F.array(*fits))).alias("word")) if words else some.select("token", F.lit("").alias("word")).limit(0)


def like(tokens: DataFrame, words: Sequence[str], ratio: float, initial: bool = True) -> DataFrame:
    """``(token, word, ratio)`` of the pairs that reach the similarity; only those that can reach the function."""
    scored = like_candidates(tokens, words, ratio, initial).withColumn("ratio", similarity_ratio("token", "word"))
    return scored.where(F.col("ratio") >= ratio)


def value_hits(index: DataFrame, question: str, most: int = HITS, per_column: int = HITS_PER_COLUMN, typos: bool = True) -> DataFrame:
    """``(table, column, norm, display, count, score, kind)`` of the values that a question names.

    A value of three letters or more counts by the best of these: ``whole``, it stands in the
    question between word bounds (10 and a tenth of its length, to 13); ``contained``, a word
    of three letters or more is part of it or has it as a part, to CONTAINED of the longer one
    (5 and that share, for the first such word); ``token``, it is in the token index under a
    word of the question (4 and a twentieth of the word's length, to 5); ``typo``, it is there
    under a token with the first letter of a word and similar to FUZZY (6 and the similarity).
    At most ``per_column`` of a column and ``most`` in all, best first.
    """
    asked, words = f" {plain(question)} ", [w for w in tokens_of(question) if len(w) >= 3]
    norm, size = F.col("norm"), F.length("norm")
    if not words:
        return index.where(F.lit(False)).withColumns({"score": F.lit(0.0), "kind": F.lit("")})

    def share(word: str) -> Column:
        inside = F.contains(norm, F.lit(word)) | F.contains(F.lit(word), norm)
        ratio = F.least(size, F.lit(len(word))) / F.greatest(size, F.lit(len(word)))
        return F.when(inside & (ratio >= CONTAINED), ratio)

    whole = F.when(F.contains(F.lit(asked), F.concat(F.lit(" "), norm, F.lit(" "))), F.struct((10 + F.least(size, F.lit(30)) / 10).alias("score"), F.lit("whole").alias("kind")))
    part = F.coalesce(*[share(w) for w in words])
    contained = F.when(part.isNotNull(), F.struct((5 + part).alias("score"), F.lit("contained").alias("kind")))
    direct = index.where(size >= 3).withColumn("hit", F.coalesce(whole, contained)).where("hit is not null").select("table", "column", "norm", "display", "count", "hit")
    long = [w for w in dict.fromkeys(words) if len(w) >= 4]
    near = index.where(F.lit(False)).select("norm").withColumn("hit", F.struct(F.lit(0.0).alias("score"), F.lit("").alias("kind")))
    if long or typos:
        # only tokens that begin like a word are looked at; the index is by token, so this filter goes below it
        tokens = token_index(index).where(F.col("token").isin(*long) if not typos else F.substring("token", 1, 1).isin(*sorted({w[0] for w in words})))
        near = tokens.where(F.col("token").isin(*long)).select("norm", F.struct((4 + F.least(F.length("token"), F.lit(20)) / 20).alias("score"), F.lit("token").alias("kind")).alias("hit"))
        if typos:
            alike = tokens.join(like(tokens, words, FUZZY), "token")
            near = near.unionByName(alike.select("norm", F.struct((6 + F.col("ratio")).alias("score"), F.lit("typo").alias("kind")).alias("hit")))
    near = near.groupBy("norm").agg(F.max("hit").alias("hit"))
    both = direct.unionByName(index.join(near, "norm").select(*direct.columns))
    found = both.groupBy("table", "column", "norm", "display", "count").agg(F.max("hit").alias("hit"))
    found = found.select("table", "column", "norm", "display", "count", F.round("hit.score", 4).alias("score"), F.col("hit.kind").alias("kind"))
    place = Window.partitionBy("table", "column").orderBy(F.desc("score"), F.desc("count"), "norm", "display")
    return found.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= per_column).drop("_r").orderBy(F.desc("score"), F.desc("count"), "table", "column", "norm").limit(most)


def value_rebind(index: DataFrame, table: str, value: str) -> DataFrame:
    """The columns of a table that hold a value, the one with the most rows first."""
    found = index.where((F.col("table") == table) & (F.col("norm") == plain(value)))
    return found.groupBy("column").agg(F.sum("count").alias("count"), F.sort_array(F.collect_list("display")).alias("spellings")).orderBy(F.desc("count"), "column")


def resolve_token_set(index: DataFrame, phrase: str) -> DataFrame:
    """Values made of exactly the phrase's tokens, in whatever order."""
    words = sorted(set(tokens_of(phrase)))
    same = F.array_sort(F.array_distinct(tokenize(F.col("norm")))) == F.array(*[F.lit(w) for w in words]).cast("array<string>")
    return index.where(same).select("table", "column", "norm", "display", "count")


def resolve_phrase(index: DataFrame, phrase: str) -> DataFrame:
    """The one value that has all of the phrase's tokens; no row if there are none or several.

    Every token needs three letters and one of them four.
    """
    words = sorted(set(tokens_of(phrase)))
    if not words or min(map(len, words)) < 3 or max(map(len, words)) < 4:
        return index.where(F.lit(False)).select("norm", F.lit(0).cast("long").alias("count"))
    asked = F.array(*[F.lit(w) for w in words])
    found = index.where(F.size(F.array_except(asked, tokenize(F.col("norm")))) == 0).groupBy("norm").agg(F.sum("count").alias("count"))
    number = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.where(number == 1)


def _has_initial(tokens: str, initial: str) -> Column:
    return F.exists(tokens, lambda t: F.startswith(t, F.lit(initial)))


def resolve_fuzzy(domain: DataFrame, phrase: str, ratio: float = FUZZY) -> DataFrame:
    """Values of a domain (column ``norm``) whose tokens match the phrase's, misspelled ones by similarity.

    Each token of the phrase must equal one of the value, or share its first letter and
    be similar to ``ratio``. Values without a token of each first letter never reach the
    similarity function.
    """
    words = sorted(set(tokens_of(phrase)))
    tokens = domain.select("norm", tokenize(F.col("norm")).alias("tokens"))
    for initial in sorted({w[0] for w in words}):
        tokens = tokens.where(_has_initial("tokens", initial))
    each = tokens.select("norm", F.explode("tokens").alias("token"))
    near = each.join(like(each, words, ratio), "token")
    best = near.groupBy("norm", "word").agg(F.max("ratio").alias("ratio"))
    return best.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("ratio")).where(F.col("n") == len(words)).select("norm", F.round("ratio", 6).alias("ratio"))


def close_matches(domain: DataFrame, value: str, n: int = 3, cutoff: float = FUZZY) -> DataFrame:
    """The n values of a domain most similar to ``value``, at ``cutoff`` or above."""
    scored = domain.where(may_be_like(F.col("norm"), plain(value), cutoff)).select("norm", similarity_ratio("norm", F.lit(plain(value))).alias("ratio"))
    return scored.where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), F.desc("norm")).limit(n)


def acronym_match(domain: DataFrame, letters: str) -> DataFrame:
    """Values whose leading tokens' initials spell ``letters``."""
    return domain.where(acronym(F.col("norm"), len(letters)) == letters.lower()).select("norm")


def spelled(index: DataFrame, table: str, column: str, values: Sequence[str]) -> DataFrame:
    """Stored spellings of values in a column."""
    wanted = [plain(v) for v in values]
    return index.where((F.col("table") == table) & (F.col("column") == column) & F.col("norm").isin(*wanted)).select("norm", "display")
