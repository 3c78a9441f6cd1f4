"""Value dictionaries, literal resolution and the match ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.text import squeeze
from gridlake.operators.terms import with_terms
from gridlake.sources.scratch import shared_dir


def enum_dictionary(
    df: DataFrame, table: str, columns: list[str], max_values: int = fv.ENUM_MAX_VALUES
) -> DataFrame:
    """Distinct values of the low-cardinality columns: table_name, column_name, value.

    A sketch in one scan drops columns far above the limit, so their values are never
    shuffled; the exact count decides for the rest.
    """
    sketch = df.agg(*[F.approx_count_distinct(F.col(c), 0.02).alias(c) for c in columns]).first()
    likely = [c for c in columns if sketch[c] <= 4 * max_values]
    if not likely:
        return df.sparkSession.createDataFrame(
            [], "table_name string, column_name string, value string")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in likely
    ])).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    low = pairs.groupBy("column_name").count().where(F.col("count") <= max_values)
    return pairs.join(low, "column_name", "left_semi").select(
        F.lit(table).alias("table_name"), "column_name", "value")


def schema_context(columns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Column descriptors with their sample values as one line each."""
    samples = dictionary.groupBy("table_name", "column_name").agg(
        F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("samples"))
    return columns.join(samples, ["table_name", "column_name"], "left")


def known_aliases(df: DataFrame) -> DataFrame:
    """term, target, kind of the fixed business terms."""
    rows = [(k, v, "column") for k, v in fv.COLUMN_ALIASES.items()]
    rows += [(k, v, "value") for k, v in fv.VALUE_ALIASES.items()]
    return df.sparkSession.createDataFrame(rows, "term string, target string, kind string")


def alias_expansion(questions: DataFrame, text: str, aliases: DataFrame | None = None) -> DataFrame:
    """Business terms in a question with the column or value they stand for, longest first.

    aliases: term, target, kind, of any number; the plan does not grow with them. What the
    terms of a question stand for comes by an equi-join on the term.
    """
    aliases = aliases if aliases is not None else known_aliases(questions)
    found = with_terms(questions, text, aliases, "__terms")
    meant = aliases.groupBy("term").agg(F.collect_list(F.struct("target", "kind")).alias("__meant"))
    # written, so that a row has one number for both of its readers
    folder = shared_dir(questions.sparkSession, "aliases")
    found.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    keyed = questions.sparkSession.read.parquet(folder)
    told = keyed.select("__row", F.explode("__terms").alias("term")).join(meant, "term").select(
        "__row", "term", F.explode("__meant").alias("m"))
    by_row = told.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(
        (-F.length("term")).alias("neg_length"), "term", F.col("m.target").alias("target"), F.col("m.kind").alias("kind")))).alias("aliases"))
    none = F.array().cast("array<struct<neg_length:int,term:string,target:string,kind:string>>")
    return keyed.join(by_row, "__row", "left").withColumn("aliases", F.coalesce("aliases", none)).drop("__row", "__terms")


def match_keys(dictionary: DataFrame) -> DataFrame:
    """Every key under which a stored value can be named.

    These are the whole value, its beginnings that end at a blank, and its single words.
    Keyed values turn the lenient predicate into an equi-join.
    """
    whole = squeeze(F.col("value"))
    words = F.split(whole, " ")
    beginnings = F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    keys = F.array_distinct(F.concat(beginnings, words))
    return dictionary.withColumn("key", F.explode(keys)).where(F.col("key") != "")


def literal_candidates(literals: DataFrame, dictionary: DataFrame, literal: str) -> DataFrame:
    """Literals joined to the stored values they may mean."""
    asked = literals.withColumn("key", squeeze(F.col(literal))).where(F.col("key") != "")
    return asked.join(match_keys(dictionary), "key").drop("key")


def resolve_literals(literals: DataFrame, dictionary: DataFrame, literal: str) -> DataFrame:
    """Verdict per distinct literal: RESOLVED, AMBIGUOUS with candidates, or UNCHANGED."""
    asked = literals.select(literal).distinct()
    named = literal_candidates(asked, dictionary, literal).groupBy(literal).agg(
        F.array_sort(F.collect_set("value")).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return asked.join(named, literal, "left").select(
        literal,
        F.when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("UNCHANGED").alias("verdict"),
        F.when(n == 1, F.get("candidates", F.lit(0))).when(n == 0, F.col(literal)).alias("resolved"),
        F.when(n > 1, F.array_join("candidates", ", ")).alias("candidates"),
    )


#: Rungs: equal, equal but for case and outer blanks, contained.
MATCH_MODES = {1: "exact", 2: "normalized", 3: "fuzzy"}


#: Characters of the pieces by which contained literals find values.
GRAM = 3


def match_ladder(df: DataFrame, column: str, literals: list[str] | DataFrame) -> DataFrame:
    """Rows at the best rung of the ladder per literal, with match_mode.

    literals are texts or a DataFrame with a column `literal`. The stored values are ranked
    once, after reducing them to distinct ones; rows then come back through an equi-join. Works
    on row filters, so an aggregate above it sees the matched rows. A literal without any
    match has no row here; see `match_modes`.
    """
    return df.join(_best_values(df, column, literals), column)


def match_modes(df: DataFrame, column: str, literals: list[str] | DataFrame) -> DataFrame:
    """match_mode per literal, exact-not-found where no rung matches."""
    asked = _asked(df, literals)
    best = _best_values(df, column, asked).select("literal", "match_mode").distinct()
    return asked.join(best, "literal", "left").fillna("exact-not-found", ["match_mode"])


def _asked(df: DataFrame, literals: list[str] | DataFrame) -> DataFrame:
    if not isinstance(literals, DataFrame):
        literals = df.sparkSession.createDataFrame([(x,) for x in literals], "literal string")
    return literals.select("literal").where("literal IS NOT NULL").distinct()


def grams(text: Column, length: Column) -> Column:
    """The distinct pieces of `length` characters of a text; of length 0 the empty one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - length + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, length)))


def contained_in(values: DataFrame, column: str, literals: DataFrame) -> DataFrame:
    """(column, literal) where the value contains the literal, letter case ignored.

    A value that contains a literal has all of its pieces of GRAM characters, or of its own
    length if it is shorter. The literal's rarest piece alone leads to the values that hold it,
    by an equi-join; those are then tested. A literal with a piece that no value has is done.
    """
    low = literals.select("literal", F.lower("literal").alias("__low")).withColumn("__size", F.least(F.length("__low"), F.lit(GRAM)))
    sizes = [r["__size"] for r in low.select("__size").distinct().collect()]  # at most GRAM + 1
    if not sizes:
        return values.select(column).limit(0).withColumn("literal", F.lit(None).cast("string"))
    held = values.select(column).where(F.col(column).isNotNull()).withColumn("__value", F.lower(F.col(column)))

    def sized(n: int) -> Column:
        named = F.transform(grams(F.col("__value"), F.lit(n)), lambda g: F.struct(F.lit(n).alias("__size"), g.alias("__gram")))
        return F.when(F.length("__value") >= n, named).otherwise(F.array().cast("array<struct<__size:int,__gram:string>>"))

    pieces = F.flatten(F.array(*[sized(n) for n in sorted(sizes)]))
    postings = held.select(column, "__value", F.explode(pieces).alias("p")).select(column, "__value", "p.__size", "p.__gram")
    often = postings.groupBy("__size", "__gram").agg(F.count("*").alias("__often"))
    asked = low.withColumn("__gram", F.explode(grams(F.col("__low"), F.col("__size"))))
    rarest = asked.join(often, ["__size", "__gram"], "left").groupBy("literal", "__low", "__size").agg(
        F.min_by("__gram", F.struct(F.coalesce("__often", F.lit(0)), "__gram")).alias("__gram"),
        F.min(F.coalesce("__often", F.lit(0))).alias("__least")).where("__least > 0")
    return postings.join(rarest, ["__size", "__gram"]).where(F.contains("__value", F.col("__low"))).select(column, "literal")


def _best_values(df: DataFrame, column: str, literals: list[str] | DataFrame) -> DataFrame:
    asked, values = _asked(df, literals), df.select(column).distinct()
    exact = values.join(asked, values[column] == asked["literal"]).select(column, "literal", F.lit(MATCH_MODES[1]).alias("match_mode"))
    left = asked.join(exact.select("literal").distinct(), "literal", "left_anti")
    key = "__key"
    near = values.withColumn(key, F.lower(F.trim(F.col(column)))).join(
        left.withColumn(key, F.lower(F.trim("literal"))), key).select(column, "literal", F.lit(MATCH_MODES[2]).alias("match_mode"))
    rest = left.join(near.select("literal").distinct(), "literal", "left_anti")
    fuzzy = contained_in(values, column, rest).withColumn("match_mode", F.lit(MATCH_MODES[3]))
    return exact.unionByName(near).unionByName(fuzzy)
