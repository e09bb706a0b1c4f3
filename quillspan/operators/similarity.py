"""Similarity joins of names by edit distance and containment, by equality of their parts: no pair is made that shares nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.shared import stored

#: Characters of the longest grams by which contained names are found.
GRAM = 3


def allowed(length: Column) -> Column:
    """Edits within which a name is near one of this length: a third of it, two at the least."""
    return F.greatest(F.lit(2), F.floor(length / 3)).cast("int")


def _segment(length: str, edits: str, i: str) -> tuple[str, str]:
    """Start (from 0) and length of the i-th of edits + 1 even segments; the last ones are a character longer where they must be."""
    parts, base = f"({edits} + 1)", f"({length} div ({edits} + 1))"
    long_ones = f"({length} % {parts})"
    late = f"greatest(0, {i} - ({parts} - {long_ones}))"
    return f"cast({i} * {base} + {late} as int)", f"cast({base} + if({i} >= {parts} - {long_ones}, 1, 0) as int)"


def _segment_keys(names: DataFrame, name: str) -> DataFrame:
    """(name, key): the segments of each name, for every number of edits at which a name of some length could ask for it."""
    start, size = _segment("n", "e", "i")
    key = f"transform(sequence(0, e), i -> xxhash64(e, n, i, substring({name}, {start} + 1, {size})))"
    # a name of length m asks with max(2, m div 3) edits, and its length differs by no more: from about a quarter of n to a half
    least, most = "greatest(2, cast(floor(n / 4) as int) - 1)", "greatest(2, cast(floor(n / 2) as int) + 1)"
    return names.withColumn("n", F.length(name)).select(name, F.explode(F.expr(f"flatten(transform(sequence({least}, {most}), e -> {key}))")).alias("key"))


def _probe_keys(asked: DataFrame, name: str, edits: str) -> DataFrame:
    """(name, edits, key): the parts of each name at which a segment of a name within `edits` edits can be.

    If segments 0 to i-1 of the other name hold an edit each at the least, at most e - i are
    left to its right; so segment i is shifted by i at the most seen from the left, and by e - i seen from the right.
    """
    start, size = _segment("l", edits, "i")
    low = f"greatest(0, {start} - i, {start} + (m - l) - ({edits} - i))"
    high = f"least(m - {size}, {start} + i, {start} + (m - l) + ({edits} - i))"
    at = f"if({high} >= {low}, sequence({low}, {high}), cast(array() as array<int>))"
    one = f"transform({at}, p -> xxhash64({edits}, l, i, substring({name}, p + 1, {size})))"
    keys = f"flatten(transform(sequence(greatest(0, m - {edits}), m + {edits}), l -> flatten(transform(sequence(0, {edits}), i -> {one}))))"
    return asked.withColumn("m", F.length(name)).select(name, edits, F.explode(F.array_distinct(F.expr(keys))).alias("key"))


def within_edits(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs with an edit distance of at most e, from asked (a, e) and known (b).

    If e edits make one string of another cut into e + 1 segments, a segment
    is whole: pairs meet by equality of (edits, length, segment), at the few
    places where that segment can be. Nothing within the distance is lost.
    """
    met = _probe_keys(asked, "a", "e").join(_segment_keys(known, "b").withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"))
    # a distance over the threshold isn't counted to its end
    return met.withColumn("distance", F.expr("levenshtein(a, b, e)")).where("distance >= 0").select("a", "b", "distance").distinct()


def containing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b) of all pairs where b contains a, from asked (a) and known (b).

    A name of up to GRAM characters is a gram itself. Of a longer one the gram that fewest known names have is looked up;
    if none has it, no name contains the whole.
    """
    sizes = f"transform(sequence(1, greatest(1, length(b) - g + 1)), i -> substring(b, i, g))"
    grams = known.select("b", F.explode(F.expr(f"array_union(array(''), array_distinct(flatten(transform(sequence(1, {GRAM}), g -> {sizes}))))")).alias("gram"))
    grams = grams.where("gram = '' or length(gram) > 0")
    own = asked.select("a", F.explode(F.expr(f"if(length(a) <= {GRAM}, array(a), array_distinct(transform(sequence(1, length(a) - {GRAM - 1}), i -> substring(a, i, {GRAM}))))")).alias("_gram"))
    often = grams.groupBy(F.col("gram").alias("_of")).agg(F.count("*").alias("n"))
    rarest = own.join(often, F.col("_gram") == F.col("_of"), "left").groupBy("a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("r")).select("a", F.col("r.g").alias("_gram"))
    return rarest.join(grams, F.col("_gram") == F.col("gram")).where(F.col("b").contains(F.col("a"))).select("a", "b")


def similar_names(names: DataFrame, candidates: DataFrame, name: str, most: int) -> DataFrame:
    """The `most` nearest of all candidates' names for each row's name, by edit distance of the names in lower case, ties by name.

    Near are names within max(2, a third of the asked name's length) edits,
    and names that contain the asked one; a name is not near itself. Both
    sides are made distinct first, in lower case too, and pairs are found by
    equality of parts (within_edits, containing). Only the `most` first of a
    name leave a task, so a name that many contain isn't gathered. A null name
    has no near one.
    """
    asked = stored(names.select(F.col(name).alias("_a")).where("_a is not null").distinct().select("_a", F.lower("_a").alias("a"), allowed(F.length("_a")).alias("e")))
    known = stored(candidates.select(F.col(name).alias("other")).where("other is not null").distinct().withColumn("b", F.lower("other")))
    a, b = asked.select("a", "e").distinct(), known.select("b").distinct()
    # edits are those of the name as it is asked for; names that differ in case only have one number of them, but for rare letters
    near = within_edits(a, b).unionByName(containing(a.select("a").distinct(), b).withColumn("distance", F.expr("levenshtein(a, b)"))).distinct()
    told = asked.join(near.withColumnRenamed("a", "_l"), F.col("a") == F.col("_l")).join(known.withColumnRenamed("b", "_k"), F.col("b") == F.col("_k")).where("_a <> other and (distance <= e or contains(b, a))")
    first = told.select("_a", "other", "distance").withColumn("place", F.row_number().over(Window.partitionBy("_a").orderBy("distance", "other"))).where(F.col("place") <= most)
    return names.join(first, F.col(name) == F.col("_a")).select(*[c for c in names.columns if c != name], "other", "distance", "place")
