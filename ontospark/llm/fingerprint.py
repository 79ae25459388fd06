"""Document fingerprints [native]: bottom-k sketches of shingle hashes.

Only DataFrame and SQL functions are used; nothing here starts a Python worker.

A text's shingles are its runs of ``WIDTH`` words (maximal runs of characters other than white space in ASCII, lower-cased); a text of fewer
words has one shingle, the whole sequence, and one without words none. A word is hashed once, and a shingle is the hash of its words'
hashes. The sketch is the sorted array of the ``K`` smallest distinct shingle hashes. Sketches of parts merge into the sketch of
their union, so they can be made anywhere and aggregated; from sketches alone come estimates of resemblance, containment and the number of
distinct shingles, which are exact (but for hash collisions) up to K shingles.

``neighbours`` gives each row the text of the next one in an order without a window over all rows: rows are dealt to buckets by
ranges of the key, whose bounds are quantiles, and each bucket has besides the first row of the bucket after it.

Defined cases: a null text is an empty one and has an empty sketch; two empty sketches have resemblance and containment 1, an empty
and another one 0; null keys come last in descending order, equal keys in the order of their text's hash; repeated rows are rows of their own; a
single row is its own neighbour; an empty table gives no row; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: Hashes of a sketch.
K = 256
#: Bytes of text that a bucket has about, and buckets at most: their bounds pass through the driver.
BUCKET_BYTES, BUCKETS = 32 << 20, 1 << 14

NONE = "CAST(array() AS array<bigint>)"


def words(text: Column) -> Column:
    """The hash of each word, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def sketched(df: DataFrame, texts: dict[str, Column], k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds a sketch column for each named text."""
    # each step is a projection of its own: an array that a lambda reads must be a column, or it would be made again for each element
    steps = {name: f"_{name}_words" for name in texts}
    df = df.select("*", *(words(t).alias(steps[n]) for n, t in texts.items()))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
    short = lambda w: F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.expr(NONE))
    df = df.select(*df.columns, *(F.when(F.size(w) >= width, hashes(w)).otherwise(short(w)).alias(f"_{n}_grams") for n, w in steps.items()))
    out = [c for c in df.columns if c not in steps.values() and c not in [f"_{n}_grams" for n in texts]]
    return df.select(*(F.col(f"`{c}`") for c in out), *(F.slice(F.sort_array(F.array_distinct(f"_{n}_grams")), 1, k).alias(n) for n in texts))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts, from theirs."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """``keys, sketch``: the sketches of each group's parts as one.

    Equal hashes of a group meet first, spread by hash; then each task keeps its k smallest of a group, and only those meet. So no task
    gathers a group, however large.
    """
    each = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    found = each.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("_sketch"))
    every = df.select(*(F.col(c).alias(f"_of_{c}") for c in keys)).distinct()
    on = [every[f"_of_{c}"].eqNullSafe(found[c]) for c in keys]
    return every.join(found, on, "left").select(*(F.col(f"_of_{c}").alias(c) for c in keys), F.coalesce("_sketch", F.expr(NONE)).alias(sketch))


def _common(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """Hashes of the union's sketch that both have, and the size of that sketch."""
    union = merged(a, b, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))), F.size(union)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that are in both."""
    both, of = _common(a, b, k)
    return F.when(of == 0, F.lit(1.0)).otherwise(both / of)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, then from how densely the k smallest lie."""
    top = F.get(sketch, F.lit(k - 1)).cast("double") + F.lit(2.0**63)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(2.0**64) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    inside = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.least(inside, F.lit(1.0)))


def text_of(sketch: Column) -> Column:
    """A sketch as a string: its hashes in order."""
    return F.array_join(sketch.cast("array<string>"), ",")


def neighbours(docs: DataFrame, key: str, text: str, bytes_: int = BUCKET_BYTES) -> tuple[DataFrame, Window]:
    """All rows in the struct ``row``, with ``next``, the text of the next row by descending key (the first row's after the last), and the window they are sorted by.

    The bounds (one number a bucket) and the first key of each bucket pass through the driver, ``BUCKETS`` at most. A further column can be
    led over the same window without another shuffle; rows with ``ghost`` only close their bucket and have to go after that.
    """
    spark = docs.sparkSession
    # null keys lie below all others
    place = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    want = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bytes_))
    cut = docs.agg(F.percentile_approx(place, [i / want for i in range(1, want)], 100 * want).alias("x")).first().x if want > 1 else None
    bounds = sorted(set(cut or []))
    edge = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one constant
    steps = len(bounds).bit_length()
    found = F.aggregate(
        F.array(*(F.lit(1 << s) for s in reversed(range(steps)))), F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(edge, at + step - 1) <= F.col("place")), at + step).otherwise(at),
    ) if steps else F.lit(0)
    rows = docs.select(F.struct("*").alias("row"), place.alias("place"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    rows = rows.select("row", "place", "hash", (F.lit(len(bounds)) - found).alias("bucket"))
    order = F.struct(-F.col("place").cast("decimal(20,0)"), F.col("hash"))
    first = rows.groupBy("bucket").agg(F.min(order).alias("x")).select("bucket", "x.*").orderBy("bucket").collect()  # one row a bucket
    if not first:
        return rows.select("row", F.lit("").alias("next"), "bucket", "place", "hash", F.lit(False).alias("ghost")), Window.partitionBy("bucket").orderBy("ghost")
    heads = [(first[i - 1][0], int(-first[i][1]), first[i][2]) for i in range(len(first))]
    heads = F.broadcast(spark.createDataFrame(heads, "before int, place bigint, hash bigint"))
    closing = rows.drop("bucket").join(heads, ["place", "hash"]).dropDuplicates(["place", "hash"]).select("row", "place", "hash", F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(False)).select("row", "place", "hash", "bucket", "ghost").unionByName(closing.select("row", "place", "hash", "bucket", "ghost"))
    window = Window.partitionBy("bucket").orderBy("ghost", F.desc("place"), "hash")
    return both.withColumn("next", F.lead(F.coalesce(F.col(f"row.`{text}`"), F.lit(""))).over(window)), window
