"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

Terms are the words of a text, weighted by how often they occur. For every term and every sample a hash gives
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln(weight) / r + b) the sample's value is
c exp(-r (t - b + 1)), and the term with the least value is drawn. The value is a function of (term, t), so two texts draw the
same (term, t) exactly when their least values are equal, and that happens with the probability of their generalised
Jaccard similarity: sum of the lesser weights / sum of the greater. A fingerprint is SAMPLES least values, hashed to 16
bits each; the likeness of two fingerprints is the share of equal places.

r and b come from two uniforms u and v: -ln(u) and -ln(v) are exponential, their sum r is Gamma(2, 1), and b = -ln(v) / r is
uniform and independent of r. Then r (1 - b) = -ln(u), so the value is c u exp(-r t): for weight 1, where t is 0, the most
common case, one logarithm (that of c) is all there is to compute. No two samples of a term share a number.

The least value of a text of n words is above FAR / n with a probability of exp(-FAR). A value whose lower bound, which needs
no logarithm, lies above that is not computed. Where a text has no value as low as that, its rows are drawn again in full;
so every value is the least one, whatever FAR is.

Results for odd input: a null or empty text has a fingerprint of its own that equals only that of other texts without
words; equal texts have equal fingerprints; the next document is the one of the next larger doc_id (of rows that share it,
the one of the smallest text); the last one's next is the first; a row without doc_id has no next document: nothing is
put in place of what is cut off, and near_next is null. An empty table gives an empty table. Extra columns do not enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortpref.llm.common import pieces, text_bytes, word_array
from cohortpref.session import snapshot

# Samples are drawn in groups, as many columns at a time: so few that the method Spark generates for them stays below the
# size up to which the JVM compiles it. The standard error of a likeness is sqrt(s (1 - s) / SAMPLES): 0.044 at similarity
# 0.5, 0.035 at 0.8.
GROUP_SAMPLES = 16
GROUPS = 8
SAMPLES = GROUP_SAMPLES * GROUPS
SEED = 77
FAR = 28.0
RANGE_IDS = 200_000
PARTITION_BYTES = 5 << 20


def _uniform(h: str, low: int, places: int) -> str:
    """SQL for a number in (0, 1) from some bits of `h`."""
    return f"(((shiftrightunsigned({h}, {low}) & {(1 << places) - 1}) + 0.5D) * {2.0**-places!r}D)"


def _sample(number: int) -> Column:
    """Value of sample `number` from its hash, `weight` and its logarithm; infinite where a lower bound of it lies above `far`.
    The least values of a long text lie at small u, so u has the most bits."""
    h = f"h{number}"
    u, v = _uniform(h, 0, 24), _uniform(h, 24, 12)
    product = f"({_uniform(h, 36, 14)} * {_uniform(h, 50, 14)})"
    # Minus the logarithm of a product of two uniforms is Gamma(2, 1).
    c = f"(-ln({product}))"
    t = f"floor((ln({v}) - log_weight) / ln({u} * {v}))"
    # t is 0 where u w < 1, for weight 1 always. The margin is for rounding: what is close is left to the logarithms.
    none = f"{u} * weight < 0.999999D"
    value = f"{c} * {u} * if({none}, 1.0D, exp({t} * ln({u} * {v})))"
    # -ln(p) >= 2 (1 - p) / (1 + p), and exp(-r t) >= v / w. Both bounds are short, for the sake of the method that Spark generates.
    low, most = f"1.999998D * (1.0D - {product}) * {u}", f"far * (1.0D + {product})"
    return F.expr(f"if({low} > {most} and {none} or {low} * {v} > {most} * weight, double('Infinity'), {value})")


def _weighted_terms(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """`keys`, least (words of the shorter text that has any), term, weight, member of the distinct words of two texts:
    member 0 for a word that both have equally often, else 1 or 2 for the text that has it so often; one row of member 3
    and nulls where neither text has words."""
    # The lowest bit of a hash tells the text, so that one sort brings the runs of a word in both texts together.
    tagged = lambda text, bit: F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)) + F.lit(bit))
    hashed = rows.select(*keys, tagged(first, 0).alias("first_tags"), tagged(second, 1).alias("second_tags"))
    sizes = [F.when(F.size(c) > 0, F.size(c)) for c in ("first_tags", "second_tags")]
    hashed = hashed.select(*keys, F.least(*sizes).alias("least"), F.sort_array(F.concat("first_tags", "second_tags")).alias("terms"))
    keys = [*keys, "least"]
    # Where the runs of equal hashes begin, and the end of the last one.
    places = F.sequence(F.lit(0), F.size("terms"))
    begins = F.filter(places, lambda i: (i == 0) | (i == F.size("terms")) | (F.get("terms", i) != F.get("terms", i - 1)))
    some = F.size("terms") > 0
    runs = hashed.withColumn("begins", F.when(some, begins))
    runs = runs.select(*keys, "terms", "begins", F.explode_outer(F.when(some, F.sequence(F.lit(0), F.size("begins") - 2))).alias("run"))

    def weight(run: Column) -> Column:
        return F.get("begins", run + 1) - F.get("begins", run)

    def tag(run: Column) -> Column:
        return F.get("terms", F.get("begins", run))

    run = F.col("run")
    own = tag(run)
    second_text = own.bitwiseAND(F.lit(1)) == 1
    # The other text's run of the same word, if it has one, is the next run or the one before.
    equal_after = (tag(run + 1) == own + 1) & (weight(run + 1) == weight(run))
    equal_before = (tag(run - 1) == own - 1) & (weight(run - 1) == weight(run))
    member = F.when(second_text, F.when(equal_before, F.lit(None)).otherwise(2)).when(equal_after, 0).otherwise(1)
    runs = runs.select(*keys, own.bitwiseAND(F.lit(-2)).alias("term"), weight(run).alias("weight"), F.when(own.isNull(), 3).otherwise(member).alias("member"))
    return runs.where(F.col("member").isNotNull())


def draw(rows: DataFrame, keys: list[str], first: str, second: str, far: float = float("inf"), numbers: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, `numbers`, `first_fingerprint` and `second_fingerprint` of every row; null for a text that has a sample without a
    value up to `far` / words. What two texts share is drawn once. The keys must tell rows apart, and are looked up for every
    term: other columns of the rows are carried cheaper as `numbers`. Where `rows` is dealt by one of the keys nothing is
    shuffled, and a task holds the least values of its rows."""
    terms = _weighted_terms(rows, [*keys, *numbers], first, second)
    # The hashes are columns of their own, so that each is computed once and the expressions stay small. The groups are rows.
    places = range(GROUP_SAMPLES)
    terms = terms.select(*keys, *numbers, "least", "member", "term", "weight", F.explode(F.array(*[F.lit(g) for g in range(GROUPS)])).alias("group"))
    seed = F.lit(SEED) + F.col("group") * F.lit(GROUP_SAMPLES)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    measured = terms.select(
        *keys, *numbers, "group", "member", weight.alias("weight"), F.log(weight).alias("log_weight"), (F.lit(far) / F.col("least")).alias("far"),
        *[F.xxhash64("term", seed + F.lit(j)).alias(f"h{j}") for j in places],
    )
    numbers = [*numbers, "far"]
    carried = [F.min(c).alias(c) for c in numbers]
    least = measured.groupBy(*keys, "group", "member").agg(*carried, *[F.min(_sample(j)).alias(f"m{j}") for j in places])
    of = lambda j, members: F.min(F.when(F.col("member").isin(*members), F.col(f"m{j}")))
    least = least.groupBy(*keys, "group").agg(*carried, *[of(j, (0, 1)).alias(f"a{j}") for j in places], *[of(j, (0, 2)).alias(f"b{j}") for j in places])

    # Arrays from here on: for as many columns Spark generates methods close to the size up to which the JVM compiles them.
    values = lambda version: F.array(*[f"{version}{j}" for j in places]).alias(version)
    groups = F.sort_array(F.collect_list(F.struct("group", values("a"), values("b")))).alias("groups")
    drawn = least.groupBy(*keys).agg(*carried, groups)

    def whole(version: str) -> Column:
        # A text without words has no values, and no `far`. Above `far` a value that was left out may be less.
        every = F.flatten(F.col(f"groups.{version}"))
        cell = lambda value: F.lpad(F.hex(F.xxhash64(F.coalesce(value, F.lit(float("inf")))).bitwiseAND(F.lit(0xFFFF))), 4, "0")
        return F.when(~F.coalesce(F.array_max(every) > F.col("far"), F.lit(False)), F.concat_ws("", F.transform(every, cell)))

    return drawn.select(*keys, *numbers[:-1], whole("a").alias("first_fingerprint"), whole("b").alias("second_fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places of two fingerprints, given as bytes: there a place is found without counting characters."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda j: F.substr(a, 2 * j + 1, F.lit(2)) == F.substr(b, 2 * j + 1, F.lit(2)))
    return F.size(same) / float(SAMPLES)


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, quarter (of the longest text with that id), next_id: every id once. Ids are dealt by ranges; inside a range
    a window gives the next one, the last of a range takes the first of the next range."""
    quarter = F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 4).cast("int")
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(quarter).alias("quarter"))
    ids = snapshot(ids, "ids")
    parts = pieces(ids.count(), RANGE_IDS)
    ranged = snapshot(ids.repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first"))
    # One row per range of RANGE_IDS ids.
    in_order = Window.orderBy("range")
    every = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("first").over(in_order), F.min("first").over(every))
    firsts = firsts.select(F.col("range").alias("r"), after.alias("after"))
    following = F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id"))
    ordered = ranged.withColumn("following", following).join(firsts, F.col("range") == F.col("r"))
    return ordered.select("doc_id", "quarter", F.coalesce("following", "after").alias("next_id"))


def _both_versions(joined: DataFrame, far: float) -> DataFrame:
    """Fingerprints of the text and of the edited text, from doc_id, next_id, text and head; `far` as in `draw`."""
    text = F.coalesce("text", F.lit(""))
    joined = joined.select("doc_id", "next_id", text.alias("text"), F.coalesce("head", F.lit("")).alias("head"), F.char_length(text).cast("long").alias("n_chars"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("head", F.lit(1), cut))
    rows = joined.select("doc_id", "next_id", "n_chars", "text", edited.alias("edited"), F.monotonically_increasing_id().alias("row"))
    # The digest as four numbers.
    digest = [f"sha{k}" for k in range(4)]
    rows = rows.withColumn("sha", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = rows.select("*", *[F.conv(F.substr("sha", F.lit(16 * k + 1), F.lit(16)), 16, -10).cast("long").alias(c) for k, c in enumerate(digest)])
    drawn = draw(rows, ["doc_id", "row"], "text", "edited", far, ("next_id", "n_chars", *digest))
    # As bytes, half as long, in all that is written and shuffled from here on.
    return drawn.select(
        "doc_id", "next_id", "n_chars", F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in digest])).alias("sha"),
        F.unhex("first_fingerprint").alias("fingerprint"), F.unhex("second_fingerprint").alias("edited_fingerprint"),
    )


def _all_drawn(joined: DataFrame) -> DataFrame:
    """`_both_versions` of every row, written. Where one of a doc_id lacks a value up to FAR, the rows of that doc_id are drawn
    again without a bound."""
    drawn = snapshot(_both_versions(joined, FAR), "drawn")
    short = drawn.where(F.col("fingerprint").isNull() | F.col("edited_fingerprint").isNull()).select(F.col("doc_id").alias("short")).distinct()
    if short.isEmpty():
        return drawn
    same = F.col("doc_id").eqNullSafe(F.col("short"))
    again = _both_versions(joined.join(short, same, "left_semi"), float("inf"))
    return drawn.join(short, same, "left_anti").unionByName(snapshot(again, "drawn-again"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row. The edited
    text is the text with its last floor(n_chars / 4) code points replaced by as many (or all) of the next document."""
    docs = docs.select("doc_id", "text")
    order = snapshot(successors(docs), "order")
    # Small partitions, and rows with an id apart from those without, so that one shuffle of the texts serves both joins.
    # No fewer than Spark's own shuffles have: a join raises smaller numbers to that one, and would deal the texts anew.
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces(text_bytes(docs), PARTITION_BYTES, least)
    known = docs.where(F.col("doc_id").isNotNull()).repartition(parts, "doc_id")
    lost = docs.where(F.col("doc_id").isNull())
    # Both partners come in as many partitions as the texts: otherwise each join would deal the texts anew.
    wanted = order.select(F.col("next_id"), F.col("doc_id").alias("before"), "quarter").repartition(parts, "next_id")
    heads = known.join(wanted, F.col("doc_id") == F.col("next_id")).select(
        "before", "next_id", F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.col("quarter")).alias("head")
    )
    heads = heads.repartition(parts, "before").groupBy("before").agg(F.min("head").alias("head"), F.min("next_id").alias("next_id"))
    joined = known.join(heads, F.col("doc_id") == F.col("before"), "left").select("doc_id", "next_id", "text", "head")
    pairs = _all_drawn(joined)
    if not lost.isEmpty():
        without = lost.select("doc_id", F.col("doc_id").alias("next_id"), "text", F.lit("").alias("head"))
        pairs = pairs.unionByName(_all_drawn(without.repartition(parts)))
    following = pairs.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("n_chars", "fingerprint"))["fingerprint"].alias("next_fingerprint"))
    out = pairs.join(following, F.col("next_id") == F.col("id"), "left")
    # Before the fingerprints become hex: beside an alias `fingerprint`, the lambda would take that one for the column.
    near = out.select(
        "doc_id", "n_chars", "sha", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.when(F.col("next_fingerprint").isNotNull(), likeness(F.col("fingerprint"), F.col("next_fingerprint"))).alias("near_next"),
    )
    digest = F.lower(F.hex("sha")).alias("edited_sha256")
    prints = [F.hex(c).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return near.select("doc_id", "n_chars", digest, *prints, "near_edited", "near_next")
