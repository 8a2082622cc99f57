"""SpotSigs: a text's fingerprint is the set of its spot signatures.

A spot is a common word; its signature is the chain of the next content words. Common words are spread
over prose and rare in lists and menus, so the set follows the running text. DataFrame functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Common words of English, German, French and Spanish.
COMMON = (
    "the of and to a in is that it on for was be with as this by at are from "
    "der die und den von zu das ist ein eine im mit sich für auf des dem nicht "
    "de la le et les un une en que qui pour dans du est par sur avec "
    "el los las y se por su con del al lo como"
).split()
#: Content words in a chain, and the words after an anchor in which they are looked for.
CHAIN, REACH = 3, 8


def signatures(text: Column, common=COMMON, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The sorted distinct signatures (32 bits) of a text as an array; null is empty.

    A text without a spot has one signature, of all its characters, so equal texts have equal sets and
    no set is empty. Evaluate into a column of its own before using it twice.
    """
    body = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def spots(w: Column) -> Column:
        def chained(x: Column, i: Column) -> Column:
            content = F.filter(F.slice(w, i + 2, reach), lambda y: ~y.isin(common))
            return F.when(x.isin(common), F.hash(x, F.slice(content, 1, chain)))

        return F.array_compact(F.transform(w, chained))

    # The token array is bound once; inside a lambda it would be cut anew for every word.
    found = F.flatten(F.transform(F.array(tokens), spots))
    only = F.array(F.hash(F.coalesce(text, F.lit(""))))
    return F.aggregate(F.array(F.sort_array(F.array_distinct(found))), only, lambda a, s: F.when(F.size(s) > 0, s).otherwise(a))


def text_of(sigs: Column) -> Column:
    """A set of signatures as text: eight hex digits each, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing them if their lengths alone rule out ``least``."""
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(bound < least, F.lit(0.0)).otherwise((both / (F.size(a) + F.size(b) - both)).cast("double"))


def near_duplicates(prints: DataFrame, similarity: float = 0.8, sigs: str = "sigs") -> tuple[DataFrame, DataFrame]:
    """(classes, links) of all sets with a similarity of at least ``similarity``.

    ``classes`` gives each row the class of its set (``class``, an id of the set); ``links`` has pairs of
    classes with their similarity. Sets are partitioned by length so that a link reaches from one
    partition into itself or the next; within those, two similar sets share one of the few smallest
    signatures of either (prefix filter). Copies are one class before any pair is made.
    """
    classes = prints.withColumn("class", F.xxhash64(sigs))
    sets = classes.groupBy("class").agg(F.first(sigs).alias("s")).withColumn("n", F.size("s"))
    base = math.log(1 / similarity)
    sets = sets.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / base + 1e-9))
    prefix = F.slice("s", F.lit(1), (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))
    posts = sets.select("class", "n", "part", F.explode(prefix).alias("sig"))
    right = posts.select(F.col("class").alias("b"), F.col("n").alias("m"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "sig")
    pairs = posts.join(right, ["part", "sig"]).where(
        (F.col("class") != F.col("b")) & (F.col("m") >= F.col("n")) & (F.col("n") >= similarity * F.col("m"))
        & ((F.col("m") > F.col("n")) | (F.col("class") < F.col("b")))
    ).select(F.col("class").alias("a"), "b").distinct()
    one, two = (sets.select(F.col("class").alias(c), F.col("s").alias("s" + c)) for c in "ab")
    links = pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), similarity).alias("similarity"))
    return classes, links.where(F.col("similarity") >= similarity)


def _buckets(docs: DataFrame, id: str, rows: int) -> Column:
    """Numbers that rise with the id, about ``rows`` rows each: ranges of equal mass, cut evenly inside."""
    stats = docs.agg(F.count(id).alias("n"), F.percentile_approx(id, [k / 32 for k in range(33)], 1000).alias("at")).first()
    if not stats["n"]:
        return F.lit(0).cast("long")
    bounds = sorted(set(stats["at"]))
    sub = max(1, math.ceil(stats["n"] / len(bounds) / rows))
    bucket = F.lit(0).cast("long")
    for k, low in enumerate(bounds):
        width = (bounds[k + 1] - low if k + 1 < len(bounds) else 1) / sub
        inside = F.least(F.floor((F.col(id) - low) / width), F.lit(sub - 1))
        bucket = F.when(F.col(id) >= low, k * sub + 1 + inside).otherwise(bucket)
    return F.when(F.col(id).isNull(), F.lit(-1).cast("long")).otherwise(bucket)


def compared(docs: DataFrame, id: str = "doc_id", text: str = "text", rows: int = 4096) -> DataFrame:
    """Every text next to its edited text and to the next document, by descending ``id``.

    The edited text has its last half (rounded down, in code points) replaced by as many first code
    points of the next document, or all it has. Rows of one id go by a hash of their texts; null ids
    come last; after the last row comes the first, so a single row is its own neighbour. Null texts are
    empty; an empty table gives no rows. The id must be a whole number.

    Rows are dealt to buckets of the id; each bucket also gets the first row of the one below, so the
    neighbour is a ``lead`` inside the bucket and no task sorts the whole table.
    """
    body = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = body.withColumn("bucket", _buckets(body, "id", rows)).withColumn("tie", F.xxhash64("text"))
    firsts = materialize(
        body.groupBy("bucket").agg(F.max(F.struct(F.coalesce("id", F.lit(0)).alias("i"), F.col("tie").alias("t"))).alias("top")), "firsts"
    )
    down = Window.orderBy("bucket")
    above = firsts.withColumn("to", F.lead("bucket").over(down)).withColumn("lowest", F.min("bucket").over(Window.partitionBy()))
    above = above.select("bucket", "top", F.coalesce("to", "lowest").alias("to"))
    copies = (
        body.withColumn("top", F.struct(F.coalesce("id", F.lit(0)).alias("i"), F.col("tie").alias("t"))).join(above, ["bucket", "top"])
        .dropDuplicates(["bucket"]).select("id", "text", F.col("to").alias("bucket"), "tie", F.lit(True).alias("extra"))
    )
    every = body.withColumn("extra", F.lit(False)).unionByName(copies).withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("extra", F.col("id").desc_nulls_last(), F.col("tie").desc())
    beside = every.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).where(~F.col("extra"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    out = beside.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return out.select(
        F.col("id").alias(id), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("sigs")).alias("fingerprint"), text_of(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
        F.size("sigs").alias("n_signatures"),
    )
