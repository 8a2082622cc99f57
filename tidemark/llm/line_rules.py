"""Quality rules: counts over whole texts, and lines that many documents of a host share.

DataFrame functions alone. A line is normalised (case, digits, white space around it), hashed together with its
host, and counted over distinct texts of the host. Lines over the limit are removed from every document
but the first that has them, so one copy of a passage stays; documents that lose most of their text go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, materialize, words

WINDOW = 8
MIN_WORDS = 20
#: A line is removed if it is in more distinct documents of its host than this, however many it has.
LINE_DOCS = 10
#: A document is depleted if over this share of its characters is in removed lines.
DEPLETED = 0.5


def text_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal(text: Column) -> Column:
    """Lower case, every digit 0, no white space around; for a line, or before a text is split into lines."""
    return F.btrim(F.regexp_replace(F.lower(text), "[0-9]", "0"), F.lit(WHITE))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Windows are compared by hashes. Two equal windows of eight words begin with two equal windows of
    four, so texts without such a pair, nearly all, need one pass and one hash set. For the others the
    hashes of eight are sorted with their places, and the words under those found twice or more are
    summed in one pass.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def repeats(name: str) -> Column:
        return F.size(F.array_distinct(name)) < F.size(name)

    df = docs.withColumn("__w", words(F.col(text))).withColumn("n_words", F.size("__w").cast("long"))
    four = F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2), F.get("__w", i + 3)))
    windows = (F.col("n_words") - WINDOW + 1).cast("int")
    df = df.withColumn("__h4", F.when(F.col("n_words") > WINDOW, F.slice(four, F.lit(1), windows + 4)))
    df = df.withColumn(
        "__h8",
        F.when(repeats("__h4"), F.slice(F.zip_with("__h4", F.slice("__h4", F.lit(5), windows), lambda a, b: F.xxhash64(a, b)), F.lit(1), windows)),
    )
    df = df.withColumn(
        "__sorted",
        F.when(repeats("__h8"), F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    s = F.col("__sorted")
    twice = F.filter(
        s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])
    )
    df = df.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(WINDOW))).alias("n")),
        lambda a: a["n"],
    )
    lines = text_lines(F.col(text))
    return df.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def text_key(host: str, text: str) -> Column:
    """One value for all copies of a text on a host."""
    return F.xxhash64(F.coalesce(F.col(host), F.lit("")), F.col(host).isNull(), F.col(text))


def shared_lines(
    docs: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text",
    line_docs: int = LINE_DOCS,
) -> DataFrame:
    """(text_key, line, chars): lines over the limit, for each text that loses them, with their length there.

    Copies of a text count once. Counts are summed before each shuffle; a line that a third of all
    documents share is split by adaptive joins.
    """
    line = F.transform(F.split(normal(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    lines = docs.select(
        F.xxhash64(F.coalesce(F.col(host), F.lit("")), F.col(host).isNull()).alias("host"),
        text_key(host, text).alias("text_key"), F.col(id).alias("id"), F.filter(line, lambda x: x != "").alias("lines"),
    ).select("host", "text_key", "id", F.posexplode("lines").alias("pos", "line")).select(
        "host", "text_key", "id", "pos", F.xxhash64("line").alias("line"), F.length("line").alias("chars"),
    )
    once = lines.groupBy("host", "text_key", "line", "pos").agg(
        F.first("chars").alias("chars"), F.min("id").alias("id")
    )
    found = once.groupBy("host", "line", "text_key").agg(F.sum("chars").alias("chars"), F.min("id").alias("id"))
    found = materialize(found, "lines")
    counted = found.groupBy("host", "line").agg(
        F.count("*").alias("docs"), F.min(F.struct("id", "text_key"))["text_key"].alias("first")
    ).where(F.col("docs") > line_docs)
    return found.join(counted.select("host", "line", "first"), ["host", "line"]).where("text_key <> first").select("text_key", "line", "chars")


def judge(docs: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text", depleted: float = DEPLETED) -> DataFrame:
    """Counts, ``base_failed``, ``n_removed_chars`` and ``kept`` for every row.

    A null text counts as empty and fails; null hosts are one host; an empty table gives no rows;
    repeated rows are judged alike.
    """
    lost = shared_lines(docs, id, host, text).groupBy("text_key").agg(F.sum("chars").alias("n_removed_chars"))
    rows = measured(docs.select(F.col(id), F.col(text), text_key(host, text).alias("text_key")), text).withColumn("__size", F.length(text))
    failed = base_failed()
    removed = F.coalesce("n_removed_chars", F.lit(0)).cast("long")
    return rows.drop(text).join(lost, "text_key", "left").select(
        id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (removed <= depleted * F.col("__size"))).alias("kept"), removed.alias("n_removed_chars"),
    )


def cleaned(docs: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text", depleted: float = DEPLETED) -> DataFrame:
    """The documents that pass, without the removed lines; the columns of ``docs`` stay as they are."""
    lost = shared_lines(docs, id, host, text).groupBy("text_key").agg(
        F.sum("chars").alias("__lost"), F.collect_set("line").alias("__lines")
    )
    # Stored, as a filter on the counts would otherwise be pushed below them and count anew for every word.
    counts = materialize(
        measured(docs.select(F.col(text), text_key(host, text).alias("text_key")), text)
        .select("text_key", "n_words", "n_repeat_words", F.length(text).alias("__size")), "counts",
    )
    passed = counts.where(~base_failed()).dropDuplicates(["text_key"]).join(lost, "text_key", "left").where(
        F.coalesce("__lost", F.lit(0)) <= depleted * F.col("__size")
    ).select(F.col("text_key").alias("__key"), "__lines")
    rows = docs.withColumn("__key", text_key(host, text)).join(passed, "__key")
    without = F.array_join(
        F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("__lines", F.xxhash64(normal(x)))), "\n"
    )
    return rows.withColumn(text, F.when(F.col("__lines").isNull(), F.col(text)).otherwise(without)).select(*docs.columns)
