"""Personal data: exact patterns, and further spans by weak supervision. DataFrame functions alone.

Patterns give the base spans. Other long numbers and mixed tokens are candidates on which five labelers
vote or abstain: two of shape, one of a gazetteer, one of the context, one of the document. The labelers'
reliabilities are estimated by expectation-maximisation over the counts of vote patterns, of which there
are few however many candidates there are. The posteriors then train a naive Bayes classifier on other
features of the span, which decides.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: The base kinds and their patterns. Quantifiers are possessive where nothing that follows
#: could match otherwise, and a match may begin only at the start of a run or where the last one ended,
#: so long runs cost linear time and no stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+"
BASE, ADDED = ("email", "ip", "card", "phone"), ("account", "secret")

#: Words that make a nearby number or token personal, and words that explain it away.
PERSONAL = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "card", "account", "iban", "ssn", "konto", "karte", "compte", "carte", "cuenta", "tarjeta")
HARMLESS = ("isbn", "issn", "doi", "page", "order", "version", "commit", "sha", "http", "www")

Vote = int  # 1 yes, 0 no, 2 abstains
LABELERS = 5


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    total = F.aggregate(
        F.split(F.reverse(number), ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda a, d: F.struct(
            (a["i"] + 1).alias("i"),
            (a["s"] + F.when(a["i"] % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0))).alias("s"),
        ),
        lambda a: a["s"],
    )
    return total % 10 == 0


def matches(text: str, pattern: str, needs: Column) -> Column:
    """[(start, end, match)] of all matches in a column, ends exclusive, in code points.

    Spark gives matches without places, so these are summed up from the lengths of the matches and of what
    lies between. ``needs`` is a cheap test that texts with a match pass.
    """
    # Split and matches are bound together once by zip_with.
    gaps = F.split(F.col(text), pattern, -1)
    both = F.zip_with(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    kind = "array<struct<start:int,end:int,match:string>>"
    placed = F.aggregate(
        F.filter(both, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.length(x["g"])).alias("start"), (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("match")
            ))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(needs, placed).otherwise(F.array().cast(kind))


def _size_between(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add ``email``, ``ip``, ``card`` and ``phone`` (spans that pass), and ``runs`` (all runs of digits)."""
    has = lambda p: F.col(text).rlike(p)
    df = docs.withColumn("email", matches(text, EMAIL, F.contains(F.col(text), F.lit("@"))))
    df = df.withColumn("ip", matches(text, IP, has(r"[0-9]\.[0-9]")))
    df = df.withColumn("runs", matches(text, CARD, has(r"[0-9][\x20-]?[0-9]")))
    df = df.withColumn("phone", matches(text, PHONE, has(r"\+[0-9]")))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    whole = rf"\A{part}\.{part}\.{part}\.{part}\z"
    return (
        df.withColumn("ip", F.filter("ip", lambda s: s["match"].rlike(whole)))
        .withColumn("card", F.filter("runs", lambda s: _size_between(digits(s["match"]), 13, 19) & luhn(digits(s["match"]))))
        .withColumn("phone", F.filter("phone", lambda s: _size_between(digits(s["match"]), 9, 15)))
    )


def _overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def candidates(found: DataFrame, text: str) -> DataFrame:
    """(key, kind, start, end, votes, features): spans that no base span touches, one row for each place in
    each distinct text. ``votes`` has a digit for each labeler, ``features`` what the classifier sees."""
    base = F.concat("email", "ip", "card", "phone")
    numbers = F.transform(F.filter("runs", lambda s: _size_between(digits(s["match"]), 9, 19)), lambda s: F.struct(F.lit("account").alias("kind"), s.alias("s")))
    mixed = F.filter("tokens", lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))
    tokens = F.transform(mixed, lambda s: F.struct(F.lit("secret").alias("kind"), s.alias("s")))
    rows = (
        found.withColumn("tokens", matches(text, TOKEN, F.col(text).rlike(r"[A-Za-z0-9_/+-]{16}") & F.col(text).rlike("[0-9]")))
        .withColumn("base", base).withColumn("all", F.concat(numbers, tokens))
        .withColumn("some", F.filter("all", lambda c: ~_overlaps(c["s"], F.col("base"))))
        .where(F.size("some") > 0)
        .select("key", F.size("base").alias("n_base"), F.explode("some").alias("c"), F.col(text).alias("text"))
    )
    rows = rows.select(
        "key", "n_base", "c.kind", "c.s.start", "c.s.end", "c.s.match",
        F.lower(F.substring("text", F.greatest(F.col("c.s.start") - 23, F.lit(1)), F.least(F.col("c.s.start"), F.lit(24)))).alias("before"),
        F.substring("text", F.col("c.s.end") + 1, F.lit(2)).alias("after"),
    )
    size, number = F.length("match"), F.length(digits(F.col("match")))
    kinds = F.size(F.array_distinct(F.split("match", "")))
    word = lambda names: F.col("before").rlike(r"(?:\A|[^\p{L}])(?:" + "|".join(names) + r")[^\p{L}]")
    secret = F.col("kind") == "secret"
    hexed = F.col("match").rlike(r"\A[0-9a-fA-F]+\z") & size.isin(32, 40, 64, 128)
    votes = [
        _vote(F.when(secret, hexed).otherwise(number.between(13, 19)), F.when(secret, number * 8 < size).otherwise(number < 11)),
        _vote(kinds >= F.when(secret, 10).otherwise(5), kinds <= 3),
        _vote(word(PERSONAL), word(HARMLESS)),
        _vote(F.col("before").rlike(r"[=:#]\s*[\"']?\z") | F.col("after").rlike(r"\A[\"']"), F.col("before").rlike(r"[/.,]\z") | F.col("after").rlike(r"\A[/%]")),
        _vote(F.col("n_base") > 0, F.lit(False)),
    ]
    features = F.array(
        F.concat(F.lit("size "), F.least(F.floor(size / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits "), F.floor(number * 5 / size).cast("string")),
        F.concat(F.lit("before "), F.regexp_replace(F.substring("before", -1, 1), r"[\p{L}]", "a")),
        F.concat(F.lit("after "), F.regexp_replace(F.substring("after", 1, 1), r"[\p{L}]", "a")),
        F.concat(F.lit("upper "), F.col("match").rlike("[A-Z]").cast("string")),
        F.concat(F.lit("marks "), F.col("match").rlike("[^A-Za-z0-9]").cast("string")),
    )
    return rows.select(
        "key", "kind", "start", "end", F.concat(*(v.cast("string") for v in votes)).alias("votes"), features.alias("features")
    ).dropDuplicates(["key", "kind", "start", "end"])


def reliabilities(counts: dict[str, int], rounds: int = 30) -> dict[str, float]:
    """The probability that a span with these votes is personal, by expectation-maximisation.

    Given the truth, labelers say yes, no or nothing independently. The first guess is the majority; a
    prior of one count each keeps all probabilities inside (0, 1). At most 3^5 patterns, a few hundred
    numbers, whatever the number of spans.
    """
    post = {v: min(0.9, max(0.1, 0.5 + 0.2 * (v.count("1") - v.count("0")))) for v in counts}
    for _ in range(rounds):
        said = {(k, x, y): 1.0 for k, x, y in product(range(LABELERS), "012", (0, 1))}
        prior = [1.0, 1.0]
        for v, n in counts.items():
            for y, p in ((1, post[v]), (0, 1 - post[v])):
                prior[y] += n * p
                for k, x in enumerate(v):
                    said[k, x, y] += n * p
        total = {(k, y): sum(said[k, x, y] for x in "012") for k in range(LABELERS) for y in (0, 1)}
        for v in counts:
            log = [math.log(prior[y]) + sum(math.log(said[k, x, y] / total[k, y]) for k, x in enumerate(v)) for y in (0, 1)]
            post[v] = 1 / (1 + math.exp(max(-700, min(700, log[0] - log[1]))))
    return post


def classifier(cands: DataFrame) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """(log odds of a kind, log odds of (kind, feature)), trained on the posteriors of the votes.

    Counts by kind, votes and feature are few: features are buckets and classes of characters, of which
    rare ones count as ``other``.
    """
    counted: dict[str, dict[str, int]] = {}
    for r in cands.groupBy("kind", "votes").count().collect():
        counted.setdefault(r["kind"], {})[r["votes"]] = r["count"]
    post = {(kind, v): p for kind, counts in counted.items() for v, p in reliabilities(counts).items()}
    mass = {kind: [1.0, 1.0] for kind in counted}
    for (kind, v), p in post.items():
        mass[kind][0] += counted[kind][v] * (1 - p)
        mass[kind][1] += counted[kind][v] * p
    seen: dict[tuple[str, str], list[float]] = {}
    for r in cands.select("kind", "votes", F.explode("features").alias("f")).groupBy("kind", "votes", "f").count().collect():
        w = seen.setdefault((r["kind"], r["f"]), [0.5, 0.5])
        p = post[r["kind"], r["votes"]]
        w[0] += r["count"] * (1 - p)
        w[1] += r["count"] * p
    odds = {kind: math.log(yes / no) for kind, (no, yes) in mass.items()}
    return odds, {(k, f): math.log(yes / mass[k][1]) - math.log(no / mass[k][0]) for (k, f), (no, yes) in seen.items()}


def accepted(cands: DataFrame) -> DataFrame:
    """(key, added): spans that the trained classifier takes, for each text that has any."""
    odds, weights = classifier(cands)
    if not odds:
        return cands.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    table = F.create_map(*(F.lit(x) for (k, f), w in sorted(weights.items()) for x in (f"{k} {f}", w)))
    start = F.create_map(*(F.lit(x) for item in sorted(odds.items()) for x in item))
    logit = F.aggregate(
        F.transform("features", lambda f: F.element_at("__table", F.concat_ws(" ", "kind", f))), F.element_at(start, F.col("kind")),
        lambda a, w: a + F.coalesce(w, F.lit(0.0)),
    )
    taken = cands.withColumn("__table", table).where(logit > 0)
    return taken.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))


def _key(text: str) -> Column:
    return F.struct(F.xxhash64(text), F.length(text)).cast("string")


def spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, email, ip, card, phone, added) for every row; spans are (start, end), added ones (kind, start, end).

    Patterns run over the texts once; the slim result is stored, and what was learned is joined to it by
    a key of the text, so copies are judged once and alike.
    """
    body = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", _key("text"))
    found = base_spans(body, "text")
    cands = materialize(candidates(found.select("key", "text", *BASE, "runs"), "text"), "candidates")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(c)
    return found.select(id, "key", *(bare(k) for k in BASE)).join(accepted(cands), "key", "left")


def _joined(kind: str, of: Column) -> Column:
    return F.transform(of, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_sha256`` and ``spans`` of every row.

    A null text counts as empty and has no span; repeated rows stay repeated; an empty table gives no rows.
    Added kinds (account, secret) follow the base kinds in ``spans``, by kind and start.
    """
    base = F.concat(*(_joined(k, F.col(k)) for k in BASE))
    added = F.transform(F.sort_array(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return spans(docs, id, text).select(
        id, *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"),
    )


def masked(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, like ``[EMAIL]``; spans that overlap become one, named
    after the first. Null texts stay null; other columns stay as they are."""
    kind = "array<struct<start:int,end:int,kind:string>>"
    named = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    body = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("key", _key("__text")) if "key" not in docs.columns else None
    if body is None:
        return masked(docs.withColumnRenamed("key", "__own_key"), id, text).withColumnRenamed("__own_key", "key").select(*docs.columns)
    clash = [c for c in (*BASE, "runs", "added") if c in docs.columns]
    if clash:
        plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
        return masked(plain, id, text).withColumnsRenamed({f"__own_{c}": c for c in clash}).select(*docs.columns)
    found = base_spans(body, "__text")
    cands = materialize(candidates(found.select("key", "__text", *BASE, "runs"), "__text"), "candidates")
    rows = found.join(accepted(cands), "key", "left")
    more = F.transform(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = rows.withColumn("__spans", F.sort_array(F.concat(*(named(k).cast(kind) for k in BASE), more.cast(kind))))
    pieces = F.aggregate(
        "__spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(
                F.concat(a["out"], F.array(F.substring("__text", a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
            ).alias("out"),
        ),
    )
    rows = rows.withColumn("__pieces", F.when(F.size("__spans") > 0, pieces))
    whole = F.concat(F.array_join("__pieces.out", ""), F.substring("__text", F.col("__pieces.at") + 1, F.length("__text")))
    return rows.withColumn(text, F.when(F.size("__spans") > 0, whole).otherwise(F.col(text))).select(*docs.columns)
