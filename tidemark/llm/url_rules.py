"""URL filters with aliases: a blocked page blocks what redirects to it or names it as canonical.

Rules decide first. Pages that no rule fits take the decision of their alias group: the connected
component over redirects and canonical links between pages. A group with an allowed page stays allowed,
whatever else is in it; else a blocked page blocks it; else it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, materialize
from tidemark.llm.components import connected_components

#: Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of an absolute URL; both empty for null or a text without ``://``."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the host or a parent domain and whose path starts the path.

    Rules are data of the caller's configuration, a handful; they become one expression."""
    rule = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(rule)
    return rule


def without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved; others stay as they are."""
    segments = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.array_join(segments, "/")).otherwise(path)


def decoded(text: Column) -> Column:
    """The text with its character references read once: numbers, and the five names of markup."""
    names = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(x: Column) -> Column:
        digits, hexes = F.regexp_extract(x, r"\A&#([0-9]{1,7});\z", 1), F.regexp_extract(x, r"\A&#[xX]([0-9a-fA-F]{1,6});\z", 1)
        code = F.when(digits != "", digits.try_cast("int")).when(hexes != "", F.conv(hexes, 16, 10).try_cast("int"))
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        out = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)
        for name, value in names.items():
            out = F.when(x == name, value).otherwise(out)
        return out

    pieces = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def resolved(to: Column, base: Column) -> Column:
    """The address that ``to`` means on a page or base with the absolute address ``base``."""
    scheme = F.regexp_extract(base, r"(?s)\A([^:/?#]+:)//", 1)
    origin = F.regexp_extract(base, r"(?s)\A([^:/?#]+://[^/?#]*)", 1)
    plain = F.regexp_extract(base, r"(?s)\A([^?#]*)", 1)
    folder = F.regexp_extract(plain, r"(?s)\A([^:/?#]+://[^/]*(?:/.*)?)/[^/]*\z", 1)
    return (
        F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(origin == "", F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("?"), F.concat(plain, to))
        .when((to == "") | to.startswith("#"), base)
        .otherwise(F.concat(F.when(plain == origin, origin).otherwise(folder), F.lit("/"), to))
    )


def node(url: Column) -> Column:
    """What two spellings of an address share: host, path without a closing slash, and the query without
    tracking parameters. Null if there is no host."""
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    query = F.array_join(
        F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"\A(utm_[a-z]*|ref|fbclid|gclid)=?"))), "&"
    )
    short = F.regexp_replace(without_dots(path), r"/+\z", "")
    return F.when(host != "", F.concat_ws("?", F.concat(host, short), F.when(query != "", query)))


def alias_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b) between addresses: canonical links and refresh redirects that a page's head declares. Targets are
    relative to the page's address, or to its base."""
    attribute = r"""\s*=\s*["']?([^"'\s>]+)"""
    links = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), F.lit(0))
    metas = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), F.lit(0))
    aimed = F.concat(
        F.transform(links, lambda x: F.regexp_extract(x, r"(?is)\bhref" + attribute, 1)),
        F.transform(metas, lambda x: F.regexp_extract(x, r"(?is)\burl" + attribute, 1)),
    )
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref" + attribute, 1)
    pairs = pages.where(F.lower(F.substring(html, 1, 1 << 30)).rlike("canonical|refresh")).select(
        node(F.col(url)).alias("a"), F.col(url).alias("url"), base.alias("base"), F.explode(aimed).alias("to")
    ).where("to <> ''")
    # Bound step by step: one expression would hold thousands of copies of its parts.
    for c in ("base", "to"):
        pairs = pairs.withColumn(c, F.transform(F.array(c), decoded)[0])
    for c, at in (("base", "url"), ("to", "base")):
        pairs = pairs.withColumn(c, F.transform(F.array(F.struct(F.col(c).alias("to"), F.col(at).alias("at"))), lambda x: resolved(x["to"], x["at"]))[0])
    pairs = pairs.withColumn("b", F.transform(F.array("to"), node)[0])
    return pairs.select("a", "b").where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, group) for every row.

    A null URL or html has no host, rule or links and is allowed; equal addresses are one node; a page
    that redirects to itself links nothing; an empty table gives no rows; repeated rows stay repeated.
    """
    host, path = url_parts(F.col(url))
    slim = pages.select(F.col(id), host.alias("host"), path.alias("path"), node(F.col(url)).alias("node"))
    slim = slim.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    roots = connected_components(alias_links(pages, url, html))
    fits = materialize(slim.join(roots, "node", "left").select(
        id, "host", "path", "fit", F.coalesce("root", "node").alias("group")
    ), "fits")
    said = fits.where("fit is not null and group is not null").groupBy("group").agg(
        F.min("fit.verdict").alias("said")  # allow sorts before block, so it goes first
    )
    return fits.join(said, "group", "left").select(
        id, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "said", F.lit("allow")).alias("verdict"), "group",
    )
