"""URL filters in DataFrame functions only: host and path rules, then a blocked Bloom filter before an exact join.

The Bloom filter of listed canonical URLs is a table of 64-bit blocks; a URL's hash picks its block and four bits in
it. Pages whose bits are all set may be listed and are looked up in the list by an exact hash join, which removes false
positives; the others aren't sent there. The filter is broadcast up to a size of its own, for which a list may have millions of URLs.
The list is written once.

Nulls and edges: a null url or one without ``://`` has an empty host and path, fits no rule and is never listed;
repeated rows give repeated results; of rules that fit, the longest wins, and of equal ones the last given; long urls count
whole; an empty list blocks nothing; further columns come along whatever their names, except host, path, rule and
verdict, which are the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.shared import written

#: A list of up to so many URLs of so many bytes is broadcast; beyond it pages that the filter lets pass are joined by shuffles.
BROADCAST_URLS = 200_000
BROADCAST_BYTES = 32 << 20
#: The filter is broadcast by a size of its own, at BLOCK_BYTES for each block of four URLs.
BLOCK_BYTES = 16
#: Bits of the filter for each listed URL.
BITS_PER_URL = 16
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without trailing slashes, and the other query parameters in order. Null stays null."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parameters = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), "/+$", ""), tail))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (``host/path``) and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def _bits(url: Column) -> Column:
    """Four bits of 64 from a second hash."""
    h = F.xxhash64(url, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def filter_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of the column ``canonical``: block, bits."""
    return listed.groupBy(_block(F.col("canonical"), n_blocks).alias("block")).agg(F.bit_or(_bits(F.col("canonical"))).alias("bits"))


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url_column: str = "url", list_column: str = "url", broadcast_urls: int = BROADCAST_URLS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add host, path, rule and verdict (allow or block): the longest fitting rule's, else block for listed URLs."""
    listed = written(listed.select(canonical_url(F.col(list_column)).alias("canonical")).where("canonical is not null").distinct(), "listed")
    n_listed, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical")), F.lit(0))).first()
    n_blocks = max(1, -(-n_listed * BITS_PER_URL // 64))
    as_it_is = lambda df: df
    small = F.broadcast if n_listed <= broadcast_urls and size <= broadcast_bytes else as_it_is
    light = F.broadcast if n_blocks * BLOCK_BYTES <= broadcast_bytes else as_it_is
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url, canonical, block, mask = F.col(url_column), F.col("canonical"), F.col("block"), _bits(F.col("canonical"))
    # the page's own columns are one field, so none of theirs and ours can clash
    judged = pages.select(F.struct(*[F.col(c) for c in kept]).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    # a page that needs no look-up has a block of its own, which no row of the filter has
    needless = verdict.isNotNull() | canonical.isNull()
    own = F.pmod(F.xxhash64(*[F.col("page")[c] for c, kind in pages.select(*kept).dtypes if "map<" not in kind]), F.lit(1 << 31))
    judged = judged.withColumns({"rule": rule, "verdict": verdict, "block": F.when(needless, -1 - own).otherwise(_block(canonical, n_blocks))})
    possible = F.coalesce((block >= 0) & (F.col("bits").bitwiseAND(mask) == mask), F.lit(False))
    probed = judged.join(light(filter_blocks(listed, n_blocks)), "block", "left").withColumn("possible", possible)
    known = listed.select("canonical", F.lit(True).alias("found"))
    if small is not as_it_is:
        looked_up = probed.join(F.broadcast(known), F.col("possible") & (probed["canonical"] == known["canonical"]), "left")
    else:
        # only pages that may be listed are sent
        sent = probed.where("possible").join(known, "canonical", "left")
        looked_up = sent.unionByName(probed.where("not possible").withColumn("found", F.lit(None).cast("boolean")))
    says = F.coalesce("verdict", F.when(F.col("found"), "block").otherwise("allow"))
    return looked_up.select(*[F.col("page")[c].alias(c) for c in kept], "host", "path", "rule", says.alias("verdict"))
