"""Which hosts are public, and where addresses lead: ranges of numbers as joined data, redirects as rounds of joins."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cairn import lexicon as L
from cairn.functions.text import safe_url
from cairn.scratch import Scratch

#: Requests that one address may take, redirects included, and what is read of a response.
MOST_REQUESTS, MOST_BYTES, MOST_CHARS = 5, 65536, 50000
REDIRECTS = (301, 302, 303, 307, 308)
#: Up to so many ranges are sent to all addresses.
FEW_RANGES = 100000


def _bits(number: Column, base: int, size: int) -> Column:
    return F.lpad(F.conv(number, base, 2), size, "0")


def with_bits(rows: DataFrame, address: str) -> DataFrame:
    """``rows`` with family (4 or 6) and bits of a dotted or colon address, null for what is none.

    The bits are a text of 32 or 128 digits.  An IPv4 address inside an IPv6 one
    (``::ffff:a.b.c.d``) counts as IPv4; a zone behind ``%`` does not count.
    """
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    dotted = rf"{octet}\.{octet}\.{octet}\.{octet}"
    step = rows.withColumn("_text", F.lower(F.regexp_replace(address, "%.*$", "")))
    is_four = F.col("_text").rlike(f"^{dotted}$")
    number = lambda k: F.regexp_extract("_text", rf"(?:^|:){dotted}$", k).try_cast("int")
    step = step.withColumn("_n", F.when(is_four | F.col("_text").rlike(rf":{dotted}$"), F.array(*[number(k) for k in (1, 2, 3, 4)])))
    # the last four numbers of a mixed form as two groups
    n = F.col("_n")
    groups = F.concat(F.regexp_replace("_text", rf"{dotted}$", ""), F.lower(F.hex(n[0] * 256 + n[1])), F.lit(":"), F.lower(F.hex(n[2] * 256 + n[3])))
    step = step.withColumn("_halves", F.split(F.when(n.isNotNull() & ~is_four, groups).otherwise(F.col("_text")), "::"))
    none = F.array().cast("array<string>")
    part = lambda k: F.when(F.coalesce(F.get("_halves", F.lit(k)), F.lit("")) == "", none).otherwise(F.split(F.get("_halves", F.lit(k)), ":"))
    step = step.withColumns({"_left": part(0), "_right": part(1)})
    given = F.size("_left") + F.size("_right")
    filled = F.concat("_left", F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), "_right")
    step = step.withColumn("_whole", F.when((F.size("_halves") == 2) & (given <= 7), filled).when((F.size("_halves") == 1) & (given == 8), F.col("_left")))
    sound = F.forall("_whole", lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    step = step.withColumn("_six", F.when(sound, F.array_join(F.transform("_whole", lambda g: _bits(g, 16, 16)), "")))
    mapped = F.col("_six").startswith("0" * 80 + "1" * 16)
    four = F.array_join(F.transform("_n", lambda k: _bits(k.cast("string"), 10, 8)), "")
    family = F.when(is_four | mapped, 4).when(F.col("_six").isNotNull(), 6)
    bits = F.when(is_four, four).when(mapped, F.substring("_six", 97, 32)).otherwise(F.col("_six"))
    return step.withColumns({"family": family, "bits": bits}).drop("_text", "_n", "_halves", "_left", "_right", "_whole", "_six")


def ranges(spark: SparkSession, closed: list[str] = L.CLOSED_RANGES, opened: list[str] = L.OPEN_RANGES) -> DataFrame:
    """(family, size, prefix, closed) of ranges in CIDR notation; a host bit behind the prefix does not count."""
    nets = [(ipaddress.ip_network(r, strict=False), which) for rows, which in ((closed, True), (opened, False)) for r in rows]
    rows = [(n.version, n.prefixlen, f"{int(n.network_address):0{n.max_prefixlen}b}"[: n.prefixlen], which) for n, which in nets]
    return spark.createDataFrame(rows, "family int, size int, prefix string, closed boolean")


def with_public(addresses: DataFrame, known: DataFrame, address: str = "address") -> DataFrame:
    """``addresses`` with ``public``: whether the longest range around each is no closed one; false for what is no address.

    An address meets the ranges by its prefixes of the sizes that ranges have, so any
    number of ranges is one join by key and none is compared with all addresses.  Up to
    ``FEW_RANGES`` go to the addresses, which then stay where they are: many addresses
    share the prefix of a wide range, and would meet in one task.
    """
    spark = addresses.sparkSession
    known = Scratch(spark, "addresses").save(known.select("family", "size", "prefix", F.coalesce("closed", F.lit(False)).alias("closed")).distinct(), "ranges")
    sizes: dict[int, list[int]] = {4: [], 6: []}
    for r in known.select("family", "size").distinct().collect():  # 162 at most
        sizes[r["family"]].append(r["size"])
    if known.count() <= FEW_RANGES:
        known = F.broadcast(known)
    distinct = with_bits(addresses.select(F.col(address).alias("_address")).distinct(), "_address")
    own = F.when(F.col("family") == 4, F.array(*map(F.lit, sizes[4])).cast("array<int>")).when(F.col("family") == 6, F.array(*map(F.lit, sizes[6])).cast("array<int>"))
    tried = distinct.select("_address", "family", "bits", F.explode_outer(own).alias("size")).select("_address", "family", "size", F.expr("substring(bits, 1, size)").alias("prefix"))
    # the longest range wins, of equal ones a closed one: one number, whose greatest needs no sort
    hit = tried.join(known, ["family", "size", "prefix"], "left").select("_address", "family", (F.col("size") * 2 + F.col("closed").cast("int")).alias("_hit"))
    judged = hit.groupBy("_address").agg((F.max("family").isNotNull() & (F.coalesce(F.max("_hit"), F.lit(0)) % 2 == 0)).alias("_public"))
    judged = Scratch(spark, "addresses").save(judged.where("_address IS NOT NULL"), "judged")
    joined = addresses.join(judged, addresses[address] == judged["_address"], "left")
    return joined.select(*addresses.columns, F.coalesce("_public", F.lit(False)).alias("public"))


def public_hosts(addresses: DataFrame, known: DataFrame, host: str = "host", address: str = "address") -> DataFrame:
    """(host, public): a host is public if it has addresses and all of them are; a null one counts as none that is public."""
    judged = with_public(addresses, known, address)
    return judged.groupBy(host).agg(F.bool_and("public").alias("public"))


def host_name(url: Column) -> Column:
    """The host of an http or https address in lower case, without user, port and brackets; null where there is none."""
    h = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::\d*)?(?:[/?#]|$)", 1)
    return F.nullif(F.regexp_replace(F.lower(h), r"[\[\]]", ""), F.lit(""))


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, target: pd.Series) -> pd.Series:
    def one(b, t):
        try:
            return urljoin(b, t)
        except ValueError:
            return None

    return pd.Series([one(b, t) for b, t in zip(base, target, strict=True)], dtype=object)


def read_body(body: Column) -> Column:
    """What is read of a response's bytes: the first of them as text, a broken character at the end left out."""
    return F.substring(F.regexp_replace(F.make_valid_utf8(F.substring(body, 1, MOST_BYTES).cast("string")), "�", ""), 1, MOST_CHARS)


def followed(urls: DataFrame, responses: DataFrame, hosts: DataFrame, blocked: Column | None = None, url: str = "url", most: int = MOST_REQUESTS) -> DataFrame:
    """(url, final_url, hops, outcome) of the different addresses in ``urls``.

    ``responses`` (url, status, location) are what fetching gave, one row an address;
    ``hosts`` (host, public) is asked before each request, the first one included.
    Each round joins the addresses that are still under way with the responses, so a
    chain costs as many joins as it has hops, and ``most`` bounds them; a loop is a
    chain that does not end in time.  outcome: ``page``, ``unsafe`` (no http, a host
    that is not public or not known, or ``blocked``, judged on the first address only),
    ``missing`` (no such response), ``failed`` (another status, or a redirect to
    nowhere), ``too many``.
    """
    scratch = Scratch(urls.sparkSession, "redirects")
    public = scratch.save(hosts.where("public").select(F.lower(F.col("host")).alias("_host")).distinct(), "public")
    answers = responses.select(F.col("url").alias("_at"), F.col("status").alias("_status"), F.nullif(F.col("location"), F.lit("")).alias("_location"))

    def checked(rows: DataFrame, also: Column | None = None) -> DataFrame:
        rows = rows.withColumns({"at": safe_url(F.col("at")), "_name": host_name(F.col("at"))}).join(public, F.col("_name") == F.col("_host"), "left")
        good = (F.col("at") != "") & F.col("_host").isNotNull() & (F.lit(True) if also is None else ~F.coalesce(also, F.lit(False)))
        return rows.select("url", "at", "hops", F.when(~good, "unsafe").alias("outcome"))

    first = urls.select(F.col(url).alias("url")).distinct()
    state = scratch.save(checked(first.select("url", F.col("url").alias("at"), F.lit(0).alias("hops")), blocked), "round-0")
    done = [state.where("outcome IS NOT NULL")]
    answers = scratch.save(answers, "answers")
    for k in range(1, most + 1):
        open_ = state.where("outcome IS NULL")
        met = open_.join(answers, F.col("at") == F.col("_at"), "left")
        moved = F.col("_status").isin(*REDIRECTS)
        outcome = F.when(F.col("_status").isNull(), "missing").when(F.col("_status") == 200, "page").when(~moved | F.col("_location").isNull(), "failed")
        met = scratch.save(met.select("url", "at", "hops", outcome.alias("outcome"), "_location"), f"met-{k}")
        done.append(met.where("outcome IS NOT NULL").drop("_location"))
        onward = met.where("outcome IS NULL").select("url", _joined(F.col("at"), F.col("_location")).alias("at"), (F.col("hops") + 1).alias("hops"))
        if k == most:
            done.append(onward.select("url", "at", "hops", F.lit("too many").alias("outcome")))
            break
        state = scratch.save(checked(onward), f"round-{k}")
        done.append(state.where("outcome IS NOT NULL"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("url", F.when(F.col("outcome") == "page", F.col("at")).alias("final_url"), "hops", "outcome")


def article_dates(urls: DataFrame, responses: DataFrame, hosts: DataFrame, blocked: Column | None = None, url: str = "url") -> DataFrame:
    """(url, published_at): the date that the page states to which each address leads, null where it leads to none.

    ``responses`` has the bytes as ``body``; the address's own date counts last, as it
    was asked for.
    """
    from cairn.functions.dates import page_date

    ends = followed(urls, responses, hosts, blocked, url).where("outcome = 'page'")
    pages = responses.select(F.col("url").alias("final_url"), read_body(F.col("body")).alias("_html"))
    dated = ends.join(pages, "final_url").select("url", page_date(F.col("_html"), F.col("url")).alias("published_at"))
    asked = urls.select(F.col(url).alias("url")).distinct()
    return asked.join(dated, asked["url"].eqNullSafe(dated["url"]), "left").select(asked["url"], "published_at")
