"""Domain names: normalising, routing to a lookup, classifying saved responses, reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.idna import ascii_domain
from ..functions.text import domain, domain_problem, host_of, tld
from .dedupe import first_wins

# Zones asked by text lookup, and the markers of its answers in order of trust.
TEXT_ZONES = ("ru", "xn--p1ai")
NOT_FOUND = ("no entries found", "no match", "not found", "no data found")
REGISTERED = ("domain:", "registrar:", "state: registered")
FREE, TAKEN, UNKNOWN, FAILED, INVALID = "appears_unregistered", "registered", "unknown", "provider_error", "invalid"


def normalise(raw: DataFrame, name: str = "raw", order: str = "ord") -> DataFrame:
    """``(ord, domain, ascii_domain, tld, problem)``: the first of each ASCII name; bad input is a row with a problem."""
    rows = raw.select(order, domain(F.col(name)).alias("domain")).where("domain is not null")
    rows = rows.withColumn("problem", domain_problem(F.col("domain")))
    rows = rows.withColumn("ascii_domain", ascii_domain(F.when(F.col("problem").isNull(), F.col("domain"))))
    rows = rows.withColumn("problem", F.when(F.col("problem").isNull() & F.col("ascii_domain").isNull(), F.lit("no ASCII form")).otherwise(F.col("problem")))
    good = first_wins(rows.where("problem is null"), "ascii_domain", [order]).withColumn("tld", tld(F.col("ascii_domain")))
    bad = rows.where("problem is not null").withColumn("tld", F.lit(None).cast("string"))
    return good.unionByName(bad)


def normalise_hosts(raw: DataFrame, name: str = "raw", order: str = "ord") -> DataFrame:
    """``(ord, domain)``: the lenient form, first of each."""
    return first_wins(raw.select(order, host_of(F.col(name)).alias("domain")), "domain", [order])


def lookup_servers(names: DataFrame, services: DataFrame) -> DataFrame:
    """Add ``server``: of the services that list a zone, the first. ``services`` is (service_ord, tlds, server);
    the lookup table of zones is small, its rows are counted by the planner and broadcast if so."""
    zones = services.select("service_ord", "server", F.explode("tlds").alias("tld"))
    one = zones.groupBy("tld").agg(F.min_by("server", "service_ord").alias("server"))
    return names.join(one, "tld", "left")


def route(zone: Column, server: Column, structured_ok: Column) -> Column:
    """The method for a name: text lookup for its own zones and wherever the structured one is not available."""
    return F.when(zone.isin(*TEXT_ZONES), "whois").when(server.isNotNull() & structured_ok, "rdap").otherwise("whois")


def structured_status(code: Column) -> Column:
    return F.when(code == 200, TAKEN).when(code == 404, FREE)


def retryable(code: Column) -> Column:
    return (code == 429) | (code >= 500)


def text_status(body: Column) -> Column:
    """Markers of absence come before markers of a registration; neither is unknown; no answer at all failed."""
    low = F.lower(body)
    has = lambda marks: F.greatest(*[low.contains(m) for m in marks])
    return F.when(body.isNull(), FAILED).when(has(NOT_FOUND), FREE).when(has(REGISTERED), TAKEN).otherwise(UNKNOWN)


def dns_status(ns: Column, soa: Column) -> Column:
    """Records prove a registration; their absence proves nothing."""
    return F.when((F.coalesce(ns, F.lit(0)) > 0) | (F.coalesce(soa, F.lit(0)) > 0), TAKEN).otherwise(UNKNOWN)


def dns_detail(ns: Column, soa: Column) -> Column:
    ns, soa = F.coalesce(ns, F.lit(0)), F.coalesce(soa, F.lit(0))
    found = F.concat(F.lit("Found "), ns.cast("string"), F.lit(" NS and "), soa.cast("string"), F.lit(" SOA records"))
    return F.when((ns > 0) | (soa > 0), found).otherwise(F.lit("No NS or SOA records found"))


def check(names: DataFrame, responses: DataFrame, services: DataFrame, method: str = "auto") -> DataFrame:
    """One result per name, in the fields of a lookup, from saved responses (domain, http_status, whois_body, ns, soa).

    ``auto`` falls back from the structured to the text lookup where the former has no
    server or no usable answer. Names with a problem have status ``invalid``.
    """
    saved = responses.withColumnRenamed("domain", "ascii_domain")
    rows = lookup_servers(names, services).join(saved, "ascii_domain", "left")
    by_code = structured_status(F.col("http_status"))
    chosen = {
        "auto": route(F.col("tld"), F.col("server"), by_code.isNotNull()),
        "rdap": F.lit("rdap"), "whois": F.lit("whois"), "dns": F.lit("dns"),
    }[method]
    rows = rows.withColumn("method", F.when(F.col("problem").isNull(), chosen))
    status = (
        F.when(F.col("problem").isNotNull(), INVALID)
        .when(F.col("method") == "rdap", F.when(F.col("server").isNull(), FAILED).otherwise(F.coalesce(by_code, F.lit(FAILED))))
        .when(F.col("method") == "whois", text_status(F.col("whois_body")))
        .otherwise(dns_status(F.col("ns"), F.col("soa")))
    )
    message = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when((F.col("method") == "rdap") & F.col("server").isNull(), F.concat(F.lit("no server for zone "), "tld"))
        .when((F.col("method") == "rdap") & by_code.isNull(), F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        .when((F.col("method") == "whois") & F.col("whois_body").isNull(), F.lit("no answer"))
    )
    return rows.select(
        "ord", "domain", F.col("ascii_domain").alias("asciiDomain"), "tld", "method", status.alias("status"), F.upper("method").alias("source"), message.alias("message"),
        F.when(F.col("problem").isNull(), dns_detail(F.col("ns"), F.col("soa"))).alias("dns"),
    )


def report(results: DataFrame) -> DataFrame:
    """``(tag, names, n)``: free, taken and errored names in input order, with their counts."""
    tag = F.when(F.col("status") == FREE, "free").when(F.col("status") == TAKEN, "taken").otherwise("err")
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "domain"))), lambda r: r["domain"])
    return results.groupBy(tag.alias("tag")).agg(names.alias("names"), F.count(F.lit(1)).alias("n"))


def summary(results: DataFrame) -> DataFrame:
    status = F.col("status")
    return results.agg(F.count_if(status == FREE).alias("free"), F.count_if(status == TAKEN).alias("taken"), F.count_if(~status.isin(FREE, TAKEN)).alias("errored"), F.count(F.lit(1)).alias("total"))


# -- bulk answers of a registrar ----------------------------------------------------

ANSWER = (
    "struct<result:string,error_code:string,error_text:string,answer:struct<domains:array<struct<dname:string,domain_name:string,"
    "result:string,error_code:string,is_premium:int,price:decimal(18,2),renew_price:decimal(18,2),currency:string>>>>"
)


def registrar_items(saved: DataFrame, body: str = "value") -> DataFrame:
    """Rows of ``answer.domains[]``; a failed answer is a row with an error."""
    rows = saved.withColumn("_a", F.from_json(body, ANSWER))
    failed = (
        F.when(F.col(body).isNull() | F.try_parse_json(body).isNull(), F.lit("not JSON"))
        .when(F.col("_a.result").isNull() | (F.col("_a.result") != "success"), F.concat_ws(": ", F.concat_ws(" ", F.lit("API error"), "_a.error_code"), "_a.error_text"))
        .when(F.col("_a.answer.domains").isNull(), F.lit("no answer.domains array"))
    )
    rows = rows.withColumn("error", failed)
    items = rows.where("error is null").select(F.posexplode("_a.answer.domains").alias("ord", "d"))
    good = items.select("ord", F.coalesce("d.dname", "d.domain_name").alias("dname"), "d.result", "d.error_code", "d.is_premium", "d.price", "d.renew_price", "d.currency", F.lit(None).cast("string").alias("error"))
    bad = rows.where("error is not null").select("error")
    return good.unionByName(bad, allowMissingColumns=True)


def available(result: Column) -> Column:
    return F.when(result == "Available", "available").otherwise("unavailable")


def item_line() -> Column:
    """``name - result (code) [premium] price: p cur renew: r cur``, without what is missing."""
    money = lambda label, c: F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.concat_ws(" ", F.lit(label), F.col(c).cast("string"), "currency"))
    return F.concat_ws(
        " ", F.coalesce(F.nullif("dname", F.lit("")), F.lit("(unknown)")), F.lit("-"), F.coalesce("result", F.lit("Unknown")),
        F.when(F.col("error_code") != "", F.concat(F.lit("("), "error_code", F.lit(")"))), F.when(F.col("is_premium") != 0, F.lit("[premium]")),
        money("price:", "price"), money("renew:", "renew_price"),
    )


def good_names(names: DataFrame, most: int = 15, zone: str = "") -> DataFrame:
    """Generated names that are short, without dash or digit, and do not repeat their zone."""
    name = F.col("name")
    keep = (F.length(name) <= most) & ~name.rlike("[-0-9]")
    return names.where(keep & ~F.lower(name).contains(zone.lower())) if zone else names.where(keep)


def read_services(saved: DataFrame, body: str = "value") -> DataFrame:
    """``(service_ord, tlds, server)`` from a saved lookup table: ``services`` is a list of [zones, servers]."""
    table = F.from_json(F.get_json_object(body, "$.services"), "array<array<array<string>>>")
    rows = saved.select(F.posexplode(table).alias("service_ord", "s"))
    return rows.select("service_ord", F.transform(F.col("s")[0], lambda z: F.lower(z)).alias("tlds"), F.regexp_replace(F.col("s")[1][0], "/+$", "").alias("server"))
