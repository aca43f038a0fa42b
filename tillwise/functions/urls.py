"""URL canonical form and what a host says about a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.core import lookup

# Tracking parameters.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid"]
PARTS = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, i)


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(_part(url, 2)), F.lit("."))


def path_of(url: Column) -> Column:
    return _part(url, 4)


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, drop default port, fragment and tracking keys, sort the query.

    NULL for anything but an absolute http(s) URL. Hosts outside ASCII are expected in their
    encoded form."""
    scheme, port = F.lower(_part(url, 1)), _part(url, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)

    def pair(p: Column) -> Column:
        return F.struct(decode(F.substring_index(p, "=", 1)).alias("k"),
                        F.when(p.contains("="), decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v"))

    query = F.filter(F.transform(F.filter(F.split(_part(url, 5), "&"), lambda p: p != ""), pair),
                     lambda q: ~F.lower(q["k"]).startswith("utm_") & ~F.lower(q["k"]).isin(TRACKING))
    text = F.array_join(F.transform(F.array_sort(query), lambda q: F.concat(_encode(q["k"]), F.lit("="), _encode(q["v"]))), "&")
    path = F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4))
    out = F.concat(scheme, F.lit("://"), F.lower(_part(url, 2)), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path,
                   F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))
    return F.when(scheme != "", out)


# Domains by class.
PRIMARY = ["bok.or.kr", "kosis.kr", "customs.go.kr", "moef.go.kr", "mafra.go.kr", "motie.go.kr", "mfds.go.kr", "ftc.go.kr",
           "gov.kr", "bizinfo.go.kr", "semas.or.kr", "data.go.kr"]
LOCAL = ["seoul.go.kr", "busan.go.kr", "daegu.go.kr", "incheon.go.kr", "gwangju.go.kr", "daejeon.go.kr", "ulsan.go.kr",
         "sejong.go.kr", "gg.go.kr", "gangnam.go.kr", "seocho.go.kr", "songpa.go.kr"]
FINANCIAL = ["kbstar.com", "kfcc.co.kr", "kodit.co.kr", "koreg.or.kr"]
NEWS = ["yna.co.kr", "kbs.co.kr", "imbc.com", "sbs.co.kr", "hani.co.kr", "donga.com", "joongang.co.kr", "chosun.com"]
AUTHORITIES = {"visitgangnam.net": ("OFFICIAL_LOCAL_GOV", "OFFICIAL_TRUSTED", "LOCAL_GOVERNMENT", "gangnam.go.kr")}
LOCAL_CONTEXT = ("구청|시청|군청|도청|주민센터|district office|municipal|metropolitan government|local government")


def suffixes(host: Column) -> Column:
    """The host and its parent domains, so that a domain rule is one array overlap."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _under(host: Column, domains: list[str]) -> Column:
    return F.arrays_overlap(suffixes(host), F.array(*[F.lit(x) for x in domains]))


def _authority(host: Column, field: int, extra: dict | None = None) -> Column:
    table = {k: v[field] for k, v in {**AUTHORITIES, **(extra or {})}.items()}
    hits = F.filter(F.transform(suffixes(host), lambda s: lookup(table, s)), lambda x: x.isNotNull())
    return F.get(hits, F.lit(0))


def source_class(host: Column, context: Column | None = None) -> Column:
    context = F.lit("") if context is None else F.lower(context)
    gov = host.endswith(".go.kr")
    return (
        F.when(_authority(host, 0).isNotNull(), _authority(host, 0)).when(_under(host, LOCAL), "OFFICIAL_LOCAL_GOV")
        .when(_under(host, PRIMARY), "OFFICIAL_PRIMARY").when(gov & context.rlike(LOCAL_CONTEXT), "OFFICIAL_LOCAL_GOV")
        .when(gov, "OFFICIAL_PRIMARY").when(_under(host, FINANCIAL), "FINANCIAL_INSTITUTION")
        .when(_under(host, NEWS), "MAJOR_NEWS").otherwise("OTHER"))


def source_trust(host: Column) -> Column:
    gov = (host == "go.kr") | host.endswith(".go.kr")
    return (
        F.when(_authority(host, 1).isNotNull(), _authority(host, 1)).when(gov | _under(host, PRIMARY), "OFFICIAL_TRUSTED")
        .when(_under(host, FINANCIAL), "INSTITUTIONAL_TRUSTED").when(_under(host, NEWS), "VERIFIED_MEDIA")
        .otherwise("UNVERIFIED"))


def source_role(host: Column) -> Column:
    gov = (host == "go.kr") | host.endswith(".go.kr")
    return (
        F.when(_authority(host, 2).isNotNull(), _authority(host, 2)).when(_under(host, LOCAL), "LOCAL_GOVERNMENT")
        .when((host == "data.go.kr") | _under(host, ["kosis.kr"]), "OFFICIAL_DATA").when(gov, "LOCAL_GOVERNMENT")
        .when(_under(host, FINANCIAL), "FINANCIAL_INSTITUTION").when(_under(host, PRIMARY), "CENTRAL_GOVERNMENT")
        .otherwise("OTHER"))


def governing_authority(host: Column) -> Column:
    return _authority(host, 3)
