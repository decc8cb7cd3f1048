"""Client identity and upstream resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_METHODS = ("header", "ip", "token", "mtls")


def normalize_headers(headers: Column) -> Column:
    """Lower-case keys; needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` for repeated keys."""
    return F.map_from_entries(F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("key"), e.value)))


def client_id(
    headers: Column, remote_addr: Column | None = None, cert_cn: Column | None = None,
    method: str = "ip", header_name: str = "X-Client-ID", fallback_header: str | None = None,
    trust_forwarded: bool = False, hash_token: bool = True,
) -> Column:
    """Client identity of a request whose ``headers`` have lower-case keys, else ``unknown``."""
    if method not in _METHODS:
        raise ValueError(f"unknown identity method {method!r}, expected one of {_METHODS}")
    unknown = F.lit("unknown")
    given = lambda c: F.nullif(c, F.lit(""))
    header = lambda name: given(F.try_element_at(headers, F.lit(name.lower())))
    first_hop = lambda c: F.trim(F.split_part(c, F.lit(","), F.lit(1)))
    nothing = F.lit(None).cast("string")
    if method == "header":
        second = first_hop(header(fallback_header)) if fallback_header else nothing
        return F.coalesce(header(header_name), second, unknown)
    if method == "ip":
        forwarded = first_hop(header("x-forwarded-for")) if trust_forwarded else nothing
        remote = given(remote_addr) if remote_addr is not None else nothing
        return F.coalesce(forwarded, remote, unknown)
    if method == "token":
        auth = header("authorization")
        token = F.when(F.lower(auth).startswith("bearer "), F.substring(auth, 8, 2147483647)).otherwise(auth)
        return F.coalesce(F.left(F.sha2(token, 256), F.lit(32)) if hash_token else token, unknown)
    return F.coalesce(given(cert_cn) if cert_cn is not None else nothing, unknown)


def route_by_path(df: DataFrame, upstreams: DataFrame, path: str = "path") -> DataFrame:
    """``/{provider}/{rest}`` -> provider and upstream URL; NULL where the provider is unknown.

    Upstreams are configuration; Spark broadcasts them by their size.
    """
    parts = F.split(F.col(path), "/", 3)
    table = upstreams.select(
        F.col("provider").alias("_provider"), F.rtrim(F.col("url"), F.lit("/")).alias("_base"),
        F.col("auth_header").alias("_auth"), F.col("timeout").alias("_timeout"),
    )
    rest = F.concat(F.lit("/"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")))
    joined = df.join(table, F.lower(F.try_element_at(parts, F.lit(2))) == F.col("_provider"), "left")
    return joined.select(
        *df.columns, F.col("_provider").alias("provider"),
        F.concat("_base", rest).alias("upstream_url"), F.col("_auth").alias("auth_header"),
        F.col("_timeout").alias("timeout"),
    )


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def route_by_host(
    df: DataFrame, upstreams: DataFrame, url: str = "url", default_timeout: int = 60
) -> DataFrame:
    """Provider of the URL's host, the host itself where it is not configured, and whether
    the host is on the list of upstreams."""
    table = upstreams.select(
        host_of(F.col("url")).alias("_host"), F.col("provider").alias("_provider"),
        F.col("auth_header").alias("_auth"), F.col("timeout").alias("_timeout"),
    ).where("_host is not null")
    host = host_of(F.col(url))
    return (
        df.withColumn("host", host).join(table, F.col("host") == F.col("_host"), "left")
        .select(
            *df.columns, "host", F.coalesce("_provider", "host").alias("provider"),
            F.col("_auth").alias("auth_header"),
            F.coalesce("_timeout", F.lit(default_timeout)).alias("timeout"),
            F.col("_host").isNotNull().alias("host_allowed"),
        )
    )


def off_list_hosts(df: DataFrame, upstreams: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is no configured upstream."""
    table = upstreams.select(host_of(F.col("url")).alias("host")).where("host is not null")
    return df.withColumn("host", host_of(F.col(url))).join(table, "host", "left_anti")
