"""Where a document is fetched from: kinds of sources, mirrors, and when a host counts as down.

Hosts and the mirror are options without defaults. Decisions are columns over an attempt
log (order, requested, kind, ok, http_status), counters are aggregates over it.
"""

from __future__ import annotations

from pathlib import PurePosixPath, PureWindowsPath
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^https?://(?:[^@/?#]*@)?([^/:?#]+)", 1), F.lit("")))


def is_public(url: Column, public_hosts: tuple[str, ...]) -> Column:
    return F.coalesce(host(url).isin(*(h.lower() for h in public_hosts)), F.lit(False))


def source_kind(source: Column, public_hosts: tuple[str, ...], mirror: str | None = None) -> Column:
    """private_mirror, public, file_uri, remote or local, the first that fits."""
    under = source.startswith(mirror) if mirror else F.lit(False)
    return (
        F.when(under, "private_mirror")
        .when(is_public(source, public_hosts), "public")
        .when(source.rlike("(?i)^file:"), "file_uri")
        .when(source.rlike("(?i)^https?://"), "remote")
        .otherwise("local")
    )


def safe_relative(path: Column) -> Column:
    """The decoded path with forward slashes; null if it is empty or has an empty, ``.`` or ``..`` part."""
    plain = F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))
    trimmed = F.regexp_replace(plain, "^/+|/+$", "")
    return F.when(~F.exists(F.split(trimmed, "/"), lambda p: p.isin("", ".", "..")), trimmed)


def mirror_paths(url: Column) -> Column:
    """Paths to try below a mirror: as it is, and without a leading ftp/."""
    rel = safe_relative(F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1))
    return F.array_compact(F.array_distinct(F.array(rel, F.regexp_replace(rel, "(?i)^ftp/", ""))))


def candidates(sources: DataFrame, source: str, public_hosts: tuple[str, ...], mirror: str | None = None, circuit_open: Column | None = None) -> DataFrame:
    """Adds rank, effective and kind: the source itself, then, once the circuit is open, its places below the mirror."""
    src = F.col(source)
    own = F.array(src)
    open_ = F.lit(False) if circuit_open is None or mirror is None else circuit_open & is_public(src, public_hosts)
    under = F.transform(mirror_paths(src), lambda p: F.concat(F.lit((mirror or "").rstrip("/") + "/"), p))
    all_ = F.when(open_, F.concat(own, under)).otherwise(own)
    out = sources.select("*", F.posexplode(all_).alias("rank", "effective"))
    return out.withColumn("kind", source_kind(F.col("effective"), public_hosts, mirror))


def host_failure(http_status: Column, network_error: Column) -> Column:
    """Whether an attempt speaks against the host rather than the file: refused, throttled, failing, unreachable; not 404."""
    return F.coalesce(network_error, F.lit(False)) | F.coalesce(http_status.isin(401, 403, 407, 429) | http_status.between(500, 599), F.lit(False))


def circuit(attempts: DataFrame, keys: list[str], order: list[str], failure: Column, bucket: Column | None = None) -> DataFrame:
    """Adds circuit_open: an earlier attempt of the same keys was a host failure.

    The first failure of a key is a map-side minimum joined back; no key is sorted.
    """
    first = attempts.where(failure).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return attempts.join(first, keys, "left").withColumn("circuit_open", F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))).drop("_first")


def counters(attempts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Router counters over an attempt log (kind, ok, stale, failure)."""
    a = attempts.groupBy(*(keys or []))
    return a.agg(
        F.count_if(F.col("kind") == "public").alias("public_attempts"),
        F.count_if((F.col("kind") == "public") & F.col("ok")).alias("public_hits"),
        F.count_if(F.col("kind") == "private_mirror").alias("mirror_attempts"),
        F.count_if((F.col("kind") == "private_mirror") & F.col("ok")).alias("mirror_hits"),
        F.count_if(F.coalesce("stale", F.lit(False))).alias("stale_hits"),
        F.coalesce(F.bool_or("failure"), F.lit(False)).alias("circuit_opened"),
    )


def redact(message: Column, kind: Column, mirror: str | None) -> Column:
    """Error text that never shows a mirror's place."""
    shown = F.replace(message, F.lit(mirror), F.lit("<private-mirror>")) if mirror else message
    return F.when(kind == "private_mirror", F.concat(F.lit("<private-mirror>: "), F.regexp_extract(shown, r"^(\w*)", 1))).otherwise(shown)


def _quoted(path: Column) -> Column:
    """A path with one way of quoting: letters, digits and ``_.-~/:@`` stand for themselves."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    out = F.url_encode(plain)
    for code, sign in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def cache_key(source: Column) -> Column:
    """SHA-256 of an address with scheme and host in lower case, the path quoted in one way, without fragment."""
    bare = F.regexp_replace(source, "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?]*)?)", 1)
    rest = F.substr(bare, F.length(head) + 1)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    return F.sha2(F.concat(F.lower(head), _quoted(path), F.substr(rest, F.length(path) + 1)), 256)


def file_uri_to_path(uri: str, windows: bool = False) -> str:
    """The local path of a file: address; drive letters and UNC hosts on Windows."""
    parts = urlsplit(uri)
    if parts.scheme.lower() != "file" or parts.query or parts.fragment:
        raise ValueError("not a plain file address")
    path = unquote(parts.path)
    if windows:
        if parts.netloc and parts.netloc.lower() != "localhost":
            return str(PureWindowsPath(f"//{parts.netloc}{path}"))
        return str(PureWindowsPath(path.lstrip("/")))
    if parts.netloc and parts.netloc.lower() != "localhost":
        raise ValueError("a host needs Windows paths")
    return str(PurePosixPath(path))


def join_mirror(root: str, relative: str) -> str:
    """A safe relative path below a mirror that is an address, a file: address or a folder."""
    plain = unquote(relative).replace("\\", "/").strip("/")
    if not plain or any(p in ("", ".", "..") for p in plain.split("/")):
        raise ValueError("unsafe path")
    if "?" in root or "#" in root:
        raise ValueError("a mirror has no query or fragment")
    return f"{root.rstrip('/')}/{plain}"
