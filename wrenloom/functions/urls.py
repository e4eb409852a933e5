"""Scalar functions on URLs and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"
HREF = r'href="([^"]*)"'


def unique_key(stage: Column, url: Column) -> Column:
    """The key by which a task is known. Null if either is."""
    return F.concat(stage, F.lit("|"), url)


def transfer_key(source: Column, folder: Column, file: Column) -> Column:
    """The key under which one transfer runs at a time."""
    return F.concat(source, F.lit("|"), folder, F.lit("|"), file)


def state_path(state_dir: Column, folder: Column, key: Column) -> Column:
    """Where a transfer's state is kept; empty parts of the path are left out."""
    return F.concat_ws("/", F.nullif(state_dir, F.lit("")), F.nullif(folder, F.lit("")), F.concat(F.md5(key), F.lit(".json")))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def resolve(raw: Column, base: Column) -> Column:
    """A reference against a base: absolute ones as they are, rooted ones on the base's host, others appended. "..", and "//host", have no meaning."""
    rooted = F.when(F.length(origin(base)) > 0, F.concat(origin(base), raw)).otherwise(F.concat(base, raw))
    return F.when(raw.startswith("http://") | raw.startswith("https://") | (base == ""), raw).when(raw.startswith("/"), rooted).otherwise(F.concat(base, raw))


def base_of(url: Column) -> Column:
    """The folder of a URL, with a slash at its end; of a file at the root, the root."""
    return F.concat(origin(url), F.regexp_replace(path(url), r"/[^/]*$", ""), F.lit("/"))


def last_element(url: Column) -> Column:
    """The last element of the path, empty if there is none."""
    return F.regexp_extract(path(url), r"([^/]+)/*$", 1)


def video_file_name(url: Column, fallback: Column) -> Column:
    """The name of a playlist's output: its last path element with ".ts" for ".m3u8"; without one, the fallback with ".ts"."""
    stem = F.regexp_replace(last_element(url), r"\.m3u8$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), fallback), F.lit(".ts"))


def file_name(url: Column, disposition: Column, fallback: Column) -> Column:
    """A download's name: filename* of the header, else filename, else the URL's last element, decoded; without any, the fallback. Always a bare name."""
    header = F.coalesce(disposition, F.lit(""))
    extended = F.try_url_decode(F.regexp_extract(header, r"(?i)(?:^|[;\s])filename\*\s*=\s*\"?[^'\";]*'[^']*'([^;\"\s]+)", 1))
    quoted = F.regexp_extract(header, r'(?i)(?:^|[;\s])filename\s*=\s*"([^"]*)"', 1)
    bare = F.regexp_extract(header, r"(?i)(?:^|[;\s])filename\s*=\s*([^\";\s]+)", 1)
    named = [F.nullif(F.regexp_extract(x, r"([^/]+)/*$", 1), F.lit("")) for x in (extended, quoted, bare, F.try_url_decode(last_element(url)))]
    return F.coalesce(*named, fallback)


def with_extension(name: Column, extension: str) -> Column:
    """The name with another extension."""
    return F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(extension))


def proxy_url(host: Column, port: Column) -> Column:
    return F.concat(F.lit("http://"), host, F.lit(":"), port)


def chunk_file(start: Column) -> Column:
    """The name of a part's temporary file; its digits sort by offset."""
    return F.concat(F.lit("chunk_"), F.lpad(start.cast("string"), 20, "0"), F.lit(".tmp"))


def chunk_start(name: Column) -> Column:
    """The offset in such a name; null for other names."""
    return F.nullif(F.regexp_extract(name, r"chunk_(\d{20})\.tmp$", 1), F.lit("")).cast("bigint")


def segment_file(index: Column) -> Column:
    return F.format_string("segment_%05d.ts", index)
