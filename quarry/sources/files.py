"""Where documents come from: files, HTTP, object stores and crawled sites, as files(path, length, content)."""

from __future__ import annotations

import glob
import hashlib
import ipaddress
import json
import logging
import os
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.runtime import exists, hadoop_path, prepare

log = logging.getLogger(__name__)
SECRETS = ("access_key_id", "secret_access_key", "headers", "token", "api_key")
SCHEMA = "path string, length long, content binary"


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def local(spark: SparkSession, path: str) -> DataFrame:
    """A file, a folder with all below it, or a pattern; what doesn't exist warns and gives nothing."""
    prepare(spark)
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true")
    if "://" not in path and any(c in path for c in "*?["):
        found = sorted(p for p in glob.glob(path, recursive=True) if os.path.isfile(p))
        if not found:
            log.warning("no file matches %s", path)
            return none(spark)
        return read.load(found).select("path", "length", "content")
    if "://" not in path and not Path(path).exists():
        log.warning("%s does not exist", path)
        return none(spark)
    return read.option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def object_store(spark: SparkSession, bucket: str, key: str = "", endpoint_url: str | None = None, access_key_id: str | None = None, secret_access_key: str | None = None, region: str | None = None) -> DataFrame:
    """Objects under a prefix through Hadoop's s3a, which lists and reads in parallel; folder markers are empty, a
    prefix that is absent or may not be listed warns and gives nothing."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in (("endpoint", endpoint_url), ("access.key", access_key_id), ("secret.key", secret_access_key), ("endpoint.region", None if region in (None, "auto") else region)):
        if value:
            conf.set(f"fs.s3a.bucket.{bucket}.{name}", value)
    path = f"s3a://{bucket}/{key}"
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    except Exception as e:
        log.warning("%s: %s", path, str(e).split("\n")[0])
        return none(spark)
    return rows.where("length > 0").select("path", "length", "content")


def public_address(host: str) -> bool:
    """None of the addresses of the host is local, private, reserved or multicast."""
    try:
        found = {info[4][0] for info in socket.getaddrinfo(host, None)}
    except OSError:
        return False
    addresses = [ipaddress.ip_address(a.split("%")[0]) for a in found]
    return bool(addresses) and not any(a.is_private or a.is_loopback or a.is_link_local or a.is_unspecified or a.is_multicast or a.is_reserved for a in addresses)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch(url: str, headers: dict | None = None, timeout: float = 30.0, max_bytes: int = 50 << 20, guard=public_address, opener=None) -> bytes:
    """The body, over at most five redirects, each checked by the guard, and three more tries at once for passing errors."""
    opener = opener or urllib.request.build_opener(_NoRedirect)
    timeout = min(30.0, max(1.0, timeout))
    hops = tries = 0
    while True:
        parts = urllib.parse.urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname or not guard(parts.hostname):
            raise PermissionError(f"{url} may not be fetched")
        try:
            with opener.open(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as answer:
                if int(answer.headers.get("Content-Length") or 0) > max_bytes:
                    raise ValueError(f"{url} is larger than {max_bytes} bytes")
                data = answer.read(max_bytes + 1)
                if len(data) > max_bytes:
                    raise ValueError(f"{url} is larger than {max_bytes} bytes")
                return data
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location") and hops < 5:
                hops += 1
                url = urllib.parse.urljoin(url, e.headers["Location"])
                continue
            if e.code not in (429, 500, 502, 503, 504) or tries >= 3:
                raise
        except urllib.error.URLError:
            if tries >= 3:
                raise
        tries += 1


def name_from_url(url: str) -> str:
    return urllib.parse.urlsplit(url).path.rsplit("/", 1)[-1] or "document"


class Incomplete(OSError):
    """A source that couldn't be read to its end; what it gave may not stand as its content."""


def http(spark: SparkSession, urls: list[str] | DataFrame, headers: dict | None = None, timeout: float = 30.0, max_bytes: int = 50 << 20, fetcher=fetch) -> DataFrame:
    """Pages fetched by the executors, one task a slice of the urls; what fails is logged there and left out."""
    prepare(spark)
    rows = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")

    def run(batches):
        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    data = fetcher(url, headers, timeout, max_bytes)
                    out.append((name_from_url(url), len(data), data))
                except Exception as e:
                    log.warning("%s: %s", url, e)
            yield pd.DataFrame(out, columns=["path", "length", "content"])

    return rows.select("url").mapInPandas(run, SCHEMA)


def crawl_pages(url: str, api_key: str, limit: int, endpoint_url: str, polls: int, wait: float, call=None) -> list[dict]:
    """Pages of one finished job of a crawling service. Incomplete if it fails, or isn't done after all polls."""

    def request(path: str, body: dict | None = None) -> dict:
        data = json.dumps(body).encode() if body is not None else None
        r = urllib.request.Request(f"{endpoint_url}{path}", data, {"Authorization": f"Bearer {api_key}", "Content-Type": "application/json"})
        with urllib.request.urlopen(r, timeout=60) as answer:
            return json.load(answer)

    call = call or request
    state = call("/v1/crawl", {"url": url, "limit": limit, "scrapeOptions": {"formats": ["markdown"]}})
    if not isinstance(state.get("data"), list):
        job = state.get("id")
        if not job:
            raise Incomplete(f"crawl of {url}: neither a job nor pages")
        for _ in range(polls):
            state = call(f"/v1/crawl/{job}")
            if state.get("status") == "completed":
                break
            if state.get("status") == "failed":
                raise Incomplete(f"crawl of {url} failed: {state.get('error', '')}")
            time.sleep(wait)
        else:
            raise Incomplete(f"crawl of {url} isn't done after {polls} polls")
    return [p for p in state.get("data") or [] if isinstance(p, dict)]


def crawl(spark: SparkSession, url: str, api_key: str | None = None, limit: int = 50, endpoint_url: str | None = None, polls: int = 120, wait: float = 2.0, call=None, guard=public_address) -> DataFrame:
    """Pages that a crawling service finds below a url, markdown before HTML; pages without either are left out.

    PermissionError without a key or for a seed that the guard refuses, Incomplete for a job that isn't finished.
    """
    key = api_key or os.environ.get("FIRECRAWL_API_KEY", "")
    if not key and call is None:
        raise PermissionError(f"crawl of {url}: no key")
    if not guard(urllib.parse.urlsplit(url).hostname or ""):
        raise PermissionError(f"{url} may not be crawled")
    out = []
    for page in crawl_pages(url, key, limit, (endpoint_url or "https://api.firecrawl.dev").rstrip("/"), polls, wait, call):
        at = (page.get("metadata") or {}).get("sourceURL") or url
        text, ending = (page["markdown"], ".md") if page.get("markdown") else (page.get("html") or "", ".html")
        if text:
            out.append((name_from_url(at) + ending, len(text.encode()), bytearray(text.encode())))
    if not out:
        log.warning("crawl of %s gave no pages", url)
    return spark.createDataFrame(out, SCHEMA) if out else none(spark)


def source_key(spec: dict) -> str:
    """Name of a source without its secrets."""
    return hashlib.sha256(repr(sorted((k, v) for k, v in spec.items() if k not in SECRETS)).encode()).hexdigest()[:32]


def cached(spark: SparkSession, spec: dict, folder: str | None, read) -> DataFrame:
    """What was fetched before for the same source, from Parquet; else fetched and, if that gave anything, written.

    A read that fails warns and gives nothing, and neither it nor an empty answer is kept: the next run tries again.
    """
    path = f"{folder}/{source_key(spec)}" if folder else None
    if path and exists(spark, path + "/_SUCCESS"):
        return spark.read.parquet(path)
    try:
        rows = read()
        if path:
            rows.write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path)
            if rows.isEmpty():
                p, fs = hadoop_path(spark, path)
                fs.delete(p, True)
                return none(spark)
        return rows
    except Exception as e:
        log.warning("source %s: %s", source_key(spec), str(e).split("\n")[0])
        return none(spark)


def entry(spark: SparkSession, spec, cache: str | None = None) -> DataFrame | None:
    """Files of one `documents` entry: a path, or a mapping with path, or one with an explicit source."""
    if isinstance(spec, str):
        return local(spark, spec)
    if not isinstance(spec, dict):
        return None
    kind = spec.get("source", "file")
    if kind in ("file", "local"):
        return local(spark, spec["path"]) if spec.get("path") else None
    if kind in ("http", "https"):
        return cached(spark, spec, cache, lambda: http(spark, [spec["url"]], spec.get("headers"), spec.get("timeout", 30.0)))
    if kind == "s3":
        return object_store(spark, spec["bucket"], spec.get("key", ""), spec.get("endpoint_url"), spec.get("access_key_id"), spec.get("secret_access_key"), spec.get("region"))
    if kind == "firecrawl":
        return cached(spark, spec, cache, lambda: crawl(spark, spec["url"], spec.get("api_key"), int(spec.get("limit", 50)), spec.get("endpoint_url")))
    log.warning("no source %r", kind)
    return None


def documents(spark: SparkSession, entries: list, max_document_size_mb: float = 10, cache: str | None = None, parsers: dict | None = None) -> DataFrame:
    """Parsed documents of all entries, with `entry`, the place of their entry; their order is by entry and path."""
    from quarry.sources.parsers import parse_files

    parts = []
    for i, spec in enumerate(entries):
        files = entry(spark, spec, cache)
        if files is not None:
            hint = spec.get("format") if isinstance(spec, dict) else None
            parts.append(parse_files(files, hint, int(max_document_size_mb * (1 << 20)), parsers).withColumn("entry", F.lit(i)))
    if not parts:
        return spark.createDataFrame([], "doc_id string, title string, content string, source_format string, page_count int, table_count int, path string, entry int")
    return reduce(DataFrame.unionByName, parts)
