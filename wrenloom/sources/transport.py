"""How pages and bytes are had: offline from stored pages by default, over HTTP if asked for. Both give the columns of schemas.RESPONSES."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenloom import schemas


class Transport(Protocol):
    def fetch(self, requests: DataFrame) -> DataFrame:
        """Responses to requests (url, byte_range, headers), a row each; more if a URL has more than one answer."""


class Offline:
    """Answers from a table of pages (url, html): 200, or 206 to a range, with the page's bytes; 404 for others.

    Pages with one URL all answer, a row each; to a request with a page_id, if requests have that column, only the page of that number does. Page numbers are taken to be distinct.
    """

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def fetch(self, requests: DataFrame) -> DataFrame:
        keys = [c for c in ("url", "page_id") if c in requests.columns]
        stored = self.pages.where("html is not null").select(*[F.col(c).alias(f"_{c}") for c in keys], F.encode("html", "UTF-8").alias("_body"))
        if "byte_range" not in requests.columns:
            requests = requests.withColumn("byte_range", F.lit(None).cast("string"))
        r = requests.join(stored, [F.col(c) == F.col(f"_{c}") for c in keys], "left")
        a, b = (F.regexp_extract("byte_range", r"^bytes=(\d+)-(\d+)$", g).cast("bigint") for g in (1, 2))
        ranged = F.col("byte_range").isNotNull()
        body = F.when(ranged, F.substring(F.col("_body"), (a + 1).cast("int"), (b - a + 1).cast("int"))).otherwise(F.col("_body"))
        headers = F.create_map(F.lit("Content-Length"), F.octet_length("_body").cast("string"), F.lit("Accept-Ranges"), F.lit("bytes"))
        none = F.lit(None)
        found = F.col("_body").isNotNull()
        return r.select("url", F.when(~found, 404).when(ranged, 206).otherwise(200).alias("status"), F.when(found, headers).alias("headers"), F.when(found, body).alias("body"), F.when(~found, "status 404").otherwise(none).alias("error"))


class Http:
    """Fetches over HTTP, one session a partition. get: how to make a session, replaced in tests; it needs the package requests otherwise.

    Retries repeat requests, so what is asked for must be safe to ask twice; speculative execution should be off.
    """

    def __init__(self, retries: int = 3, timeout: float = 30.0, base_ns: int = 0, partitions: int | None = None, get: Callable | None = None, wait: Callable[[float], None] | None = None):
        self.retries, self.timeout, self.base_ns, self.partitions, self.get, self.wait = retries, timeout, base_ns, partitions, get, wait

    def fetch(self, requests: DataFrame) -> DataFrame:
        retries, timeout, base_ns, get, wait = self.retries, self.timeout, self.base_ns, self.get, self.wait

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            if get is None:
                import requests as library

                session = library.Session().get
            else:
                session = get()
            pause = wait or time.sleep
            for rows in batches:
                out = []
                for r in rows.to_dict("records"):
                    headers = dict(r.get("headers") or {}) | {"Accept-Encoding": "identity"}
                    if r.get("byte_range"):
                        headers["Range"] = r["byte_range"]
                    wanted = 206 if r.get("byte_range") else 200
                    answer = (r["url"], None, None, None, "not tried")
                    for attempt in range(retries + 1):
                        if attempt:
                            pause(min((base_ns or 2_000_000_000) * 2 ** (attempt - 1), 10_000_000_000) / 1e9)
                        try:
                            got = session(r["url"], headers=headers, timeout=timeout)
                        except Exception as e:  # any failure of the network counts as an answer
                            answer = (r["url"], None, None, None, str(e) or type(e).__name__)
                            continue
                        good = got.status_code == wanted
                        answer = (r["url"], got.status_code, dict(got.headers), got.content if good else None, None if good else f"status {got.status_code}")
                        if good:
                            break
                    out.append(answer)
                yield pd.DataFrame(out, columns=["url", "status", "headers", "body", "error"]).astype({"status": "Int32"})

        return (requests.repartition(self.partitions) if self.partitions else requests).mapInPandas(work, schemas.RESPONSES)
