"""Connectors to services outside: fetching, searching and translating with retries, error rows and a cache.

The call itself is a function that is passed in, so that nothing here depends on a service; it runs in
bounded numbers of tasks and threads.  Requests are made distinct before they are sent.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship

PAGE = "status string, http_status int, final_url string, content_type string, body binary, error string"
#: What a page is where no attempt succeeded.
NO_PAGE = {"status": "error", "http_status": None, "final_url": "", "content_type": "", "body": None}


class Unreachable(Exception):
    """A failure that another attempt may overcome: a lost connection or a timeout."""


def pause(low: float, high: float) -> float:
    return random.uniform(low, high) if high > low else low


def fetch_once(call: Callable[[str], dict], url: str, retries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The page that ``call(url)`` gives as (http_status, final_url, content_type, body), or an error row.

    Lost connections and answers from 500 on wait base ** attempt before the next attempt, 429 two powers longer;
    any other exception is an error at once.  Other answers below 500 are pages by their status.
    """
    error = "unknown error"
    for attempt in range(retries + 1):
        power = attempt
        try:
            answer = call(url)
        except Unreachable as lost:
            error = f"{type(lost).__name__}: {lost}"
        except Exception as failed:  # noqa: BLE001 - whatever a service raises becomes an error row
            return NO_PAGE | {"error": str(failed)}
        else:
            status = answer["http_status"]
            if status != 429 and status < 500:
                return NO_PAGE | answer | {"status": "ok", "error": ""}
            error = "HTTP 429 (rate limited)" if status == 429 else f"HTTP {status}"
            power = attempt + 2 if status == 429 else attempt
        if attempt < retries:
            sleep(base**power)
    return NO_PAGE | {"error": error}


def fetched(urls: DataFrame, make: Callable[[], Callable[[str], dict]], tasks: int = 3, threads: int = 5, delay: tuple[float, float] = (1.0, 2.0), **retry) -> DataFrame:
    """Rows (…, url) with the page of each; an address is asked for once, in ``tasks`` tasks of ``threads`` threads each.

    ``make`` gives the call in the worker; every thread rests for ``delay`` seconds after a request.
    """
    ship(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def one(url: str) -> dict:
            page = fetch_once(call, url, **retry)
            time.sleep(pause(*delay))
            return {"url": url} | page

        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                for start in range(0, len(frame), 64):
                    made = pd.DataFrame(list(pool.map(one, frame.url[start : start + 64])))
                    made["http_status"] = made["http_status"].astype("Int32")
                    yield made[["url", "status", "http_status", "final_url", "content_type", "body", "error"]]

    wanted = urls.select("url").where("url is not null and trim(url) <> ''").distinct().repartition(tasks)
    return urls.join(wanted.mapInPandas(run, f"url string, {PAGE}"), "url", "left")


def search_options(country: str = "", language: str = "", location: str = "", omitted: bool = False) -> dict:
    """What a search call gets besides the query: only what is set, and filter 0 where omitted results are wanted."""
    given = {"gl": country, "hl": language, "location": location}
    return {k: v for k, v in given.items() if v} | ({"filter": 0} if omitted else {})


def searched(queries: DataFrame, make: Callable[[], Callable[..., list[dict]]], tasks: int = 3, **options) -> DataFrame:
    """(doc_id, query_id, query, rank, title, url, snippet, error) of queries (doc_id, query_id, query, num_results).

    A query is sent once whatever documents ask it; one that fails gives a row with its error and no address.
    """
    ship(queries.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            rows = []
            for query, wanted in zip(frame["query"], frame.num_results):
                try:
                    hits = call(query, int(wanted), **options)
                    rows += [(query, wanted, at, h.get("title", ""), h.get("link") or h.get("url", ""), h.get("snippet", ""), "") for at, h in enumerate(hits, 1)]
                except Exception as failed:  # noqa: BLE001
                    rows.append((query, wanted, None, "", "", "", str(failed)))
            made = pd.DataFrame(rows, columns=["query", "num_results", "rank", "title", "url", "snippet", "error"])
            made["rank"] = made["rank"].astype("Int32")
            yield made

    sent = queries.select("query", "num_results").where("trim(query) <> ''").distinct().repartition(tasks)
    found = sent.mapInPandas(run, "query string, num_results int, rank int, title string, url string, snippet string, error string")
    return queries.join(found, ["query", "num_results"]).select("doc_id", "query_id", "query", "rank", "title", "url", "snippet", "error")


def call_with_retry(call: Callable[[list[str]], dict[str, str]], terms: list[str], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """What ``call`` gives for the terms; nothing after the last failed attempt."""
    for attempt in range(attempts):
        try:
            return call(terms)
        except Exception:  # noqa: BLE001
            if attempt + 1 < attempts:
                sleep(2**attempt)
    return {}


def translated_terms(terms: DataFrame, known: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, str]]] | None, normalize: Callable = T.normal_phrase, batch: int = 20, tasks: int = 2, rest: float = 1.0, **retry) -> tuple[DataFrame, DataFrame]:
    """Terms (term) with ``trans``, and the table (src_norm, tgt) with what was learnt.

    Terms are looked up by ``normalize``; an empty translation in the table is a hit.  Missing ones are made
    distinct and sent in batches; what the service does not answer is empty in the result and not in the table.
    """
    wanted = terms.withColumn("src_norm", normalize(F.col("term")))
    table = known.groupBy("src_norm").agg(F.min(F.coalesce("tgt", F.lit(""))).alias("tgt"))
    grown = table
    if make is not None:
        ship(terms.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, sent = make(), 0
            for frame in frames:
                names = list(frame.src_norm)
                for start in range(0, len(names), batch):
                    if sent:
                        time.sleep(rest)
                    sent += 1
                    answer = call_with_retry(call, part := names[start : start + batch], **retry)
                    yield pd.DataFrame([(n, answer[n]) for n in part if n in answer], columns=["src_norm", "tgt"])

        missing = wanted.select("src_norm").where("src_norm <> ''").distinct().join(table, "src_norm", "left_anti")
        grown = table.unionByName(missing.repartition(tasks).mapInPandas(run, "src_norm string, tgt string"))
    return wanted.join(grown, "src_norm", "left").select(*terms.columns, F.coalesce("tgt", F.lit("")).alias("trans")), grown
