"""Web records as data sources: one partition per date range, retries inside the reader."""

from __future__ import annotations

import json
import re
import time
from calendar import monthrange
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records beyond which a service refuses to skip.
MOST_SKIPPED = 25_000


class Span(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end

    def halves(self) -> list[Span]:
        """Two ranges of days (yyyymmdd) that make up this one; none of a single day."""
        a, b = (datetime.strptime(x, "%Y%m%d").date() for x in (self.start, self.end))
        if a >= b:
            return []
        middle = a + (b - a) // 2
        return [Span(self.start, f"{middle:%Y%m%d}"), Span(f"{middle + timedelta(days=1):%Y%m%d}", self.end)]


def fetch(url: str, tries: int = 4, wait: float = 2.0, opened=urlopen) -> tuple[dict | None, str | None]:
    """A page's JSON and its Link header; None for 404. 429 and 5xx are tried again after a linear wait."""
    for i in range(tries):
        try:
            with opened(url) as r:
                return json.load(r), r.headers.get("Link")
        except HTTPError as e:
            if e.code == 404:
                return None, None
            if e.code != 429 and e.code < 500 or i == tries - 1:
                raise
            time.sleep(wait * (i + 1))
    raise ValueError("no tries")


#: A link of a Link header: an address in angle brackets and parameters, whose values may be quoted.
LINK = re.compile(r"""<([^>]*)>((?:\s*;\s*[\w*-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[^\s;,"']*))?)*)""")
PARAMETER = re.compile(r""";\s*([\w*-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s;,"']*)))?""")


def next_page(link: str | None) -> str | None:
    """Address of the first link of the relation next; addresses and quoted values may hold commas."""
    for address, more in LINK.findall(link or ""):
        for name, *values in PARAMETER.findall(more):
            if name.lower() == "rel" and "next" in "".join(values).lower().split():
                return address
    return None


class PagedReader(DataSourceReader):
    """Options: url (with {start}, {end}, {skip}, {limit}), spans ('a:b,c:d'), limit, wait; cursor=true follows Link headers.

    A range of days with over MOST_SKIPPED records, by the total that the first page tells, is read as its halves; a
    single day of so many fails.
    """

    def __init__(self, options: dict):
        self.url, self.limit = options["url"], int(options.get("limit", "1000"))
        self.spans = [s.split(":") for s in options.get("spans", ":").split(",")]
        self.cursor = options.get("cursor", "false") == "true"
        self.most, self.wait = int(options.get("most", str(MOST_SKIPPED))), float(options.get("wait", "2"))

    def partitions(self) -> list[Span]:
        return [Span(*s) for s in self.spans]

    def read(self, partition: Span) -> Iterator[tuple]:
        url, skip = self._at(partition, 0), 0
        while url:
            page, link = fetch(url, wait=self.wait)
            rows = (page or {}).get("results", [])
            total = (page or {}).get("meta", {}).get("results", {}).get("total", 0)
            if not self.cursor and skip == 0 and total > self.most:
                halves = partition.halves() if partition.start else []
                if not halves:
                    raise ValueError(f"{total} records in one range: {url}")
                for half in halves:
                    yield from self.read(half)
                return
            yield from ((json.dumps(r),) for r in rows)
            skip += len(rows)
            if self.cursor:
                url = next_page(link) if rows else None
            else:
                url = self._at(partition, skip) if len(rows) == self.limit else None

    def _at(self, span: Span, skip: int) -> str:
        return self.url.format(start=span.start, end=span.end, skip=skip, limit=self.limit)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class CountedReader(DataSourceReader):
    """Options: url (with {start}, {end}), first and last ('2018-Q1'), wait. One partition per quarter."""

    def __init__(self, options: dict):
        self.url, self.wait = options["url"], float(options.get("wait", "2"))
        a, b = (int(x[:4]) * 4 + int(x[-1]) - 1 for x in (options["first"], options["last"]))
        self.quarters = range(a, b + 1)

    def partitions(self) -> list[Span]:
        out = []
        for q in self.quarters:
            year, month = q // 4, q % 4 * 3 + 1
            out.append(Span(f"{year}{month:02d}01", f"{year}{month + 2:02d}{monthrange(year, month + 2)[1]}"))
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        page, _ = fetch(self.url.format(start=partition.start, end=partition.end), wait=self.wait)
        month = date(int(partition.start[:4]), int(partition.start[4:6]) + 1, 1)
        yield from ((month, r.get("term", ""), int(r.get("count", 0))) for r in (page or {}).get("results", []))


class CountedSource(DataSource):
    """Counts that the service itself makes for each quarter, stamped on its middle month."""

    @classmethod
    def name(cls) -> str:
        return "counted_json"

    def schema(self) -> str:
        return "month date, term string, n long"

    def reader(self, schema) -> CountedReader:
        return CountedReader(self.options)
