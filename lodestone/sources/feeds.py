"""Atom feeds in pages as a Python data source: a batch or a stream of entries, following `next` links.

    spark.dataSource.register(FeedSource)
    spark.read.format("feed").option("urls", json.dumps([...])).load()

A feed is a partition, and a page is fetched where it is read. A stream counts the pages of each feed: it begins with what is there and goes on when
the last page names a next one. `fetch` reads http(s) and file addresses; another way to fetch is a subclass.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ENTRIES = "feed string, page string, page_no int, entry_no int, id string, title string, summary string, authors array<string>, href string, type string, links array<struct<href:string,type:string>>"
#: Types that are acquisitions whatever their relation says, best first, and the relation that says it.
ACQUIRED, RELATION = ("application/epub+zip", "application/pdf", "text/html", "text/plain"), "http://opds-spec.org/acquisition"
#: Bytes that are read at once, bytes of a page without an entry that ends, pages of a feed.
PIECE, MOST_BYTES, MOST_PAGES = 1 << 16, 8 << 20, 10_000


def fetch(url: str) -> Iterator[bytes]:
    """The body behind an address in pieces, whole; of a folder, that of its parts in turn."""
    from urllib.request import urlopen

    if urlsplit(url).scheme not in ("http", "https", "file"):
        raise ValueError(f"no address to fetch: {url}")
    return _pieces(url, urlopen)


def _pieces(url: str, urlopen) -> Iterator[bytes]:
    if urlsplit(url).scheme == "file":
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(url)
        if system.get_file_info(path).type == fs.FileType.Directory:  # a page as Spark writes it
            for part in sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("part-")):
                with system.open_input_stream(part) as body:
                    yield from iter(lambda body=body: body.read(PIECE), b"")
            return
    with urlopen(url, timeout=30) as body:  # noqa: S310
        yield from iter(lambda: body.read(PIECE), b"")


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element, *path: str) -> list[str]:
    found = [node]
    for name in path:
        found = [c for x in found for c in x if _plain(c.tag) == name]
    return [(x.text or "").strip() for x in found]


def _address(base: str, href: str | None) -> str | None:
    """href against its page; null where it is empty or leads to no address of the page's kinds."""
    if not (href or "").strip():
        return None
    out = urljoin(base, href.strip())
    return out if urlsplit(out).scheme in ("http", "https", "file") else None


def entries_of(url: str, body: bytes | Iterable[bytes]) -> Iterator[tuple | str]:
    """Entries of a page of a feed as its pieces come: (id, title, summary, authors, href, type, links), with the best acquisition link, null without any; and, as a
    string, the address of each next page that is named. An entry is dropped once it is read, so a page may be of any size; what is no feed, or shows no end of an entry for
    MOST_BYTES, is an error."""
    parser, root, depth, unread = ElementTree.XMLPullParser(("start", "end")), None, 0, 0
    try:
        for piece in (body,) if isinstance(body, bytes) else body:
            parser.feed(piece)
            unread += len(piece)
            for event, node in parser.read_events():
                if event == "start":
                    depth += 1
                    if root is None:
                        root = node
                        if _plain(root.tag) != "feed":
                            raise ValueError(f"{url}: not a feed")
                    continue
                depth -= 1
                if depth != 1:
                    continue
                unread, name = 0, _plain(node.tag)
                if name == "link" and node.get("rel") == "next":
                    after = _address(url, node.get("href"))
                    if after:
                        yield after
                if name == "entry":
                    yield _entry(url, node)
                root.clear()
            if unread > MOST_BYTES and not isinstance(body, bytes):
                raise ValueError(f"{url}: an entry of more than {MOST_BYTES} bytes")
        parser.close()
    except ElementTree.ParseError as e:
        raise ValueError(f"{url}: not a feed") from e


def _entry(url: str, node: ElementTree.Element) -> tuple:
    links = []
    for x in node:
        rel, kind = x.get("rel") or "", x.get("type")
        if _plain(x.tag) == "link" and (rel == RELATION or rel.startswith(RELATION + "/") or kind in ACQUIRED):
            href = _address(url, x.get("href"))
            if href:
                links.append((href, kind))
    best = min(links, key=lambda x: ACQUIRED.index(x[1]) if x[1] in ACQUIRED else len(ACQUIRED), default=(None, None))
    first = lambda *path: next(iter(_texts(node, *path)), None)
    return first("id"), first("title"), first("summary"), [a for a in _texts(node, "author", "name") if a], *best, links


def parsed(url: str, body: bytes | Iterable[bytes]) -> tuple[list[tuple], str | None]:
    """(entries, next page) of a page of a feed."""
    found = list(entries_of(url, body))
    return [x for x in found if not isinstance(x, str)], next((x for x in reversed(found) if isinstance(x, str)), None)


@dataclass
class Pages(InputPartition):
    """Pages first .. last (exclusive, -1: to the end) of a feed; url is that of page `first`."""

    feed: str
    url: str
    first: int
    last: int


class _Reading:
    def __init__(self, options: dict, get) -> None:
        self.urls, self.fetch = list(dict.fromkeys(json.loads(options["urls"]))), get

    def walked(self, url: str, most: int = MOST_PAGES) -> Iterator[tuple[int, str, tuple | None]]:
        """(number, address, entry) of the entries of a page and of those that follow it, each page once; a page begins with the entry None."""
        seen: set[str] = set()
        while url and url not in seen and len(seen) < most:
            n, own, after = len(seen), url, None
            seen.add(url)
            yield n, own, None
            for x in entries_of(own, self.fetch(own)):
                if isinstance(x, str):
                    after = x
                else:
                    yield n, own, x
            url = after

    def read(self, partition: Pages) -> Iterator[tuple]:
        most, k = MOST_PAGES if partition.last < 0 else partition.last - partition.first, 0
        for n, page, entry in self.walked(partition.url, most):
            if entry is None:
                k = 0
                continue
            yield (partition.feed, page, partition.first + n, k, *entry)
            k += 1


class FeedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return [Pages(u, u, 0, -1) for u in self.urls]


class FeedStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the numbers of pages of each feed."""

    def __init__(self, options: dict, get) -> None:
        super().__init__(options, get)
        self.pages: dict[str, list[str]] = {}

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.urls, 0)

    def latestOffset(self) -> dict:
        for u in self.urls:  # the last known page may name a next one by now
            known = self.pages.setdefault(u, [])
            ahead = [page for _, page, entry in self.walked(known[-1] if known else u) if entry is None]
            known += [p for p in ahead if p not in known]
        return {u: len(p) for u, p in self.pages.items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if any(len(self.pages.get(u, [])) < n for u, n in end.items()):
            self.latestOffset()
        return [Pages(u, self.pages[u][start.get(u, 0)], start.get(u, 0), n) for u, n in end.items() if n > start.get(u, 0)]

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Option urls: a JSON list of the first pages of feeds."""

    get = staticmethod(fetch)

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options, self.get)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options, self.get)
