"""HTML extraction with nearest-URL page differencing.

A page becomes lines: the text of each block element, with the place it stands in (the article, page furniture such as navigation, headers, footers,
sidebars, notices, adverts, forms and comments, or neither). Pages of a host are ordered by URL path; each is paired with that neighbour whose path
shares the longer beginning; pages of a host with equal lines are copies and stand there once. The two pages' lines are aligned by a longest common subsequence.

Shared lines are what the site repeats. They are deleted outside the article. Inside it they are deleted where a class or role names them furniture, or where
the site repeats them on ``SITE_SHARE`` of its pages (and ``SITE_PAGES`` at least), since articles of one site may share passages. Furniture elements, and
outside the article whatever is named furniture, are left out in any case.

Pairs come from row numbers over (host, path) and neighbours in small chunks of numbers, so a host with a third of all pages is spread over all tasks;
only keys are ordered, and digests of a page's lines move to the page that is compared with it.

Cases: null or empty HTML has no text; a host's only page is compared with none; equal URLs are ordered by page id; a null URL stands in a group of its
own host ''; repeated rows give one result each; an empty table gives an empty result; other columns are not read; unclosed elements end with their parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm.urls import host_of, path_of
from pixelquarry.llm.words import lists
from pixelquarry.operators.scaling import broadcast_if_small, join_hot_keys, number_rows, shifted
from pixelquarry.session import materialise

#: Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg iframe canvas audio video select textarea button".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr big strike".split())
#: Class, id or role tokens that name page furniture: one of these words, alone or together with words of place and form only.
NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist respond disqus related share sharing social widget popup modal complementary contentinfo".split())
PLACES = frozenset("site page global main top bottom left right primary secondary box bar block list area links buttons icons section wrapper wrap container inner slot unit form".split())
#: Elements that names never make furniture of.
WHOLE = frozenset("html body main".split())
CHUNK = 64

#: Furniture by name inside an article: deleted if shared.
ARTICLE, FURNISHED, PLAIN, DOUBTED = 1, 2, 0, 3
#: A line inside articles is the site's own if more than this share of its different pages has it, and so many pages at least.
SITE_SHARE, SITE_PAGES = 0.5, 5
#: Bits that the alignment of two pages keeps at once.
ROW_BITS = 1 << 29
BROADCAST_PAGES = 500_000


def names_furniture(names: str) -> bool:
    for token in names.lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        if token == "side-bar" or all(x in NAMES or x in PLACES for x in parts) and any(x in NAMES for x in parts):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of a page in order, as (kind, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = [("", PLAIN, False)]  # element, kind, unseen
        self.lines: list[tuple[int, str]] = []
        self.now: list[str] = []

    def close_line(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.lines.append((self.open[-1][1], text))
        self.now = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.now.append(" ") if tag == "br" else self.close_line()
            return
        if tag not in INLINE:
            self.close_line()
            at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] not in INLINE), 0)
            if self.open[at][0] == "p" or tag == "li" and self.open[at][0] == "li":
                del self.open[at:]
        _, kind, unseen = self.open[-1]
        inside = kind in (ARTICLE, DOUBTED)  # there an id is an anchor, and a header is the article's own
        names = " ".join(v for k, v in attrs if v and k in (("class", "role") if inside else ("class", "id", "role")))
        named = tag not in WHOLE and names_furniture(names)
        if kind != FURNISHED:
            if tag in FURNITURE and not (inside and tag == "header"):
                kind = FURNISHED
                self.close_line() if tag in INLINE else None
            elif named:
                kind = DOUBTED if inside else FURNISHED
                self.close_line() if tag in INLINE else None
            elif tag in ("article", "main"):
                kind = ARTICLE
        elif tag in ("article", "main") and not named and not any(x[0] in FURNITURE and x[0] != "form" for x in self.open):
            kind = ARTICLE  # a wrapper's name does not reach into the article
        if any(k in ("hidden",) for k, _ in attrs):
            unseen = True
        self.open.append((tag, kind, unseen or tag in UNSEEN))

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if any(x[0] not in INLINE for x in self.open[i:]) or self.open[i][1] != self.open[i - 1][1]:
                    self.close_line()
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.now.append(data)


def page_lines(html: str | None) -> list[tuple[int, str]]:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.close_line()
    return parser.lines


def _steps(a: list, masks: dict, full: int) -> Iterator[int]:
    """Rows of the alignment table by bits: place j is 0 where the common length grows at j. One step a line, whatever lines repeat."""
    row = full
    for x in a:
        met = row & masks.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def _masks(b: list) -> dict:
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    out = {}
    for x, places in where.items():
        raw = bytearray(len(b) // 8 + 1)
        for j in places:
            raw[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(raw, "little")
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Common length of all of ``a`` with every beginning of ``b``."""
    row = full = (1 << len(b)) - 1
    for row in _steps(a, _masks(b), full):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(bits == 0))


def _aligned(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > ROW_BITS:  # halves of a, with b cut where they have most in common
        half = len(a) // 2
        at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:at]) + [half + i for i in _aligned(a[half:], b[at:])]
    rows = list(_steps(a, _masks(b), (1 << len(b)) - 1))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; work and memory are bounded also where lines repeat."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    also = set(b)
    own = [i for i in range(lead, len(a) - tail) if a[i] in also]
    there = set(a)
    middle = _aligned([a[i] for i in own], [x for x in b[lead : len(b) - tail] if x in there])
    return [*range(lead), *(own[i] for i in middle), *range(len(a) - tail, len(a))]


def main_text(lines: list[tuple[int, str]], shared: set[int], sitewide: set[int] = frozenset()) -> tuple[str, int]:
    """Text of a page, and how many of its shared lines are not in it."""
    kept, deleted = [], 0
    for i, (kind, text) in enumerate(lines):
        if kind == FURNISHED or i in shared and (kind != ARTICLE or i in sitewide):
            deleted += i in shared
        else:
            kept.append(text)
    return " ".join(kept), deleted


def nearest_pages(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, other: for each key the neighbour within its host whose path shares the longer beginning (the one before, if both share as much)."""
    keys = pages.select("key", "host", "path", "page_id")
    numbered = number_rows(keys, ["host"], [F.col("path"), F.col("page_id"), F.col("key")])
    near = shifted(numbered, ["host"], {"key_a": ("key", -1), "path_a": ("path", -1), "key_b": ("key", 1), "path_b": ("path", 1)}, chunk_rows=chunk)

    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if x is None or y is None:
                out.append(-1)
                continue
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            out.append(n)
        return pa.array(out, pa.int32())

    length = F.arrow_udf(shared, "int")
    before, after = length("path", "path_a"), length("path", "path_b")
    other = F.when(F.col("n_a") >= F.col("n_b"), F.col("key_a")).otherwise(F.col("key_b"))
    return near.withColumn("n_a", before).withColumn("n_b", after).groupBy("key").agg(F.min(other).alias("other"))


def shared_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key (a hash of id, URL and HTML), the places of the lines that a page shares with its nearest one, and which of them the site repeats, for pages that
    share any."""

    def digests(column: pa.Array) -> pa.Array:
        lines = [np.array([xxhash.xxh3_64_intdigest(t) for _, t in page_lines(x.as_py())], np.uint64).view(np.int64) for x in column]
        return lists(np.concatenate([np.zeros(0, np.int64), *lines]), np.array([len(x) for x in lines], np.int64), pa.int64())

    facts = pages.select(
        F.xxhash64(page_id, url, html).alias("key"), F.col(page_id).alias("page_id"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"), F.arrow_udf(digests, "array<bigint>")(F.col(html)).alias("lines"),
    )
    facts = materialise(facts.withColumn("same", F.xxhash64("lines")))
    first = F.min_by(F.struct("path", "page_id", "key"), F.struct("path", F.col("page_id"), "key"))
    firsts = materialise(facts.groupBy("host", "same").agg(first.alias("p")).select("host", "same", "p.*"))  # copies tell nothing of each other
    near = nearest_pages(firsts).filter("other IS NOT NULL")
    lines = facts.join(firsts.select("host", "same", "key"), ["host", "same", "key"], "left_semi").select("key", "lines").dropDuplicates(["key"])
    pairs = near.join(lines, "key").join(lines.select(F.col("key").alias("other"), F.col("lines").alias("other_lines")), "other")

    def common(own: pa.Array, other: pa.Array) -> pa.Array:
        found = [common_lines(a.as_py(), b.as_py()) for a, b in zip(own, other, strict=True)]
        return pa.array(found, pa.list_(pa.int32()))

    found = materialise(pairs.select("key", F.arrow_udf(common, "array<int>")("lines", "other_lines").alias("shared")).filter(F.size("shared") > 0))
    # only lines that some neighbours share can be the site's own; each page counts a line once
    sharing = found.join(lines, "key").join(firsts.select("key", "host", "same"), "key")
    n_pages = firsts.groupBy("host").agg(F.count("*").alias("n_pages"))
    counted = sharing.select("host", F.explode(F.expr("array_distinct(transform(shared, i -> lines[i]))")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    own = counted.join(n_pages, "host").filter((F.col("n") > SITE_SHARE * F.col("n_pages")) & (F.col("n") >= SITE_PAGES)).select("host", "line")
    met = join_hot_keys(sharing.select("key", "host", F.explode(F.expr("transform(shared, i -> struct(i AS at, lines[i] AS line))")).alias("s")).select("key", "host", "s.*"), own, ["host", "line"], "inner")
    sitewide = met.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("sitewide"))
    found = firsts.join(found, "key").join(sitewide, "key", "left").select("host", "same", "shared", F.coalesce("sitewide", F.array().cast("array<int>")).alias("sitewide"))
    return join_hot_keys(facts.select("key", "host", "same").distinct(), found, ["host", "same"], "inner").select("key", "shared", "sitewide")


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared, n_deleted, for each row.

    Pages are compared by digests of their lines; their texts don't move, unless more than ``BROADCAST_PAGES`` pages share lines.
    """
    shared = materialise(shared_lines(pages, page_id, url, html))

    def read(column: pa.Array, places: pa.Array, everywhere: pa.Array) -> pa.Array:
        out = []
        for body, own, site in zip(column, places, everywhere, strict=True):
            lines, met = page_lines(body.as_py()), set(own.as_py() or ())
            text, deleted = main_text(lines, met, set(site.as_py() or ()))
            out.append({"text": text, "n_lines": len(lines), "n_shared": len(met), "n_deleted": deleted})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64()), ("n_deleted", pa.int64())]))

    base = pages.select(F.xxhash64(page_id, url, html).alias("key"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    met = base.join(broadcast_if_small(shared, BROADCAST_PAGES), "key", "left")
    done = met.select("page_id", "url", F.arrow_udf(read, "struct<text: string, n_lines: bigint, n_shared: bigint, n_deleted: bigint>")("html", "shared", "sitewide").alias("d"))
    return done.select("page_id", "url", "d.text", F.char_length("d.text").cast("bigint").alias("n_chars"), "d.n_lines", "d.n_shared", "d.n_deleted")
