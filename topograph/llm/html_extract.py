"""HTML extraction: structure first, then a host suffix array for what structure leaves open.

A page's blocks are read in order. Blocks in menus, headers, footers, sidebars, forms, scripts, styles and the like, or in elements whose class, id or role
names such a part, are boilerplate. Where a page has an article (else a main element), its other blocks are the text, and everything outside is boilerplate. Where it
has neither, structure can't tell, and repetition decides: the token streams of all blocks outside articles are concatenated by host into a suffix array, whose order is
refined from RUN tokens by doubling, among the suffixes that still repeat, and spread over the executors by prefix. A run counts that is on SHARE of the host's distinct pages (PAGES
at least; on MOST of them from PROSE tokens on, as pages may share prose). An open block goes if runs of the greatest length that is RUN times a power of two and
COVERED of the block at most, so of about half of it or more, cover COVERED of it; a block of fewer than RUN tokens goes by runs that take in its neighbours. Others stay. A block
inside an article is never dropped for being repeated, as pages may share their text.

Defined cases: a null or empty html has an empty text; markup that is cut off ends with the page, and an unfinished tag is dropped; pages with equal html are one page to
the suffix array; a null url is a host of its own; a page of any length is read whole; repeated rows are extracted one by one; other columns are kept, and
columns named like result columns are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, letters_lower, map_texts, mix, widened
from .shingles import PLACE, word_hashes

#: Tokens of the shortest run, and the share of a block's tokens that runs have to cover.
RUN, COVERED = 4, 0.9
#: The share of a host's pages, and the number of them, on which a run is boilerplate; tokens from which it may be prose, and the share then.
SHARE, PAGES, PROSE, MOST = 0.1, 3, 32, 0.5
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S
)
# Kinds of HTML elements.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CHROME = frozenset("nav footer aside form head button select menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr sidebar menu navbar nav navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus notice notices notification popup modal newsletter subscribe subscription share sharing social related recommended widget toolbar pagination pager skip".split()
)
COMMENTS = frozenset(["comment", "comments", "disqus"])
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def hints(attributes: str, in_article: bool) -> set[str]:
    """Words of class, id and role that name a part that isn't the article."""
    out = set()
    for kind, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            out |= {value.lower()} & ROLES
        else:
            out |= {w.lower() for w in NAME.findall(value)} & HINTS
    return out - {"header"} if in_article else out


def read(page: str) -> tuple[list[str], list[str], list[bool]]:
    """Blocks of the article or main element, if any; all other blocks, and which of those structure leaves open."""
    stack: list[tuple[str, int]] = []  # element, and 1 boilerplate, 2 main, 4 article, 8 boilerplate whatever is inside, with what is around it
    now, held, begun = 0, [], False
    article, main, outside, is_open = [], [], [], []
    seen_article = seen_main = False

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            if now & 4 and not now & 1:
                article.append(text)
            elif now & 2 and not now & 1:
                main.append(text)
            else:
                outside.append(text)
                is_open.append(not now & 1)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        held.append(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not close:
            if not attributes.endswith("/"):
                last = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = last.end() if last else n
            held.append(" " if name in BLOCKS else "")
            continue
        if name == "br":
            held.append(" ")
            continue
        block = name in BLOCKS
        if block:
            end()
            if stack and stack[-1][0] == "p":
                stack.pop()
                now = stack[-1][1] if stack else 0
        if name in VOID or (not block and not attributes.strip() and not close):
            continue
        if close:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                if not block and now != (stack[k - 1][1] if k else 0):
                    end()
                del stack[k:]
                now = stack[-1][1] if stack else 0
        elif not attributes.endswith("/"):
            own = now
            if name in CHROME or (name == "header" and not now & 4):
                own |= 1 | 8
            elif attributes and name not in ("body", "html", "main") and (found := hints(attributes, bool(now & 4) or name == "article")):
                own |= 1 | (8 if name == "article" or found & COMMENTS else 0)
            if name == "article" or name == "main" or (attributes and re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I)):
                own |= 4 if name == "article" else 2
                if not own & 8:
                    own &= ~1  # a wrapper's class says less than the element itself
                seen_article |= name == "article" and not own & 1
                seen_main |= name != "article" and not own & 1
            if not block and own == now:
                continue
            if own != now:
                end()
            stack.append((name, own))
            now = own
    end()
    if seen_article:
        return article, outside + main, [False] * (len(outside) + len(main))
    if seen_main:
        return main, outside, [False] * len(outside)
    return [], outside, is_open


def parsed(pages: DataFrame, page: str) -> DataFrame:
    schema = widened(pages, text="string", outside="array<string>", is_open="array<boolean>")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, outside, is_open = [], [], []
        for t in batch.column(page).to_pylist():
            a, b, c = read(t or "")
            texts.append("\n".join(a)), outside.append(b), is_open.append(c)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(outside, pa.list_(pa.string())), pa.array(is_open, pa.list_(pa.bool_()))], names=[*batch.schema.names, "text", "outside", "is_open"])

    return map_texts(pages, page, run, schema, 4 << 20)


def suffixes(rows: DataFrame) -> DataFrame:
    """(host, page, open, place, prefix) of each suffix of a page's stream: the hash of its first RUN tokens. rows: host, page, open, stream."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = word_hashes(batch.column("stream"))
        counts = np.maximum(0, np.diff(at) - RUN + 1)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        h = np.zeros(len(row), np.uint64)
        for j in range(RUN):
            h += words[at[:-1][row] + place + j] * PLACE[j] if len(row) else h
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("host", "page", "open")), pa.array(place.astype(np.int32)), pa.array(mix(h).view(np.int64))], names=["host", "page", "open", "place", "prefix"])

    return map_texts(rows, "stream", run, "host string, page long, open boolean, place int, prefix long", 1 << 20)


def run_length(words: int) -> int:
    """Tokens of the runs that decide a block of so many."""
    n = RUN
    while 2 * n <= COVERED * words:
        n *= 2
    return n


def unique_blocks(rows: DataFrame) -> DataFrame:
    """rows (outside, is_open, runs: length and place of repeated ones): with the open blocks that runs don't cover as text."""
    schema = widened(rows.drop("outside", "is_open", "runs"), text="string")

    def run(batches):
        for batch in batches:
            texts = []
            for blocks, is_open, runs in zip(batch.column("outside").to_pylist(), batch.column("is_open").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words, at = word_hashes(pa.array(blocks, pa.string()))
                hit: dict[int, np.ndarray] = {}
                for r in runs or ():
                    own = hit.setdefault(r["length"], np.zeros(len(words) + 1, int))
                    own[r["place"]] += 1
                    own[min(r["place"] + r["length"], len(words))] -= 1
                covered = {n: np.concatenate([[0], np.cumsum(np.cumsum(h[:-1]) > 0)]) for n, h in hit.items()}
                kept = []
                for b, o, x, y in zip(blocks, is_open, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    c = covered.get(run_length(y - x))
                    if o and (c is None or c[y] - c[x] < COVERED * max(1, y - x)):
                        kept.append(b)
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("outside", "is_open", "runs")), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeated_runs(streams: DataFrame, longest: int) -> DataFrame:
    """(host, page, length, place) of the runs that repeat, on open pages; lengths are RUN doubled, up to what a block of longest tokens asks for. streams: host, page, open, stream."""
    hosts = streams.groupBy("host").agg(F.max("open").alias("any"), F.countDistinct("page").alias("pages")).filter("any").drop("any")
    hosts = cut(hosts, "hosts")
    own = streams.join(hosts.select("host"), "host", "left_semi").groupBy("host", "page").agg(F.max("open").alias("open"), F.first("stream").alias("stream"))
    suffix, length, out = cut(suffixes(own.select("host", "page", "open", "stream")), "suffixes"), RUN, None
    while True:
        least = F.greatest(F.lit(PAGES), F.ceil(F.col("pages") * (MOST if length >= PROSE else SHARE)))
        hot = suffix.groupBy("host", "prefix").agg(F.countDistinct("page").alias("n")).join(hosts, "host").filter(F.col("n") >= least).select("host", "prefix")
        left = cut(suffix.join(hot, ["host", "prefix"], "left_semi"), "suffixes")
        drop(suffix)
        found = left.filter("open").select("host", "page", F.lit(length).alias("length"), "place")
        out = found if out is None else out.union(found)
        if 2 * length > COVERED * longest or left.isEmpty():
            return out
        after = left.select("host", "page", (F.col("place") - length).alias("place"), F.col("prefix").alias("after_"))
        suffix = cut(left.join(after, ["host", "page", "place"]).select("host", "page", "open", "place", F.xxhash64("prefix", "after_").alias("prefix")), "suffixes")
        length *= 2


def extract(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """pages with text and n_chars, without the column of markup."""
    kept = pages.drop("text", "n_chars", "outside", "is_open", "runs", "host_", "page_")
    host = letters_lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = cut(parsed(kept.withColumns({"host_": host, "page_": F.xxhash64(F.col(f"`{page}`"))}), page).drop(page), "parsed")
    no_text = F.exists("is_open", lambda x: x)
    streams = rows.select(F.col("host_").alias("host"), F.col("page_").alias("page"), no_text.alias("open"), F.array_join("outside", " ").alias("stream"))
    open_rows = rows.filter(no_text)
    longest = open_rows.agg(F.max(F.array_max(F.transform("outside", F.char_length))).alias("n")).first()["n"]
    done = rows.filter(~no_text).drop("outside", "is_open")
    if longest is not None:  # else structure decides all pages
        runs = repeated_runs(streams, longest // 2 + 1).groupBy("host", "page").agg(F.collect_list(F.struct("length", "place")).alias("runs"))
        runs = runs.select(F.col("host").alias("host_"), F.col("page").alias("page_"), "runs")
        done = done.unionByName(unique_blocks(open_rows.drop("text").join(runs, ["host_", "page_"], "left")))
    return done.drop("host_", "page_").withColumn("n_chars", F.char_length("text").cast("long"))
