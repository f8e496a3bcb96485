"""Main text of web pages: blocks judged by markup, and by a host's suffix array where markup does not tell.

A page is cut into blocks. Inside ``article`` or ``main`` blocks are content, inside menus, forms, asides and the like they
are not. The rest is open: there the token streams of a host's pages decide, those of articles too, on pages with an article as on
others. Neighbours in the suffix array of a host's streams that share a long prefix and come from different pages are boilerplate;
copies and near copies of a page, whatever their urls, are one page there. Every block of every page is searched for suffixes
whose first tokens an open block of the host has too, by a bitmap that lets some more pass: others decide nothing. Of these only
suffixes whose first tokens two pages share can have such a neighbour; a count, pre-aggregated so that a run of a third of all
pages is small before it is shuffled, leaves out the others. The rest is sorted into ranges, each in one task, whatever the size
of a host; the longest common prefixes of neighbours from different pages are the runs.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwise.llm.common import among, bitmap, stage
from topicwise.llm.graph import SALTS, lookup
from topicwise.llm.minhash import PRIME, Hashes, shingles
from topicwise.llm.similar import connect

# What the markup says; names of elements, and words of class, id and role values.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frameset head header iframe input label legend math menu meter nav "
    "noscript object optgroup option progress script search select style svg template textarea title video".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
NOT_CONTENT = frozenset(
    "ad ads adv advert advertisement advertisements advertising adverts adbox adslot banner breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies dialog disclaimer disqus footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification outbrain pager pagination popup promo promos promoted promotion recommended related replies "
    "reply respond search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription "
    "taboola tags teaser toc toolbar tooltip topbar widget widgets alert complementary contentinfo".split()
)
# Those that make no comment or aside part: an article inside is still one.
WRAPPERS = frozenset("fieldset form header".split())
ASIDE = frozenset(
    "ad ads adv advert advertisement advertisements advertising adverts adbox adslot comment comments disqus hidden outbrain promo promos promoted "
    "promotion recommended related replies reply respond sidebar sidebars sponsor sponsored sponsors taboola teaser widget widgets complementary".split()
)
# Class names of an element that holds an article, and words by which a name tells a state or layout, not what the element is.
HOLDERS = frozenset("article content entry hentry layout main page post story".split())
BEFORE = frozenset("has have hide no non not show with without".split())
AFTER = frozenset("active allowed closed collapsed disabled enabled expanded fixed free layout off on open opened page sticky".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements that an opening tag closes, if they are the innermost open ones of their kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Common pairs of words in 100 that make two pages of a host copies.
COPY_PERCENT = 90


def blocks(page: str | None) -> list[tuple[bool, str]]:
    """(open, text) of the blocks that markup does not drop, in page order. ``open``: not inside ``article`` or ``main``."""
    found: list[tuple[bool, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, dropped (0, 1 or 2, see _says_dropped), content
    page = page or ""

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((not (stack and stack[-1][2]), text))

    def text_until(end: int) -> None:
        if end > at and not (stack and stack[-1][1]):
            piece = page[at:end]
            parts.append(html.unescape(piece) if "&" in piece else piece)

    at, search = 0, 0
    while m := TOKEN.search(page, search):
        text_until(m.start())
        at = search = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCKS and (name in CONTENT or not (stack and stack[-1][1])):
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    # What goes with its parent does not end the block around that.
                    within = depth and stack[depth - 1][1] and stack[-1][1]
                    flush() if not within and any(s[0] in BLOCKS for s in stack[depth:]) else None
                    del stack[depth:]
                    break
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in CLOSES:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in CLOSES[name]:
                    del stack[depth:]
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if name == "p" or name in BLOCKS:
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "u", "font", "small") and any(s[0] == "p" for s in stack):
                stack.pop()
        dropped, content = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if dropped < 2:
            says = _says_dropped(m[3], content) if name not in ("html", "body") else 0
            if name in CONTENT:
                # An article starts content, also inside a wrapper that goes, unless that wrapper (or it itself in one) is an aside.
                if not dropped or says < 2:
                    dropped, content = 0, True
                else:
                    dropped = 2
            else:
                # A header inside the article is that of the article: its heading.
                if name in DROPPED and not (name == "header" and content):
                    says = max(says, 1 if name in WRAPPERS else 2)
                dropped = max(dropped, says)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = search = end.end() if end else len(page)
            continue
        stack.append((name, dropped, content))
    text_until(len(page))
    flush()
    return found


def _says_dropped(attributes: str, content: bool) -> int:
    """0: the element stays; 1: it goes, but an article inside stays; 2: all of it goes."""
    if not attributes or attributes.isspace():
        return 0
    says, holds = set(), False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2
        elif name in ("class", "id", "role"):
            for token in value.split():
                holds = holds or token.lower() in HOLDERS
                says |= _part_of(token)
    if not says - {"header"} and (content or not says):
        return 0
    return 2 if says & ASIDE else 0 if holds else 1


def _part_of(token: str) -> set[str]:
    """What a class, id or role name says that its element is: its last word or its first; not a state or layout of it."""
    words = [w.lower() for w in WORD.findall(token)]
    if not words or words[-1] in AFTER or BEFORE.intersection(words[:-1]):
        return set()
    return {words[0], words[-1]} & NOT_CONTENT


def host(url: str | None) -> str:
    """Host of a url in lower case, without user, port or a leading ``www.`` or ``m.``; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return re.sub(r"^(?:www|m)\.", "", m[1].lower()) if m else ""


def main_text(
    pages: DataFrame, *, run: int = 8, share: float = 0.5, depth: int = 16, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    ``text`` is the content blocks in page order, one line each. An open block goes when at least ``share`` of its tokens lie
    in runs of ``run`` tokens (a shorter block: all its tokens) that another page of the host has too, in an open block or inside
    its article; else it is content. Blocks inside an article stay. If the host has but one page, markup alone decides: open
    blocks go where there is an article, and stay elsewhere.
    Prefixes are compared up to ``depth`` tokens; a longer run goes on in the suffixes that begin in it. Null and empty pages
    have an empty text. Pages of a host with the same blocks are one page to the array, and so are those
    that a chain of near copies connects (Jaccard of pairs of words at least ``COPY_PERCENT``; all pages of the chain share first
    tokens with an open block), so copies do not condemn each other. Null urls are one host; other columns are ignored.
    """
    id_type = dict(pages.dtypes)[id_col]
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = stage(_parsed(source, id_type), "page-blocks")
    opened = parsed.filter("n_open > 0")
    searched = stage(_searched(parsed, bitmap(_places(opened, run)), run), "page-places")
    copies = _copies(searched, parsed)
    named = lookup(searched.drop("keys"), "page", copies, "id")
    found = repeated_prefixes(suffixes(named.withColumn("page", F.col("copies")), run, depth), run)
    # The union of a block's runs is counted from the gaps between them.
    covered = found.groupBy("row", "block").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("at"))
    covered = covered.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("block", "at"))).alias("covered"))
    judged = opened.join(covered, "row", "left").join(_alone(parsed, copies), "row", "left").withColumn("blocks", _kept(share))
    texts = parsed.filter("n_open = 0").select("page_id", "url", "blocks").unionByName(judged.select("page_id", "url", "blocks"))
    return texts.select("page_id", "url", F.array_join("blocks", "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def suffixes(pages: DataFrame, run: int, depth: int) -> DataFrame:
    """(row, page, host, block, at, open, suffix) for pages (row, page, host, codes): the suffixes of at least ``run`` tokens of each
    block, cut after ``depth`` of them. A shorter block is one suffix, with a 0 as its end. Pages may have ``open``, whether each
    block is, and ``places``, the only places in each block where suffixes are to begin."""
    open_, places = (F.col(c) if c in pages.columns else F.lit(None) for c in ("open", "places"))
    streams = pages.select("row", "page", "host", open_.alias("open"), places.alias("places"), F.posexplode("codes").alias("block", "stream"))
    ended = F.when(F.size("stream") < run, F.concat("stream", F.array(F.lit(0).cast("bigint")))).otherwise(F.col("stream"))
    at = F.sequence(F.lit(0), F.greatest(F.size("stream") - run, F.lit(0)))
    at, is_open = (F.expr("places[block]"), F.expr("open[block]")) if "places" in pages.columns else (at, F.lit(True))
    starts = streams.select("row", "page", "host", "block", is_open.alias("open"), ended.alias("stream"), F.explode(at).alias("at"))
    return starts.select("row", "page", "host", "block", "at", "open", F.expr(f"slice(stream, at + 1, {max(run, depth)})").alias("suffix"))


def repeated_prefixes(rows: DataFrame, run: int) -> DataFrame:
    """(row, block, at, n) of the suffixes of open blocks that begin like one of another page of their host: ``n`` tokens, at least
    ``run`` or all of a shorter block.

    The suffix array of each host is sorted by range, so many equal suffixes are dealt to many tasks; a suffix is compared with
    the nearest ones of another page before and after it. Where a range or a batch ends between them, ``n`` is the ``run``
    tokens that the count has found; the suffixes that follow it in the block tell the rest.
    """
    rows = rows.withColumn("code", F.xxhash64(F.slice("suffix", 1, run)))
    repeated = rows.groupBy("host", "code").agg(F.min("page").alias("x"), F.max("page").alias("y"), F.max("open").alias("open"))
    repeated = repeated.filter("x <> y AND open").select("host", "code")
    copies = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    array = stage(salted.join(copies, ["host", "code", "salt"]).drop("code", "salt"), "suffixes")
    order = ["host", "suffix", "page", "row", "block", "at"]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.maximum(common_prefixes(batch), np.minimum(_widths(batch), run))
                # The end sign of a short block is no token.
                n -= _last(batch) == 0
                found = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "block", "at")), pa.array(n.astype("int32"))], ["row", "block", "at", "n"])
                yield found.filter(batch.column("open"))

    array = array.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "open")
    return array.mapInArrow(neighbours, "row bigint, block int, at int, n int")


def common_prefixes(batch: pa.RecordBatch) -> np.ndarray:
    """Longest common prefix of each suffix with the nearest ones of another page of its host, for sorted (host, suffix, page)."""
    widths, page = _widths(batch), batch.column("page").to_numpy()
    host = batch.column("host").dictionary_encode().indices.to_numpy()
    tokens = np.zeros((len(widths), widths.max()), "int64")
    inside = np.arange(tokens.shape[1]) < widths[:, None]
    tokens[inside] = batch.column("suffix").flatten().to_numpy()
    # Rows of one page in a row look beyond them.
    starts = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (host[1:] != host[:-1])]))
    sizes = np.diff(starts, append=len(page))
    out = np.zeros(len(page), "int64")
    for other in (np.repeat(starts - 1, sizes), np.repeat(starts + sizes, sizes)):
        here = np.flatnonzero((other >= 0) & (other < len(page)))
        here = here[host[here] == host[other[here]]]
        same = (tokens[here] == tokens[other[here]]) & inside[here] & inside[other[here]]
        out[here] = np.maximum(out[here], np.logical_and.accumulate(same, axis=1).sum(axis=1))
    return out


def _widths(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("suffix").value_lengths().to_numpy()


def _last(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("suffix").flatten().to_numpy()[np.cumsum(_widths(batch)) - 1]


def _copies(searched: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, copies): the group of copies that each page of ``searched`` belongs to."""
    pages = searched.groupBy(F.col("page").alias("id")).agg(F.first("host").alias("host"), F.max("row").alias("row"), F.first("keys").alias("keys"))
    pages = stage(pages, "pages-searched")
    if not pages.limit(1).count():
        return pages.select("id", F.col("id").alias("copies"))
    tables = pages.select("id", "host", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("host", "band", "key").alias("table"), "id")

    def sets_of(ids: DataFrame) -> DataFrame:
        return parsed.select("row", "blocks").join(pages.join(ids, "id").select("id", "row"), "row").select("id", "blocks").mapInArrow(sets, "id bigint, items array<bigint>")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles("\n".join(b), 2).view("int64") for b in batch.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.list_(pa.int64()))], ["id", "items"])

    found = connect(tables, sets_of, COPY_PERCENT)
    return stage(pages.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("copies")), "pages-copies")


def _alone(parsed: DataFrame, copies: DataFrame) -> DataFrame:
    """(row, alone) of the pages with an article and open blocks whose host has but one page, copies aside."""
    pages = parsed.filter("size(blocks) > 0").select("host", "page").distinct().join(copies, F.col("page") == F.col("id"), "left")
    hosts = pages.groupBy("host").agg(F.min(F.coalesce("copies", "page")).alias("x"), F.max(F.coalesce("copies", "page")).alias("y"))
    mixed = parsed.filter("n_open > 0 AND n_open < size(blocks)").select("row", "host")
    return lookup(mixed, "host", stage(hosts.filter("x = y").select("host"), "hosts-alone"), "host").select("row", F.lit(True).alias("alone"))


def _kept(share: float):
    """Texts of the blocks that stay: those inside an article, and open ones covered less than ``share``, unless the page has an
    article and is alone."""
    tokens = "size(split(b, ' '))"
    overlap = "coalesce(covered[i], cast(array() as array<struct<at:int,n:int>>))"
    reach = "greatest(p.at + p.n, s.reach)"
    width = f"aggregate({overlap}, struct(0 AS n, 0 AS reach), (s, p) -> struct(s.n + {reach} - greatest(least(p.at, {reach}), s.reach) AS n, {reach} AS reach), s -> s.n)"
    return F.expr(f"filter(blocks, (b, i) -> NOT open[i] OR alone IS NULL AND (covered IS NULL OR {width} < {share} * {tokens}))")


def _parsed(source: DataFrame, id_type: str) -> DataFrame:
    """(row, page, page_id, url, host, blocks, open, n_open): all blocks, whether each is open, and how many are.

    ``page`` is a hash of the host and the blocks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                urls, htmls = part.column("url").to_pylist(), part.column("html").to_pylist()
                hosts, texts, opens, page = [], [], [], []
                for url, markup in zip(urls, htmls):
                    found = blocks(markup)
                    hosts.append(host(url))
                    texts.append([t for _, t in found])
                    opens.append([is_open for is_open, _ in found])
                    whole = "\n".join(texts[-1])
                    page.append(xxhash.xxh3_64_intdigest(f"{hosts[-1]}\n{whole}".encode("utf-8", "replace")) - (1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(page, pa.int64()), part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()),
                        pa.array(texts, pa.list_(pa.string())), pa.array(opens, pa.list_(pa.bool_())), pa.array(map(sum, opens), pa.int32()),
                    ],
                    ["page", "page_id", "url", "host", "blocks", "open", "n_open"],
                )

    schema = f"page bigint, page_id {id_type}, url string, host string, blocks array<string>, open array<boolean>, n_open int"
    return source.mapInArrow(rows, schema).withColumn("row", F.monotonically_increasing_id())


def _places(opened: DataFrame, run: int) -> DataFrame:
    """(hash): those of the places of open blocks, see ``_hashed``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            _, _, block, _, hashes = _hashed(part.column("host"), part.column("blocks"), run)
            is_open = part.column("open").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes[is_open[block]]).view("int64"))], ["hash"])

    return opened.select("host", "blocks", "open").mapInArrow(rows, "hash bigint")


def _searched(parsed: DataFrame, bits: np.ndarray, run: int) -> DataFrame:
    """(row, page, host, open, codes, places, keys) of the pages with places whose hashes are in ``bits``: the hashed tokens of the
    blocks that have such places, and the places. ``keys`` brings near copies together."""
    # At 90 of 100 a pair meets in one of 14 bands of 4 rows with probability 1 - 3e-7.
    copies = Hashes(7, 4, 29)
    shared = parsed.sparkSession.sparkContext.broadcast(bits)
    names = ["row", "page", "host", "open", "codes", "places", "keys"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            codes, n, block, at, hashes = _hashed(part.column("host"), part.column("blocks"), run)
            hit = among(shared.value, hashes)
            if not hit.any():
                continue
            block, at = block[hit], at[hit]
            n_places = np.bincount(block, minlength=len(n))
            n_blocks = part.column("blocks").value_lengths().to_numpy(zero_copy_only=False)
            page = np.repeat(np.arange(len(n_blocks)), n_blocks)
            some = np.unique(page[block])
            inside = np.isin(page, some)  # places stand in pages that stay, as do the tokens that are kept
            codes = codes[np.repeat(n_places > 0, n)].view("int64")
            lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32")), values)
            per_page = lambda sizes, values: lists(n_blocks[some], lists(sizes[inside], pa.array(values)))
            left = part.take(pa.array(some))
            keys = [copies.keys(shingles("\n".join(b), 2)).ravel() for b in left.column("blocks").to_pylist()]
            columns = [left.column(c) for c in names[:4]]
            columns += [per_page(np.where(n_places > 0, n, 0), codes), per_page(n_places, at.astype("int32")), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = "row bigint, page bigint, host string, open array<boolean>, codes array<array<bigint>>, places array<array<int>>, keys array<bigint>"
    return parsed.select("row", "page", "host", "blocks", "open").mapInArrow(rows, fields)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some hundred pages at a time, those without blocks aside."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            part = part.filter(pa.array(part.column("blocks").value_lengths().to_numpy(zero_copy_only=False) > 0))
            if part.num_rows:
                yield part


def _hashed(hosts: pa.Array, pages: pa.Array, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all blocks (none is 0) and their number in each block; block, place and hash of each suffix: of its
    host and its first ``run`` tokens, a shorter block's with its end."""
    words = [t.encode("utf-8", "replace").split(b" ") for t in pages.flatten().to_pylist()]
    n = np.fromiter(map(len, words), "int64", len(words))
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), "uint64", int(n.sum())) | np.uint64(1)
    # Zeros end a block.
    begins = np.cumsum(n + run) - n - run
    padded = np.zeros(int((n + run).sum()), "uint64")
    padded[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(len(codes))] = codes
    seeds = np.array([xxhash.xxh3_64_intdigest(h.encode("utf-8", "replace")) for h in hosts.to_pylist()], "uint64")
    seeds = np.repeat(seeds, pages.value_lengths().to_numpy(zero_copy_only=False))
    total = np.repeat(seeds, n + run)[: len(padded) - run + 1]
    for k in range(run):
        total = (total ^ padded[k : k + len(total)]) * PRIME
        total ^= total >> np.uint64(32)
    places = np.maximum(n - run + 1, 1)
    block = np.repeat(np.arange(len(n)), places)
    at = np.arange(len(block)) - np.repeat(np.cumsum(places) - places, places)
    return codes, n, block, at, total[begins[block] + at]
