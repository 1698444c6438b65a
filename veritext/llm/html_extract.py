"""Main text of web pages: page structure and a suffix array for each host.

A page becomes a stream of blocks, each in one of three zones: noise (menus,
page headers and footers, sidebars, notices, adverts, forms, comments, by tag,
role, class or id), article (inside an article, or else main, element) or open
(neither). The token streams of a host's pages are concatenated, a suffix array
with the longest common prefixes of neighbours is built, and tokens of runs of
MIN_RUN or more are marked by the number of different pages they stand on.

The text of a page is its article blocks, but for those that BOILER of the pages
of a host of MIN_HOST pages or more carry; a page without an article element
keeps the open blocks of which less than half stands on MIN_PAGES or more pages.
Repetition on fewer pages is no ground to cut an article (see README): articles
quote passages that other pages carry too.

Large hosts (over SHARD_CHARS of html, at most MAX_HOT of them, so that their list
stays small) are dealt over shards by a hash of the page's text, so equal pages meet.
The suffix array of each shard gives the runs that may decide a block and the pages
that carry them; the counts are summed over the shards of a host, and what the sum
leaves open is counted page by page. So the result doesn't depend on the shards.

Defined results: null html or html without text gives empty text and 0
characters; a url that is null or has no host forms one group with the others
of that kind; pages of equal text count as one page for repetition; repeated rows get
equal rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import Bitmap, Scratch, WordHashes, chunks, mix, signed, table

MIN_RUN, MIN_PAGES = 6, 3
#: Share of a host's pages that makes a run boilerplate even inside articles, and the pages a host needs for that.
BOILER, MIN_HOST = 0.5, 20
SHARD_CHARS, MAX_HOT = 3_000_000, 100_000
#: A shard of several gives the counts of runs on this share of its pages, to bound the host's count.
PROPOSED = BOILER / 2
#: Pages that a task remembers, to pass over their copies.
MAX_SEEN = 500_000
NOISE, OPEN, ARTICLE = 0, 1, 2
#: What a shard finds: its number of pages, runs of undecided pages, runs on many pages.
SHARD, REPEATED, BOILERPLATE = 0, 1, 2
#: Elements and name parts that hold no article text.
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select option label input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar nav navbar navigation menu menus breadcrumb breadcrumbs header footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments commentlist disqus reply replies widget widgets pagination pager copyright".split()
)
#: Words that mark noise beside any other word; the others need a class or id that says nothing else.
SURE_WORDS = frozenset("advert adverts advertisement advertising sponsored newsletter gdpr comments commentlist disqus".split())
PLAIN_WORDS = frozenset("site page main global top bottom left right box slot list section container wrapper wrap block area item items bar button buttons link links form user users primary secondary 1 2 3".split())
RAW_TAGS = "script|style|noscript|template|textarea|iframe|title|svg|object|canvas|audio|video"
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-z][^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([a-z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _noisy(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or attributes.isspace():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "role" and value in NOISE_ROLES) or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for one in value.split():
                parts = set(_PARTS.split(one)) - {""}
                if not SURE_WORDS.isdisjoint(parts):
                    return True
                # An inline element inside an article is a part of its sentence.
                alone = not NOISE_WORDS.isdisjoint(parts) and parts <= NOISE_WORDS | PLAIN_WORDS
                if alone and not (in_article and (tag not in BLOCK_TAGS or "header" in parts)):
                    return True
    return False


def page_blocks(html: str | None) -> list[tuple[str, int]]:
    """Blocks of a page in order: text with white space folded and references decoded, and zone."""
    html = html or ""
    blocks: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, zone, inside main
    opened: Counter = Counter()
    zone, in_main, buffer, at = OPEN, False, [], 0

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            blocks.append((text, zone, in_main))

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in BLOCK_TAGS:
                flush()
            if opened[tag]:  # an end tag without a start is passed over
                while stack:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == tag:
                        break
                after = stack[-1][1:] if stack else (OPEN, False)
                if zone != after[0]:
                    flush()
                zone, in_main = after
            continue
        if tag in BLOCK_TAGS:
            flush()
        elif tag in ("br", "td", "th"):
            buffer.append(" ")
        if tag in VOID_TAGS:
            continue
        new, main = zone, in_main
        if zone != NOISE:
            if _noisy(tag, m[4], zone == ARTICLE):
                new = NOISE
            elif tag == "article":
                new = ARTICLE
            elif tag == "main" or (m[4] and re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I)):
                main = True
        if new != zone:
            flush()
        stack.append((tag, new, main))
        opened[tag] += 1
        zone, in_main = new, main
    buffer.append(html[at:])
    flush()
    if not any(z == ARTICLE for _, z, _ in blocks):
        return [(t, ARTICLE if main and z == OPEN else z) for t, z, main in blocks]
    return [(t, z) for t, z, _ in blocks]


def suffix_array(tokens: np.ndarray, levels: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first 2**levels tokens, and the common prefix of each with the one before it (up to that length).

    Prefix doubling; the ranks of every level are kept and give the common
    prefixes by descending powers of two."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    ranks = [rank]
    for k in range(levels):
        ahead = np.concatenate([rank[1 << k :], np.zeros(min(1 << k, n), dtype=np.int64)])[:n]
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        ranks.append(rank)
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, dtype=np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(n - 1, dtype=np.int64)
        for k in range(levels, -1, -1):
            r = np.append(ranks[k], [0] * ((1 << levels) + 1))
            same = (np.maximum(a, b) < n) & (r[np.minimum(a, n)] == r[np.minimum(b, n)]) & (length + (1 << k) <= 1 << levels)
            length += same << k
            a += same << k
            b += same << k
        shared[1:] = length
    return order, shared


def run_groups(once: list[np.ndarray], min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of different pages end to end, the group of each place (places with equal next min_run tokens share one) and the number of pages of each group.

    A separator of its own stands after each page, so no group of several places crosses the end of a page."""
    flat = np.concatenate([np.append(s >> np.uint64(1), np.uint64(2**63 + k)) for k, s in enumerate(once)])
    page = np.repeat(np.arange(len(once)), [len(s) + 1 for s in once])
    order, shared = suffix_array(flat)
    group = np.cumsum(shared < min_run)
    pairs = np.unique(group * np.int64(len(once)) + page[order])
    many = np.bincount(pairs // len(once), minlength=group[-1] + 1)
    at = np.empty(len(flat), dtype=np.int64)
    at[order] = group
    return flat, at, many


def run_cover(starts: np.ndarray, n: int, min_run: int = MIN_RUN) -> np.ndarray:
    """Which of n tokens lie in runs with these starts."""
    edge = np.zeros(n + min_run + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + min_run, -1)
    return np.cumsum(edge)[:n] > 0


def least_pages(pages: int) -> float:
    """Pages that must carry a run for it to be boilerplate on a host of so many different pages."""
    return max(MIN_PAGES, BOILER * pages) if pages >= MIN_HOST else pages + 1


def repeated_tokens(streams: list[np.ndarray], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token stream of a whole host's pages (all in memory; `extract` sums over shards), which tokens lie in runs that stand on several different pages, and which on BOILER of all."""
    kinds: dict[bytes, int] = {}
    kind = [kinds.setdefault(s.tobytes(), len(kinds)) for s in streams]
    if len(kinds) < min_pages:
        none = [np.zeros(len(s), dtype=bool) for s in streams]
        return none, none
    first = {k: i for i, k in reversed(list(enumerate(kind)))}
    once = [streams[first[k]] for k in range(len(kinds))]  # equal pages count once
    flat, at, many = run_groups(once, min_run)
    ends = np.cumsum([len(s) + 1 for s in once])
    out = []
    for least in (min_pages, max(min_pages, least_pages(len(once)))):
        covered = run_cover(np.flatnonzero(many[at] >= least), len(flat), min_run)
        out.append([covered[ends[k] - len(once[k]) - 1 : ends[k] - 1] for k in kind])
    return out[0], out[1]


def shard_runs(once: list[np.ndarray], few: list[np.ndarray], article: list[np.ndarray], host: int, lone: bool) -> tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Runs of a shard that may decide a block, by its suffix array: (kind, hashes, pages, whether a run touches an article).

    once: the shard's different pages; few, article: which of their tokens stand
    in open blocks of undecided pages and in article blocks. lone: the host has
    no other shard, so its counts are the host's. Also returned: the pages that
    a run not given as BOILERPLATE may have here at most."""
    n, share = len(once), least_pages(len(once)) if lone else PROPOSED * len(once)
    missed = max(0, int(np.ceil(share)) - 1)
    ask = any(x.any() for x in few)
    if lone and (n < MIN_PAGES or (n < MIN_HOST and not ask)):
        return missed, []
    flat, at, many = run_groups(once)
    whole = np.concatenate([np.arange(len(s) + 1) + MIN_RUN <= len(s) for s in once])  # starts of runs that end within their page

    def touched(masks):
        tokens = np.concatenate([np.append(m, False) for m in masks])
        ahead = np.cumsum(np.concatenate([[0], tokens, np.zeros(MIN_RUN, dtype=np.int64)]))
        return np.bincount(at[whole & (ahead[MIN_RUN : MIN_RUN + len(flat)] > ahead[: len(flat)])], minlength=len(many)) > 0

    start = np.full(len(many), -1)
    start[at[whole]] = np.flatnonzero(whole)
    in_article = touched(article)
    out = []
    for kind, chosen in (REPEATED, touched(few) & (many >= (MIN_PAGES if lone else 1))), (BOILERPLATE, (start >= 0) & (many > missed) & (in_article | (not lone))):
        chosen = np.flatnonzero(chosen)
        total = np.full(len(chosen), np.int64(host).view(np.uint64), dtype=np.uint64)
        for k in range(MIN_RUN):
            total = mix(total + flat[start[chosen] + k])
        out.append((kind, signed(total), many[chosen], in_article[chosen]))
    return missed, out


def undecided(zones: list[int]) -> bool:
    """Whether a page has open blocks and no article block, so that repetition decides it."""
    return OPEN in zones and ARTICLE not in zones


def main_text(blocks: list[tuple[str, int]], repeated: np.ndarray, boiler: np.ndarray) -> tuple[str, int, int]:
    """The text of a page, and how many article and open blocks repetition took from it and left to it."""
    has_article = any(z == ARTICLE for _, z in blocks)
    kept, at, cut, asked = [], 0, 0, 0
    for text, zone in blocks:
        n = len(text.split(" "))
        if zone == ARTICLE or (zone == OPEN and not has_article):
            gone = boiler[at : at + n].all() if zone == ARTICLE else 2 * repeated[at : at + n].sum() >= n
            asked += 1
            cut += bool(gone)
            if not gone:
                kept.append(text)
        at += n
    return "\n\n".join(kept), cut, asked


def _stream(texts: list[str], hashes: WordHashes) -> np.ndarray:
    return hashes.of(" ".join(texts).split(" ")) if texts else np.empty(0, dtype=np.uint64)


def run_hashes(stream: np.ndarray, host: int) -> np.ndarray:
    """A hash of each run of MIN_RUN tokens of a page, of its own for each host."""
    n = max(0, len(stream) - MIN_RUN + 1)
    total = np.full(n, np.int64(host).view(np.uint64), dtype=np.uint64)
    for k in range(MIN_RUN):
        total = mix(total + (stream[k : k + n] >> np.uint64(1)))
    return total


def _settled(found: DataFrame, held, scratch: Scratch) -> DataFrame:
    """(host, kind, run): the runs on enough pages of their host, of those its shards found.

    found: as `count` in extract. A shard that did not give a run has it on at
    most `missed` pages, so the sum over shards bounds the pages of the host from
    both sides; held(test) gives (run, place) for the runs that this leaves open,
    which are counted page by page."""
    hosts = found.where(F.col("kind") == SHARD).groupBy("host").agg(F.sum("n").alias("pages"), F.sum("missed").alias("all_missed"), F.count(F.lit(1)).alias("shards"))
    sums = found.where(F.col("kind") != SHARD).groupBy("host", "kind", "run").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed"), F.count(F.lit(1)).alias("seen"), F.max("article").alias("article")).join(hosts, "host")
    most, few = F.col("kind") == BOILERPLATE, F.lit(MIN_PAGES).cast("long")
    least = F.when(most, F.greatest(few, F.ceil(F.col("pages") * BOILER))).otherwise(few)
    # A shard that did not give a run may have it in an article.
    matters = ~most | ((F.col("pages") >= MIN_HOST) & (F.col("article") | (F.col("seen") < F.col("shards"))))
    open_pages = F.when(most, F.col("all_missed") - F.col("missed")).when(F.col("shards") > 1, F.col("pages")).otherwise(0)
    sums = scratch.write(sums.where(matters).select("host", "kind", "run", "n", least.alias("least"), open_pages.alias("more")).where("n + more >= least"), "sums")
    sure = sums.where("n >= least").select("host", "kind", "run")
    unsure = sums.where("n < least")
    if unsure.isEmpty():
        return sure
    test = Bitmap(found.sparkSession, unsure, "run").test()
    exact = held(test).distinct().join(unsure.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("exact"))
    return scratch.write(sure.unionByName(unsure.join(exact, "run").where("exact >= least").select("host", "kind", "run")), "settled")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_blocks, n_cut (blocks that repetition took) and n_asked (blocks it was asked about) per page."""
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract(url_col, "://([^/?#]*)", 1), F.lit("")))
    sizes = pages.groupBy(host.alias("host")).agg(F.sum(F.coalesce(F.length(html_col), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("n") > SHARD_CHARS)
    shards_of = {r["host"]: (-(-r["n"] // SHARD_CHARS), r["rows"]) for r in sizes.orderBy(F.desc("n"), "host").limit(MAX_HOT).collect()}
    shards_of = spark.sparkContext.broadcast(shards_of)
    scratch = Scratch(spark, "html")
    inner = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), F.xxhash64(host).alias("where"), F.xxhash64(host, F.coalesce(html_col, F.lit(""))).alias("key"))
    kind = inner.schema["id"].dataType
    shape = f"`{id_col}` {kind.simpleString()}, `{url_col}` string, text string, n_chars long, n_blocks long, n_cut long, n_asked long"

    def parse(batches):
        """Different pages of a task. Pages of equal text meet in one shard."""
        shards, seen = shards_of.value, set()
        for batch in chunks(batches, 0):
            rows = []
            for html, where, name in zip(*(batch.column(k).to_pylist() for k in range(3))):
                blocks = page_blocks(html)
                text, zones, lengths = " ".join(t for t, _ in blocks), [z for _, z in blocks], [t.count(" ") + 1 for t, _ in blocks]
                same = xxhash.xxh3_128_digest(repr((name, text, zones, lengths)))
                if same in seen:
                    continue
                if len(seen) >= MAX_SEEN:
                    seen.clear()
                seen.add(same)
                place = xxhash.xxh3_64_intdigest(text)
                n = shards.get(name, (1, 0))[0]
                rows.append((name, place % n, place - 2**63, where, n == 1, text, zones, lengths))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "salt", "place", "where", "lone", "text", "zones", "lengths"])

    def count(batches):
        hashes, shards = WordHashes(), shards_of.value

        def shard(rows, name, where, lone):
            once, few, article = [], [], []
            for stream, open_tokens, article_tokens in rows.values():
                once.append(stream)
                few.append(open_tokens)
                article.append(article_tokens)
            missed, runs = shard_runs(once, few, article, where, lone)
            if not lone and shards[name][1] < MIN_HOST:
                runs = [r for r in runs if r[0] != BOILERPLATE]
            runs = [(SHARD, np.zeros(1, dtype=np.int64), np.array([len(once)]), np.zeros(1, dtype=bool)), *runs]
            n = sum(len(r[1]) for r in runs)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(name, n), pa.array(np.repeat([r[0] for r in runs], [len(r[1]) for r in runs]), pa.int8()), *(pa.array(np.concatenate([r[k] for r in runs]), t) for k, t in ((1, pa.int64()), (2, pa.int64()))), pa.repeat(pa.scalar(missed, pa.int64()), n), pa.array(np.concatenate([r[3] for r in runs]))],
                ["host", "kind", "run", "n", "missed", "article"],
            )

        rows, key = {}, None
        for batch in chunks(batches, 5):
            for name, salt, where, lone, text, zones, lengths in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7))):
                if key and key[:2] != (name, salt):
                    yield shard(rows, key[0], *key[2:])
                    rows = {}
                key = (name, salt, where, lone)
                stream = _stream([text] if zones else [], hashes)
                tokens = np.repeat(np.array(zones, dtype=np.int8), np.array(lengths, dtype=np.int64))
                old = rows.setdefault(stream.tobytes(), (stream, np.zeros(len(stream), dtype=bool), np.zeros(len(stream), dtype=bool)))
                if undecided(zones):
                    old[1][tokens == OPEN] = True
                old[2][tokens == ARTICLE] = True
        if key:
            yield shard(rows, key[0], *key[2:])

    def runs_held(test, only_undecided):
        """Hashes of the tested runs of each page: with the page's key if it is undecided, else with the hash of its text if its host has several shards."""
        def run(batches):
            hashes, shards, seen = WordHashes(), shards_of.value, set()
            for batch in chunks(batches, 0):
                runs, pages_of = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
                for html, where, name, key in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    if key in seen or (not only_undecided and name not in shards):
                        continue
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(key)
                    blocks = page_blocks(html)
                    if only_undecided and not undecided([z for _, z in blocks]):
                        continue
                    texts = [t for t, _ in blocks]
                    own = np.unique(run_hashes(_stream(texts, hashes), where))
                    own = signed(own[test(own)])
                    runs.append(own)
                    pages_of.append(np.full(len(own), key if only_undecided else xxhash.xxh3_64_intdigest(" ".join(texts)) - 2**63, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs)), pa.array(np.concatenate(pages_of))], ["run", "page"])

        return inner.select("html", "where", "host", "key").mapInArrow(run, "run long, page long")

    def finish(batches):
        hashes = WordHashes()
        for batch in chunks(batches, 2):
            texts = []
            for html, where, boiler, again in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                blocks = page_blocks(html)
                runs = again if undecided([z for _, z in blocks]) else boiler
                if runs:
                    stream = _stream([t for t, _ in blocks], hashes)
                    gone = run_cover(np.flatnonzero(np.isin(signed(run_hashes(stream, where)), np.array(runs, dtype=np.int64))), len(stream))
                else:
                    gone = np.zeros(sum(t.count(" ") + 1 for t, _ in blocks), dtype=bool)
                texts.append((*main_text(blocks, gone, gone), len(blocks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t[0] for t in texts], pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t[0]) for t in texts], [t[3] for t in texts], [t[1] for t in texts], [t[2] for t in texts]))],
                [id_col, url_col, "text", "n_chars", "n_blocks", "n_cut", "n_asked"],
            )

    parsed = inner.select("html", "where", "host").mapInArrow(parse, "host string, salt int, place long, where long, lone boolean, text string, zones array<tinyint>, lengths array<int>")
    dealt = parsed.repartition("host", "salt").sortWithinPartitions("host", "salt", "place")
    found = scratch.write(dealt.mapInArrow(count, "host string, kind tinyint, run long, n long, missed long, article boolean"), "found")
    settled = _settled(found, lambda test: runs_held(test, False), scratch)
    kinds = {r["kind"] for r in settled.select("kind").distinct().collect()}
    boiler = again = F.lit(None).cast("array<long>")
    if BOILERPLATE in kinds:
        of_host = settled.where(F.col("kind") == BOILERPLATE).groupBy("host").agg(F.collect_list("run").alias("boiler"))
        inner, boiler = inner.join(scratch.write(of_host, "boiler"), "host", "left"), F.col("boiler")
    if REPEATED in kinds:
        runs = settled.where(F.col("kind") == REPEATED).select("run")
        of_page = runs_held(Bitmap(spark, runs, "run").test(), True).distinct().join(runs, "run").groupBy(F.col("page").alias("key")).agg(F.collect_list("run").alias("again"))
        inner, again = inner.join(scratch.write(of_page, "again"), "key", "left"), F.col("again")
    return inner.select("id", "url", "html", "where", boiler.alias("boiler"), again.alias("again")).mapInArrow(finish, shape)


def op10_html_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
