"""Main text of web pages: the suffix array of each host's token streams, with markup as evidence.

A page's text is cut into blocks by its tags. Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments that their tags, classes or roles name go, and where a page marks its article, the article's blocks are left. The token streams of a
host's pages, all blocks in page order, are laid end to end, their suffixes sorted by the first `run` tokens; suffixes that share these stand
side by side. Where such tokens stand outside articles on a third of the host's distinct pages or more they are boilerplate, and blocks
that boilerplate covers go too, on every page. What is left are the unique runs.

A large host's pages are dealt out by a hash in parts of some hundred, each with an array of its own, so the largest host is spread over all
tasks and no part outgrows its memory. How many of the host's distinct pages hold a run is counted over all its parts beforehand, so the text
of a page doesn't depend on how its host was dealt out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored

#: Attributes: a quote opens a value only after "=", and a value without its second quote ends with the tag.
REST = r"(?:[^>=]++|=\s*+\"[^\"<]*+\"|=\s*+'[^'<]*+'|=)*+"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|select|title)\b{REST}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>{REST})(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements that are blocks; those without an end; those that are never main text.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("aside button dialog footer form head menu nav".split())
#: Words in a class, id or role that name what isn't main text.
NAMED = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus pagination pager toolbar complementary contentinfo search".split()
)
SITE = {"header", "masthead"}
HEADING = set("h1 h2 h3 h4 h5 h6".split())


def _named(rest: str, whole: bool = False) -> tuple[set[str], bool]:
    """Words of class, id and role (whole: the names in class and role as they are), and whether the element is hidden."""
    words, hidden = set(), False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), next(filter(None, values), "")
        if whole:
            words |= set(value.lower().split()) if name in ("class", "role") else set()
        elif name in ("class", "id", "role"):
            words |= {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w}
        hidden |= name == "hidden" or (name == "aria-hidden" and value == "true")
    return words, hidden


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, place, dropped) of each block in page order; place: 2 inside an article, 1 inside a main element, 0 elsewhere."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []
    held: list[str] = []
    place, dropped = 0, False

    def close() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, place, dropped))
            held.clear()

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCK and (name in VOID or not m["rest"].strip() and name not in NEVER):
            if m["end"]:
                if not any(s[0] == name for s in stack):
                    continue
            else:
                if stack and name not in VOID and any(s[0] == name for s in stack):
                    stack.append((name, place, dropped))
                continue
        if m["end"]:
            if name in BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close()
                    _, place, dropped = stack[k]
                    del stack[k:]
                    break
            continue
        # inside an article a slug may speak of what the text is about
        words, hidden = _named(m["rest"], place == 2) if m["rest"].strip() else ((), False)
        if name in BLOCK:
            close()
            # a paragraph ends where the next block begins
            if stack and stack[-1][0] == "p":
                _, place, dropped = stack.pop()
        now = 2 if name == "article" else max(place, 1) if name == "main" or "main" in words and name in BLOCK else place
        off = dropped or hidden or name in NEVER or (now == 0 or place == 0) and (name == "header" or any(w in SITE for w in words)) or any(w in NAMED for w in words) and name not in ("html", "body") and not (place == 2 and name in HEADING)
        if name not in VOID and (name in BLOCK or name in NEVER or off != dropped):
            if name not in BLOCK and off != dropped:
                close()
            stack.append((name, place, dropped))
            place, dropped = now, off
    if at < len(page):
        held.append(entities.unescape(page[at:]))
    close()
    return out


def host_of(url: F.Column) -> F.Column:
    """The host of an address with or without its scheme, in lower case; null: the empty one."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?([^/?#]*)", 1)


READ = "page_id bigint, url string, host string, part int, texts array<string>, places array<int>, known array<bigint>"
#: Pages of a part of a host; hosts of more than a part that are broadcast at most; share of a part's distinct pages that makes boilerplate.
PAGES, BROADCAST, SHARE = 500, 10_000, 1 / 3


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a page's blocks, and the place of each, less 3 if dropped."""
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            found = [blocks(page or "") for page in batch["html"].to_pylist()]
            texts, places = [[t for t, *_ in x] for x in found], [[p - 3 * off for _, p, off in x] for x in found]
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())), none], names=["page_id", "url", "host", "part", "texts", "places", "known"])


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of each `run` tokens in a row, from the tokens' hashes."""
    n = max(0, len(tokens) - run + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = (out ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _outside(run: int):
    """(host, page, runs): a digest of each page's blocks and places, and the hashes of its different runs outside articles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                digests, runs = [], []
                for page in batch["html"].to_pylist():
                    found, parts, line = blocks(page or ""), [], []
                    for text, place, off in [*found, ("", 1, False)]:
                        if place - 3 * off <= 0:
                            line += text.split(" ")
                        elif line:
                            tokens = np.array([hashes[w] if w in hashes else hashes.setdefault(w, token_hash(w)) for w in line], np.uint64)
                            parts.append(run_hashes(tokens, run))
                            line = []
                    if len(hashes) > 500_000:
                        hashes.clear()
                    digests.append(xxhash.xxh3_128_digest(repr([(t, p - 3 * off) for t, p, off in found]).encode("utf-8", "surrogatepass")))
                    runs.append(np.unique(np.concatenate(parts)).tobytes() if parts else b"")
                yield pa.RecordBatch.from_arrays([batch["host"], pa.array(digests, pa.binary()), pa.array(runs, pa.binary())], names=["host", "page", "runs"])

    return read


def token_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, run, n) of distinct pages, added up as far as a task sees them; run null: the pages themselves."""
    for batch in batches:
        rows: dict[str, list[bytes]] = {}
        for host, runs in zip(batch["host"].to_pylist(), batch["runs"].to_pylist()):
            rows.setdefault(host, []).append(runs)
        for host, many in rows.items():
            run, n = np.unique(np.frombuffer(b"".join(many), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([host] * (len(run) + 1), pa.string()), pa.array([None, *run.tolist()], pa.int64()), pa.array([len(many), *n.tolist()], pa.int64())], names=["host", "run", "n"])


def host_runs(rows: DataFrame, run: int) -> DataFrame:
    """(host, known): the hashes of runs that stand outside articles on SHARE of all the host's distinct pages, on two at least.

    Rows (host, html). A page holds no more runs than tokens, so no host has more of these than three pages have tokens.
    """
    distinct = rows.select("host", "html").mapInArrow(_outside(run), "host string, page binary, runs binary").groupBy("host", "page").agg(F.first("runs").alias("runs"))
    counted = distinct.select("host", "runs").mapInArrow(_counted, "host string, run bigint, n bigint").groupBy("host", "run").agg(F.sum("n").alias("n"))
    counted = stored(counted.where("run IS NULL OR n > 1"), "runs")
    pages = counted.where("run IS NULL").select("host", F.greatest(F.lit(2), F.ceil(F.col("n") * F.lit(SHARE))).alias("enough"))
    return pages.join(counted.where("run IS NOT NULL"), "host", "left").groupBy("host").agg(F.collect_list(F.when(F.col("n") >= F.col("enough"), F.col("run"))).alias("known"))


def suffix_ranks(stream: np.ndarray, run: int) -> np.ndarray:
    """The place of each suffix among all suffixes sorted by their first `run` tokens, equal where these are equal.

    Ranks by one token are doubled to two, four ... tokens; run is put together from these. Behind the end stands -1.
    """
    rank, length = np.unique(stream, return_inverse=True)[1], 1
    out, have = None, 0

    def paired(a: np.ndarray, by: int, b: np.ndarray) -> np.ndarray:
        after = np.append(b[by:], np.full(min(by, len(b)), -1))
        return np.unique(a * (int(b.max(initial=0)) + 2) + after + 1, return_inverse=True)[1]

    while True:
        if run & length:
            out, have = (rank, length) if out is None else (paired(out, have, rank), have + length)
        if have == run:
            return out
        rank, length = paired(rank, length, rank), 2 * length


def boilerplate(pages: list[tuple[list[str], list[int]]], run: int, known: np.ndarray | None = None) -> list[list[bool]]:
    """Which blocks of each page (texts, places) of a host are covered to four fifths or more by runs of tokens that stand outside articles on SHARE of the distinct pages.

    Pages with equal texts are one page. Two distinct pages at least must share a run. known: the hashes of such runs, where the pages are a part of a host.
    """
    words = [[t.split(" ") for t in texts] for texts, _ in pages]
    number: dict[str, int] = {}
    stream, page, outside, block = [], [], [], []
    copies: dict[tuple, int] = {}
    for k, ((texts, places), lines) in enumerate(zip(pages, words)):
        same = copies.setdefault((tuple(texts), tuple(places)), k)
        for b, (line, place) in enumerate(zip(lines, places)):
            stream += [number.setdefault(w, len(number)) for w in line]
            outside += [place <= 0] * len(line)
            block += [b] * len(line)
            page += [same] * len(line)
        # each page ends in a token of its own, with which no run is shared
        stream.append(-1 - k), outside.append(False), block.append(-1), page.append(same)
    stream, outside, page = np.array(stream, np.int64), np.array(outside, bool), np.array(page, np.int64)
    if not len(number) or known is None and len(copies) < 2:
        return [[False] * len(texts) for texts, _ in pages]
    rank = suffix_ranks(stream, run)
    n = int(page.max()) + 1
    sums = np.append(0, np.cumsum(outside))
    outside = sums[np.minimum(np.arange(len(stream)) + run, len(stream))] - sums[:-1] == run  # all of a run, not its first token alone
    if known is None:
        counts = np.bincount(np.unique(rank[outside] * n + page[outside]) // n, minlength=int(rank.max()) + 1)
        often = counts >= max(2, int(np.ceil(SHARE * len(copies))))
    else:
        # one suffix of each rank tells whether its run is known; what crosses the end of a page isn't outside
        ranks, first = np.unique(rank[outside], return_index=True)
        hashes = np.array([token_hash(w) for w in number], np.uint64)
        at = np.flatnonzero(outside)[first]
        often = np.zeros(int(rank.max()) + 1, bool)
        if len(at):
            often[ranks] = np.isin(run_hashes(hashes[np.maximum(stream, 0)], run)[at].view(np.int64), known)
    begins = np.flatnonzero(often[rank])
    change = np.bincount(begins, minlength=len(stream) + 1)[: len(stream) + 1] - np.bincount(np.minimum(begins + run, len(stream)), minlength=len(stream) + 1)
    covered = np.cumsum(change)[: len(stream)] > 0
    out, at = [], 0
    for lines in words:
        flags = []
        for line in lines:
            flags.append(bool(line) and covered[at : at + len(line)].sum() >= 0.8 * len(line))
            at += len(line)
        out.append(flags)
        at += 1
    return out


def page_text(texts: list[str], places: list[int], repeated: list[bool]) -> tuple[str, int]:
    """The text of a page, and how many blocks went as boilerplate that markup had left.

    Blocks of the article, or else of the main element, or else all that aren't dropped; in an article or main element that is boilerplate as a whole it stays.
    """
    best = max(places, default=0)
    kept = [k for k, p in enumerate(places) if p == max(best, 0)]
    own = [k for k in kept if not repeated[k]]
    if best > 0 and not own:
        own = kept
    return "\n".join(texts[k] for k in own), len(kept) - len(own)


def _decided(run: int):
    """Rows sorted by host and part, the host's known runs first: the text of each page of a part."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, runs = [], None, None

        def out() -> pa.RecordBatch:
            pages = [(t, p) for _, _, t, p in held]
            found = [page_text(t, p, r) for (t, p), r in zip(pages, boilerplate(pages, run, runs))]
            columns = [[x[0] for x in held], [x[1] for x in held], [t for t, _ in found], [n for _, n in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "text", "repeated"])

        for batch in batches:
            for host, part, known, *row in zip(*(batch[c].to_pylist() for c in ("host", "part", "known", "page_id", "url", "texts", "places"))):
                if (host, part) != at:
                    if held:
                        yield out()
                    held, at, runs = [], (host, part), None
                if known is not None:
                    runs = np.array(known, np.int64)
                else:
                    held.append(row)
        if held:
            yield out()

    return decide


def main_text(pages: DataFrame, run: int = 6) -> DataFrame:
    """(page_id, url, text, repeated) of every row, from its whole html. Null html, and pages without main text: an empty text.

    run: tokens that must repeat on distinct pages of a host (no url: of the empty host) to be boilerplate. repeated: how many blocks went
    by that alone. Repeated rows are one page to the array and get a row each, as do rows without a page_id. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = rows_of(pages, page_id="bigint", url="string", html="string").withColumn("host", host_of(F.col("url")))
    large = rows.groupBy("host").count().where(F.col("count") > PAGES).select("host", F.ceil(F.col("count") / PAGES).cast("int").alias("parts"))
    some = large.limit(BROADCAST + 1).collect()
    if some:
        known = F.broadcast(spark.createDataFrame(some, large.schema)) if len(some) <= BROADCAST else large
        rows = rows.join(known, "host", "left")
    else:
        rows = rows.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")
    read = rows.select("page_id", "url", "host", part.alias("part"), "html").mapInArrow(_read, READ)
    if some:
        each = host_runs(rows.where("parts IS NOT NULL"), run).join(known, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "known")
        read = read.unionByName(each, allowMissingColumns=True)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read.repartition(n, "host", "part").sortWithinPartitions("host", "part", F.col("known").isNull(), "page_id").mapInArrow(_decided(run), "page_id bigint, url string, text string, repeated bigint")
