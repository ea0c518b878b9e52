"""Main text of web pages: structure first, then runs that a host repeats across its pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rosterforge.llm.shared import staged

RUN = 8  # tokens of the shortest repeated run that counts
PAGES, SHARE = 3, 0.5  # a run is boilerplate on at least so many different pages and on this share of the host's
COVERED = 0.9  # share of a block's words in such runs from which the block goes
DROPPED, OPEN, MAIN, ARTICLE = -1, 0, 1, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROP_TAGS = frozenset("head title nav footer aside form script style noscript template iframe object svg canvas audio video button select option textarea dialog menu noembed noframes".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies share sharing social "
    "breadcrumb breadcrumbs related recommended pagination pager widget toolbar".split())
# A class word that opens a state (has-sidebar), and those that only say what kind of box holds the named thing (sidebar-left).
STATES = frozenset("has no with without is not".split())
HOLDERS = frozenset("area bar block bottom box button buttons col column container content form group holder inner item items left link links list main outer panel right row section slot top unit wrap wrapper".split())
SIZE = re.compile(r"\d+(?:x\d+)?")
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SELF_CLOSED = {"p": frozenset(), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def names_boilerplate(name: str) -> bool:
    """Whether a class or id names boilerplate: its last part does, apart from holders and sizes. States name nothing."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    while parts and parts[-1] not in DROP_WORDS and (parts[-1] in HOLDERS or SIZE.fullmatch(parts[-1])):
        parts.pop()
    return bool(parts) and parts[-1] in DROP_WORDS and parts[0] not in STATES


def element_kind(tag: str, attributes: str, inherited: int) -> int:
    """Whether text inside an element is dropped, open, main or article text."""
    if inherited == DROPPED or tag in DROP_TAGS:
        return DROPPED
    kind = {"main": MAIN, "article": ARTICLE}.get(tag, OPEN)
    if tag == "header" and inherited < MAIN:
        return DROPPED
    if attributes and tag not in ("html", "body"):
        given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
        names = unescape(f"{given.get('class', '')} {given.get('id', '')}").lower()
        words = set(re.split(r"[^a-z0-9]+", names))
        role = given.get("role", "").lower()
        # A main element stays whatever its classes; an article goes only if a whole class says what it is (a reader's comment).
        told = False if tag == "main" or role == "main" else not DROP_WORDS.isdisjoint(names.split()) if tag == "article" else any(map(names_boilerplate, names.split()))
        if told or role in DROP_ROLES or "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower():
            return DROPPED
        if "header" in words and inherited < MAIN and kind < MAIN:
            return DROPPED
        if role == "main":
            kind = MAIN
        if given.get("itemprop", "").lower() == "articlebody" or (words & {"article", "post", "entry", "story"} and words & {"body", "content", "text"}):
            kind = ARTICLE
    return max(kind, inherited)


def page_blocks(html: str | None) -> list[tuple[int, list[str]]]:
    """(kind, words) of the blocks of a page in order; unclosed and misnested tags are taken as browsers roughly do."""
    html = html or ""
    blocks: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    buffer: list[str] = []
    kind, at = OPEN, 0

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            words = (unescape(text) if "&" in text else text).split()
            if words:
                blocks.append((kind, words))
            buffer.clear()

    def close(tag: str) -> None:
        nonlocal kind
        while True:
            name, _ = stack.pop()
            opened[name] -= 1
            if name == tag:
                break
        now = stack[-1][1] if stack else OPEN
        if now != kind:
            flush()
            kind = now

    while (found := TAG.search(html, at)) is not None:
        if found.start() > at:
            buffer.append(html[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ending, attributes = found[1] or found[4], found[3] or found[6] or ""
        if tag not in INLINE:
            flush()
        if ending:
            if opened[tag]:
                close(tag)
            continue
        if tag not in INLINE and opened["p"] and stack and stack[-1][0] == "p":
            close("p")
        if tag in SELF_CLOSED and stack and stack[-1][0] in SELF_CLOSED[tag]:
            close(stack[-1][0])
        if tag in VOID:
            if tag == "br":
                buffer.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if attributes.endswith("/") and tag not in INLINE and not attributes.rstrip("/").strip():
            continue
        inner = element_kind(tag, attributes, kind)
        if inner != kind:
            flush()
            kind = inner
        stack.append((tag, inner))
        opened[tag] += 1
    buffer.append(html[at:])
    flush()
    return blocks


def fingerprint(host: str, words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join([host, *words]).encode("utf-8", "surrogatepass")) - (1 << 63)


def best_kind(blocks: list[tuple[int, list[str]]]) -> int:
    return max((k for k, _ in blocks), default=DROPPED)


def assembled(blocks: list[tuple[int, list[str]]], covered: set[int]) -> str:
    """Text of the kept blocks. Article and main text stays whole; ``covered`` holds start places of boilerplate runs of a page without any."""
    best = best_kind(blocks)
    if best == DROPPED:
        return ""
    if best != OPEN:
        return " ".join(w for k, words in blocks if k >= MAIN for w in words)
    gone = {p for at in covered for p in range(at, at + RUN)}
    kept, at = [], 0
    for k, words in blocks:
        if k == OPEN:
            if sum(p in gone for p in range(at, at + len(words))) < COVERED * len(words):
                kept += words
            at += len(words)
    return " ".join(kept)


def suffix_heads(host: str, blocks: list[tuple[int, list[str]]]) -> list[tuple[int, int]]:
    """(fingerprint, place or -1) of the suffix heads of a page's dropped and open text; places only where open text is all there is."""
    best, heads = best_kind(blocks), []
    for kind, words in blocks:
        if kind == DROPPED or kind == OPEN != best:
            heads += [(fingerprint(host, words[p:p + RUN]), -1) for p in range(len(words) - RUN + 1)]
    if best == OPEN:
        words = [w for k, part in blocks if k == OPEN for w in part]
        heads += [(fingerprint(host, words[p:p + RUN]), p) for p in range(len(words) - RUN + 1)]
    return heads


PARSED = pa.schema([("text", pa.string()), ("blocks", pa.list_(pa.string())), ("host", pa.string()), ("page", pa.int64()), ("heads", pa.list_(pa.struct([("fp", pa.int64()), ("place", pa.int64())])))])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece, out = batch.slice(at, 256), []
            for url, html in zip(*(piece.column(c).to_pylist() for c in ("url", "html")), strict=True):
                blocks, host = page_blocks(html), host_of(url)
                page = fingerprint(host, [w for _, words in blocks for w in words]) if blocks else None
                told = [" ".join(words) for k, words in blocks if k == OPEN] if best_kind(blocks) == OPEN else None
                out.append({"text": assembled(blocks, set()) if told is None else None, "blocks": told, "host": host, "page": page, "heads": [dict(zip(("fp", "place"), h, strict=True)) for h in suffix_heads(host, blocks)]})
            made = pa.RecordBatch.from_pylist(out, PARSED)
            yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("id"), piece.column("url"), *made.columns], ["key", "id", "url", *PARSED.names])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [assembled([(OPEN, b.split()) for b in blocks], set(c or ())) for blocks, c in zip(batch.column("blocks").to_pylist(), batch.column("covered").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) per page.

    Blocks inside menus, page headers, footers, sidebars, notices, adverts, forms and comments go by structure. The
    token streams of a host's pages are then searched for runs of at least ``RUN`` tokens that occur on distinct
    pages. Instead of one suffix array per host, which would bind a host to one task, its intervals with a common
    prefix of ``RUN`` tokens are formed by grouping the suffix heads; their union covers exactly
    what all longer repeats cover. A run is boilerplate if at least ``PAGES`` pages of different words and ``SHARE`` of
    all such pages of the host hold it outside article and main text; what fewer pages share, two stories or edits of
    one, stays. A page without article or main element loses each block whose words such runs cover to ``COVERED``,
    however much of the page that is; other blocks stay whole. Text that structure marks as article or main text is
    never removed, whatever other pages of the host show.

    Null html gives an empty text. Null urls share one host without a name. Rows with a null or repeated key give a row each.
    Empty tables give no rows; other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("key", F.xxhash64("id", "url", "html"))
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, url string"
    parsed = staged(rows.select("key", "id", "url", "html").mapInArrow(_parsed, f"key long, {kinds}, text string, blocks array<string>, host string, page long, heads array<struct<fp:long,place:long>>"))
    heads = parsed.select("key", "page", F.explode("heads").alias("h")).select("key", "page", "h.*")
    common = heads.select("fp", "page").distinct().groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    sizes = parsed.where("page IS NOT NULL").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    own = parsed.select("key", "host").distinct().join(sizes, "host").select("key", "pages")
    covered = heads.where("place >= 0").join(common, "fp").join(own, "key").where(F.col("n") >= SHARE * F.col("pages")).groupBy("key").agg(F.collect_set("place").alias("covered"))
    cut = parsed.where("blocks IS NOT NULL").select("key", "id", "url", "blocks").join(covered, "key", "left").mapInArrow(_without, f"{kinds}, text string")
    told = parsed.where("blocks IS NULL").select("id", "url", "text").unionByName(cut)
    return told.select(F.col("id").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
