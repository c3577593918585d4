"""Main text of web pages: markup zones and repeated runs of tokens over the pages of each host.

A page is read once into blocks: runs of text between block-level tags, character references decoded, white space
made one space. The markup tells three zones apart: inside ``article`` or ``main``; in page furniture (``nav``,
``footer``, forms, elements whose class, id or role says advert, notice, comments and the like); and open ground.
A class counts as a whole (``with-sidebar`` and ``no-comments`` name no furniture), and where it names a part that also
gives layouts their names, as ``sidebar`` does, an ``article`` or ``main`` inside is still the main text. Hidden elements
are left out, inline ones too.

The blocks outside ``article`` and ``main`` are the token stream of a page. No suffix is sorted: the windows of
``LEAST_RUN`` tokens of all streams of a host are hashed, and a window that two different streams hold is repeated. A
token lies in a substring of ``LEAST_RUN`` tokens or more that two streams share exactly if it lies in such a window,
so the covered tokens are those that sorted suffixes would give. Shorter blocks, of ``LEAST_LINE`` tokens or more,
repeat as a whole or not at all, so a short phrase inside running prose stays. Covered tokens are boilerplate. What is left of open ground is kept as unique runs; what is left of furniture is dropped, and
blocks inside ``article`` and ``main`` are kept whole, so a reprinted article or a licence line in it stays.

A host that holds a third of all pages is spread like any other: of equal streams one chunk speaks; it sends each
head once, the others ask, and each chunk gets back the repeated ones of those it sent or asked about; see ``repeats``
for the exchange.

Defined results: a null or empty page has the empty text; a null address is a host of its own; rows with a null or
repeated id are pages of their own; pages with equal streams count as one page; a page without ``article`` or
``main`` whose stream is repeated almost whole is a reprint, and its open ground stays; a page cut off in the middle
ends there; an empty table gives an empty table; other columns of the input are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import U, mix, packed_sorted, unpacked_sorted
from .repeats import BUCKET_BYTES, CHUNK_BYTES, Steps, shared_of

#: tokens that a repeated substring has at least, and a shorter block that is repeated as a whole
LEAST_RUN, LEAST_LINE = 9, 6
#: a stream of so many tokens, repeated to this share, is a reprint
REPRINT_TOKENS, REPRINT_SHARE = 60, 0.8

MAIN, OPEN, FURNITURE = 0, 1, 2
#: inside an element whose class could as well describe the layout of the page: furniture, but for an article in it
WRAPPED = 3

#: fixed values: elements by what they do to the text
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe svg math object canvas audio video".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button select datalist fieldset head".split())
MAIN_TAGS = frozenset(("article", "main"))
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer gdpr hidden login masthead menu modal nav "
    "navbar navigation navi newsletter notice notification pager pagination popup popover promo promoted promotion "
    "recommended related replies respond search share sharing sidebar signup site-header skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar tracking widget".split())
LAYOUT_WORDS = frozenset("banner header masthead menu nav navbar navigation search sidebar topbar toolbar skip social widget".split())
#: fixed values: first parts of a class that say what a page has or lacks, and parts of classes of whole layouts
ABOUT = frozenset("with without no not has have is hide hidden show use enable disable".split())
WHOLE = frozenset("article body col column columns container content grid inner layout main outer page post row shell site story wrap wrapper".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().removeprefix("www.") if found else ""


def _hidden(attributes: str) -> bool:
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value)):
            return True
    return False


def _zone_of(attributes: str) -> int:
    """``FURNITURE``, ``WRAPPED`` or ``OPEN`` by the attributes of a block element."""
    if _hidden(attributes):
        return FURNITURE
    found = OPEN
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in FURNITURE_ROLES:
            return FURNITURE
        if name not in ("class", "id"):
            continue
        for token in value.split():
            parts = _WORD.findall(token)
            if not parts or parts[0] in ABOUT:
                continue
            named = {p for p in (token, parts[0], parts[-1]) if p in FURNITURE_WORDS}
            if named and not named <= LAYOUT_WORDS and WHOLE.isdisjoint(parts):
                return FURNITURE
            if named:
                found = WRAPPED
    return found


def blocks(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, with their zones."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = OPEN
    mute, depth = "", 0  # the hidden inline element that is open; it ends with its block at the latest

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, FURNITURE if zone == WRAPPED else zone))
        held.clear()

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        until = found.start() if found else end
        if until > at and not mute:
            held.append(html.unescape(page[at:until]))
        if not found:
            break
        at = found.end()
        tag = found[1]
        if tag is None:
            continue
        tag = tag.lower()
        closing = page[found.start() + 1] == "/"
        if not closing and tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            if tag not in INLINE:
                close()
            continue
        if tag in INLINE:
            # inline elements matter only where they are hidden; their text is part of the block
            if mute == tag:
                depth += -1 if closing else 1
                mute = mute if depth else ""
            elif not mute and not closing and tag not in VOID and found[2] and _hidden(found[2]):
                mute, depth = tag, 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        mute, depth = "", 0
        close()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    zone = stack[i][1]
                    del stack[i:]
                    break
            continue
        if found[2] is not None and found[2].rstrip().endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            zone = stack.pop()[1]
        stack.append((tag, zone))
        if zone != FURNITURE:
            own = _zone_of(found[2]) if found[2] and tag not in ("html", "body") else OPEN
            if tag in FURNITURE_TAGS or (tag == "header" and zone != MAIN):
                zone = FURNITURE
            elif tag in MAIN_TAGS:
                zone = FURNITURE if own == FURNITURE else MAIN
            elif own != OPEN:
                zone = own if zone != WRAPPED or own == FURNITURE else zone
    close()
    return out


def _read(pages: pd.DataFrame) -> Iterator[tuple]:
    """page_id, url, host, texts, zones of each page of a chunk."""
    for page_id, url, page in zip(pages["page_id"], pages["url"], pages["html"]):
        found = blocks(page)
        yield page_id, url, host_of(url), [t for t, _ in found], [z for _, z in found]


class _Streams:
    """The tokens of the blocks outside the main zone, and the hashes of their windows and short lines."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def token(self, word: str) -> int:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > 200_000:
                self.known.clear()
            import xxhash

            value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, host: str, texts, zones) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Token hashes, (block, from, to) of the blocks, head hashes, and from and to of what each head covers."""
        tokens: list[int] = []
        places = []
        for i, (text, zone) in enumerate(zip(texts, zones)):
            if zone != MAIN:
                a = len(tokens)
                tokens.extend(map(self.token, text.split(" ")))
                places.append((i, a, len(tokens)))
        values = np.array(tokens, U)
        start = np.array([a for _, a, b in places if LEAST_LINE <= b - a < LEAST_RUN], np.int64)
        size = np.array([b - a for _, a, b in places if LEAST_LINE <= b - a < LEAST_RUN], np.int64)
        n = max(0, len(values) - LEAST_RUN + 1)
        start, size = np.r_[np.arange(n), start], np.r_[np.full(n, LEAST_RUN), size]
        heads = np.full(len(start), self.token("host " + host), U)
        with np.errstate(over="ignore"):
            for j in range(LEAST_RUN):
                on = size > j
                heads[on] = mix(heads[on] * U(0x9E3779B97F4A7C15) + values[start[on] + j])
            heads = np.where(size < LEAST_RUN, mix(heads + size.astype(U)), heads)
        return values, places, heads, start, start + size


def _mark(values: np.ndarray, host: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(values.tobytes() + host.encode()) - (1 << 63)


def send_streams(pages: pd.DataFrame) -> pd.DataFrame:
    """The hash of each stream of a chunk, once."""
    streams = _Streams()
    marks = set()
    for _, _, host, texts, zones in _read(pages):
        values, _, heads, _, _ = streams.of(host, texts, zones)
        if len(heads):
            marks.add(_mark(values, host))
    return pd.DataFrame({"mark": np.array(sorted(marks), np.int64), "chunk": int(pages["chunk"].iloc[0])})


def send_heads(steps: Steps, pages: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """The heads of a chunk. Pages with equal streams are one page, also across chunks: ``others`` are the streams
    that another chunk speaks for. Their heads are asked for, but not counted."""
    streams = _Streams()
    silent, seen = set(others["mark"].tolist()), set()
    found, asked = [], []
    for _, _, host, texts, zones in _read(pages):
        values, _, heads, _, _ = streams.of(host, texts, zones)
        if len(heads) and (mark := _mark(values, host)) not in seen:
            seen.add(mark)
            (asked if mark in silent else found).append(np.unique(heads))
    columns = ["bucket", "chunk", "hashes", "several", "counted"]
    chunk, none = int(pages["chunk"].iloc[0]) if len(pages) else 0, np.empty(0, U)
    own = np.unique(np.concatenate([none, *found]))
    out = [steps.packed(found, chunk, 0).assign(counted=True)] if found else []
    only = np.setdiff1d(np.concatenate([none, *asked]), own)
    if len(only):
        out.append(steps.packed([only], chunk, 0).assign(counted=False))
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def find_repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the heads it asked about that two streams hold, anywhere."""
    counted = rows["counted"].to_numpy(bool)
    parts = [unpacked_sorted(x) for x in rows["hashes"]]
    h, which = np.unique(np.concatenate(parts), return_inverse=True)
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows["several"], parts)])
    spoken = np.repeat(counted, [len(p) for p in parts])
    holders = np.bincount(which, weights=spoken * (1 + several.astype(np.int64)), minlength=len(h))
    hit = (holders > 1)[which]
    held: dict[int, list[np.ndarray]] = {}
    at = 0
    for chunk, part in zip(rows["chunk"], parts):
        keep = part[hit[at:at + len(part)]]
        at += len(part)
        if len(keep):
            held.setdefault(int(chunk), []).append(keep)
    return pd.DataFrame([(c, packed_sorted(np.unique(np.concatenate(k)))) for c, k in held.items()], columns=["chunk", "hashes"])


def keep_unique(pages: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """The main text of each page of a chunk, given the repeated heads that it holds."""
    streams, repeated = _Streams(), shared_of(shared)
    out = []
    for page_id, url, host, texts, zones in _read(pages):
        values, places, heads, start, end = streams.of(host, texts, zones)
        covered = np.zeros(len(values) + 1, np.int64)
        if len(heads) and len(repeated):
            hit = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, heads), len(repeated) - 1)] == heads)
            np.add.at(covered, start[hit], 1)
            np.add.at(covered, end[hit], -1)
        gone = np.cumsum(covered[:-1]) > 0
        open_ = [(i, a, b) for i, a, b in places if zones[i] == OPEN]
        size = sum(b - a for _, a, b in open_)
        reprint = MAIN not in zones and size >= REPRINT_TOKENS and sum(int(gone[a:b].sum()) for _, a, b in open_) >= REPRINT_SHARE * size
        text_of = {}
        for i, a, b in open_:
            if reprint:
                text_of[i] = texts[i]
            else:
                words = texts[i].split(" ")
                text_of[i] = " ".join(w for w, g in zip(words, gone[a:b]) if not g)
        parts = [text if zone == MAIN else text_of.get(i, "") for i, (text, zone) in enumerate(zip(texts, zones))]
        text = " ".join(p for p in parts if p)
        out.append((page_id, url, text, len(text)))
    return pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(markup), F.lit("")).alias("html"))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    # no fewer chunks than shuffle partitions, so the dealt pages serve both passes as they are
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_chunks = max(least, -(-size // CHUNK_BYTES))
    steps = Steps(max(1, -(-size // BUCKET_BYTES)))
    chunk = F.pmod(F.xxhash64("page_id", F.octet_length("html"), "url"), F.lit(n_chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition(n_chunks, "chunk")
    # a stream is one row per chunk, however many pages have it; its first chunk speaks for it
    marks = dealt.groupBy("chunk").applyInPandas(send_streams, "mark long, chunk int")
    others = marks.withColumn("speaker", F.min("chunk").over(W.partitionBy("mark"))).where("chunk <> speaker").select("mark", "chunk")
    sent = dealt.groupBy("chunk").cogroup(others.groupBy("chunk")).applyInPandas(
        lambda p, o: send_heads(steps, p, o), "bucket long, chunk int, hashes binary, several binary, counted boolean")
    shared = sent.groupBy("bucket").applyInPandas(find_repeated, "chunk int, hashes binary")
    return dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(
        keep_unique, "page_id long, url string, text string, n_chars long")
