"""Main text of HTML pages by template deduction from equivalence classes.

Tokens of a page are its element paths (tag, class and id) and its runs of text, each at its path. Each has an
occurrence vector: how often it occurs on each page of its host. The vectors are never built: a token keeps the sum
of a 64-bit hash of (page, count) over all pages, in two halves, which map-side aggregation folds, so a host with a
third of all pages is a few rows before the shuffle, and rows that repeat don't cancel. Tokens of a host with one
fingerprint form an equivalence class. Classes that are frequent and in page order are valid, and are nested by
their paths into the host's template; text in them is the template's own. The remaining slots are judged by the text
that varies in them: from the page down, the slot that keeps most of it. What a site calls its elements decides only
between nested slots that hold the same text, and lessens the weight of text in what is named as an advert, comments
or the like. Each page's text is what its article's slot has besides the template's text and such blocks; paragraphs,
list items and the like, and phrases within them, stay whatever they are called, unless their text is the template's.

Defined results: null or empty html has empty text; a page whose host has too few pages for a valid class, or whose
pages are all alike, is judged on its own tokens; a page without an element that holds text has empty text; broken
markup is read leniently, and a tag that the page's end cuts off is dropped; null urls are one host; a page's key is
(page_id, url), and rows that repeat it weigh as often as they occur; elements of any depth count, but those more
than 60 levels down share one path, so that a page's paths stay short; extra columns don't matter.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body br button caption head html legend option td tbody tfoot th thead title tr".split())
#: Elements that never hold main text.
NOISE_TAGS = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu input datalist noembed noframes audio video".split())
#: Words of class, id and role that name what is not main text.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notification outbrain pagination popup promo promoted reader related reply replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe taboola toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article main story post entry content articlebody".split())
#: Elements of the text itself, never a slot of their own.
TEXT_TAGS = frozenset("p li ul ol dl dd dt td th tr tbody blockquote pre h1 h2 h3 h4 h5 h6".split())
#: Elements that are a piece of the text whatever they are called: only the template's own text goes from them.
PROSE_TAGS = frozenset("p li dd dt td th blockquote pre h1 h2 h3 h4 h5 h6".split())
_DEEPEST = 60

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_WORDS = re.compile(r"[a-z]+")


def _noise_names(names: str) -> bool:
    words = _NAME_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
    return any(w in NOISE_WORDS for w in words)


class Node:
    """An open element: its path token, whether it is noise in any slot, whether it is a phrase within a block that
    is named as noise, and the paths of the blocks from the page down to it that are named so."""

    __slots__ = ("tag", "path", "depth", "noise", "phrase", "named", "link", "article")

    def __init__(self, tag: str, names: str, hidden: bool, parent: Node | None):
        inside = parent is not None and parent.article
        self.tag, self.depth, self.noise, self.phrase, self.named = tag, 0, False, False, ()
        self.article = inside or tag in ("article", "main")
        self.link = tag == "a" or (parent is not None and parent.link)
        if parent is None:
            self.path = tag
            return
        self.depth = parent.depth + (tag in BLOCK or bool(names))
        if self.depth == parent.depth or self.depth > _DEEPEST + 1:
            self.path = parent.path
        else:
            self.path = parent.path + ">" + (tag + "".join("." + re.sub(r"\d+", "#", n) for n in names.split()) if self.depth <= _DEEPEST else "*")
        called = bool(names) and tag not in ("html", "body") and _noise_names(names)
        self.noise = parent.noise or hidden or tag in NOISE_TAGS or (tag == "header" and not inside)
        self.phrase = called and tag not in BLOCK
        self.named = (*parent.named, self.path) if called and tag in BLOCK and tag not in PROSE_TAGS else parent.named


def _words(text: str) -> str:
    return " ".join(htmllib.unescape(text).split())


def page_blocks(html: str, runs: frozenset[int] = frozenset()) -> tuple[list[tuple[str, tuple[str, ...], int, str]], dict[str, int], list[tuple[str, str]]]:
    """([(path, paths around it named as noise, characters in links, text)] of the page's blocks in order but for
    those that are noise in any slot, {path: occurrences}, [(path, text)] of the phrases within blocks that are named
    as noise). Phrases of which the template has the text are left out of their blocks."""
    root = Node("#page", "", False, None)
    stack, blocks, counts, piece, links, at = [root], [], defaultdict(int), [], 0, 0
    inline: list[tuple[str, int]] = []  # what a block has so far when inline noise interrupts it
    phrases: list[tuple[str, str]] = []
    begun: list[int] = []  # where in the piece the open phrases begin

    def flush() -> None:
        nonlocal links
        while inline:  # noise that was never closed ends with its block
            flush_inline() if stack[-1].noise else piece.insert(0, inline.pop()[0])
        while begun:
            end_phrase()
        if piece:
            text = _words("".join(piece))
            if text and not stack[-1].noise:
                blocks.append((stack[-1].path, stack[-1].named, links, text))
            piece.clear()
        links = 0

    def end_phrase() -> None:
        at = begun.pop()
        text = _words("".join(piece[at:]))
        if text and not stack[-1].noise:
            phrases.append((stack[-1].path, text))
            if _run(text) in runs:
                del piece[at:]

    def add(text: str) -> None:
        nonlocal links
        piece.append(text)
        if stack[-1].link:
            links += len(text)

    def close(to: int) -> None:
        if any(n.tag in BLOCK for n in stack[to:]):
            flush()
        elif begun and any(n.phrase for n in stack[to:]):
            for _ in range(min(len(begun), sum(n.phrase for n in stack[to:]))):
                end_phrase()
        del stack[to:]

    def flush_inline() -> None:
        nonlocal links
        if stack[-1].noise:
            piece.clear()
            links = 0
            if inline:
                kept, links = inline.pop()
                piece.append(kept)
        else:
            inline.append(("".join(piece), links))
            piece.clear()
            links = 0

    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            cut = re.search(r"<[a-zA-Z/!?][^<]*\Z", html[at:])
            add(html[at : at + cut.start()] if cut and ">" not in cut[0] else html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag not in BLOCK and stack[k].noise and not stack[k - 1].noise:
                        flush_inline()
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "table", "body", "article", "main") and tag not in ("table", "html", "body", "tr"):
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            if tag == "hr":
                flush()
            elif tag == "br":
                piece.append(" ")
            continue
        if tag in VOID:
            continue
        names, hidden = "", False
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                if a[1].lower() == "hidden":
                    hidden = True
                else:
                    names += " " + (a[2] or a[3] or a[4] or "")
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t == "p" and tag in CLOSES_P or t == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option") or tag in ("dd", "dt") and t in ("dd", "dt"):
                    close(k)
                    break
                if t in BLOCK and not (tag == "tr" and t in ("td", "th")):
                    break
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(html, at)
            at = end.end() if end else n
            if tag in BLOCK:
                flush()
            counts[f"{stack[-1].path}>{tag}"] += 1
            continue
        node = Node(tag, names.strip(), hidden, stack[-1])
        if tag in BLOCK:
            flush()
        elif node.noise and not stack[-1].noise:
            while begun:
                end_phrase()
            flush_inline()
        elif node.phrase and not node.noise:
            begun.append(len(piece))
        stack.append(node)
        if node.path != stack[-2].path:
            counts[node.path] += 1
    while len(stack) > 1:
        if stack[-1].tag not in BLOCK and stack[-1].noise and not stack[-2].noise:
            flush_inline()
        close(len(stack) - 1)
    flush()
    return blocks, counts, phrases


def _run(text: str) -> int:
    """A run of text as a token."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _weight(text: str, links: int, named: tuple[str, ...]) -> int:
    """What a block says for the slots around it, in tenths of characters: links say nothing, text in what is
    named as noise a tenth."""
    return max(0, len(text) - links) * (1 if named else 10)


def page_tokens(html: str) -> list[tuple[str, bool, int, int, int, int]]:
    """(path, whether it is a run of text, run, occurrences, rank on the page, weight) of each token; the weight
    of an element path is that of all text in it."""
    blocks, counts, phrases = page_blocks(html)
    weights, runs = defaultdict(int), defaultdict(lambda: [0, 0])
    for path, text in phrases:
        runs[path, _run(text)][0] += 1
    for path, named, links, text in blocks:
        w = _weight(text, links, named)
        at = path
        while at:
            weights[at] += w
            at = at.rpartition(">")[0]
        run = runs[path, _run(text)]
        run[0] += 1
        run[1] += w
    counts = {"#page": 1, **counts}
    rank = {p: k for k, p in enumerate(counts)}
    out = [(p, False, 0, c, rank[p], weights[p]) for p, c in counts.items()]
    return out + [(p, True, r, n, rank.get(p, 0), w) for (p, r), (n, w) in runs.items()]


def equivalence_classes(tokens: pd.DataFrame) -> list[pd.DataFrame]:
    """The valid classes of one host's frequent tokens (path, text, run, lo, hi, rank): at least two tokens of one
    fingerprint. Paths are kept in page order; a class is invalid if an element in it opens, over all pages,
    before one in it that encloses it."""
    found = []
    for _, part in tokens.sort_values("rank", kind="stable").groupby(["lo", "hi"], sort=False):
        if len(part) < 2:
            continue
        paths = part.loc[~part["text"], "path"].tolist()
        seen, valid = set(), True
        for p in paths:
            parent = p.rpartition(">")[0]
            valid &= parent not in paths or parent in seen
            seen.add(p)
        if valid:
            found.append(part)
    return found


def _score(path: str) -> int:
    """How clearly the site names the element as its article: 2 by tag, 1 by class."""
    step = path.rpartition(">")[2]
    tag, _, names = step.partition(".")
    if tag in ("article", "main"):
        return 2
    return int(any(w in ARTICLE_WORDS for w in _NAME_WORDS.findall(names.lower())))


def article_slot(weights: dict[str, int], share: float = 0.6) -> str | None:
    """The path whose slot holds the article. weights: of each slot, and of the page, the text that varies in it.
    From the page down, each step takes the slot that keeps `share` of the weight at least; of these nested ones
    the outermost that the site names as its article is taken, or else the innermost."""
    at, chain = "#page", []
    while weights.get(at, 0) > 0:
        inside = [p for p, w in weights.items() if p.startswith(at + ">") and w >= share * weights[at] and p.rpartition(">")[2].partition(".")[0] not in TEXT_TAGS]
        if not inside:
            break
        at = min(inside, key=lambda p: (p.count(">"), p))
        chain.append(at)
    return next((p for score in (2, 1, 0) for p in (chain if score else chain[-1:]) if _score(p) >= score), None)


def page_text(html: str, slot: str | None, runs: frozenset[int] = frozenset()) -> str:
    """The text of the page's blocks in the slot, without the template's runs of text; without a slot, or on a
    page that lacks it, in the slot that the page itself shows."""
    blocks, counts, _ = page_blocks(html, runs)
    if runs:
        blocks = [b for b in blocks if _run(b[3]) not in runs]
    if slot is None or not any(p == slot or p.startswith(slot + ">") for p in counts):
        weights = defaultdict(int)
        for path, named, links, text in blocks:
            at = path
            while at:
                weights[at] += _weight(text, links, named)
                at = at.rpartition(">")[0]
        slot = article_slot({p: w for p, w in weights.items() if counts.get(p, 1) == 1}) or "#page"
    inside = slot + ">"
    return " ".join(text for path, named, _, text in blocks if (path == slot or path.startswith(inside)) and not any(p.startswith(inside) for p in named))


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


TEMPLATE = "host string, slot string, runs array<long>"


def deduce_templates(pages: DataFrame, min_support: float = 0.3, min_pages: int = 3, text_support: float = 0.9, text_pages: int = 5) -> DataFrame:
    """(host, slot, runs): the article's slot in each host's template (null if that shows none) and the template's
    own runs of text. All pages count. A token is frequent on min_support of a host's pages, and min_pages at
    least; text becomes the template's on text_support of them, and text_pages at least."""

    def tokens(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = [(i, h, *row) for i, h, text in zip(*(b.column(k).to_pylist() for k in range(3))) for row in page_tokens(text or "")]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["page", "host", "path", "text", "run", "n", "rank", "weight"])

    key = F.xxhash64("page_id", "url")
    rows = pages.select(key.alias("page"), host().alias("host"), "html").mapInArrow(tokens, "page long, host string, path string, text boolean, run long, n long, rank long, weight long")
    hashed = rows.withColumn("h", F.xxhash64("page", "n"))
    vectors = hashed.groupBy("host", "path", "text", "run").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("lo"),
        F.sum(F.shiftrightunsigned("h", 32)).alias("hi"),
        F.avg("rank").alias("rank"),
        F.sum("weight").alias("weight"),
        F.max("n").alias("most"),
    )
    sizes = pages.select(host().alias("host"), key.alias("page")).groupBy("host").agg(F.count(F.lit(1)).alias("of"), F.countDistinct("page").alias("pages"))
    # a run seen once is a text of its own; what is left of a host grows with its pages' size, not their number
    often = vectors.filter("rows > 1 OR NOT text").join(sizes.hint("merge"), "host").withColumn("seen", F.col("rows") / F.col("of") * F.col("pages") + 1e-9)
    frequent = often.filter(F.col("seen") >= F.greatest(F.lit(min_pages), F.col("pages") * F.when(F.col("text"), text_support).otherwise(min_support)))

    def template(part: pd.DataFrame) -> pd.DataFrame:
        classes = equivalence_classes(part)
        empty = pd.DataFrame({"host": [], "slot": [], "runs": []}, dtype=object)
        if not classes:
            return empty
        found = pd.concat(classes)
        fixed = found[found["text"] & (found["seen"] >= text_pages)]
        weights = {p: int(w) for p, w, most in found.loc[~found["text"], ["path", "weight", "most"]].itertuples(index=False, name=None) if most == 1}
        for path, w in fixed[["path", "weight"]].itertuples(index=False, name=None):
            for p in weights:
                if path == p or path.startswith(p + ">"):
                    weights[p] -= int(w)
        if weights.get("#page", 0) <= 0:
            return empty  # nothing varies
        return pd.DataFrame({"host": [part["host"].iloc[0]], "slot": [article_slot(weights)], "runs": [sorted(set(fixed["run"].tolist()))]})

    return frequent.groupBy("host").applyInPandas(template, TEMPLATE)


def extract_text(pages: DataFrame, broadcast_bytes: int = 8 << 20, **options) -> DataFrame:
    """page_id, url, text, n_chars of every page. The templates are broadcast while their measured size is
    within broadcast_bytes; beyond that they are joined by host, where adaptive execution splits hot hosts."""
    templates = materialise(deduce_templates(pages, **options), "templates")
    size = templates.agg(F.sum(F.length("host") + F.coalesce(F.length("slot"), F.lit(0)) + 8 * F.size("runs") + 64)).first()[0] or 0
    found = F.broadcast(templates) if size <= broadcast_bytes else templates.hint("merge")
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(found, "host", "left").select("page_id", "url", "html", "slot", "runs")

    def extract(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [page_text(h, s, frozenset(r or ())) if h else "" for h, s, r in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
