"""HTML extraction by equivalence classes of template tokens.

A page is a sequence of tokens: its tags in the context of the containers that are
open around them, and its runs of text. The occurrence vector of a token counts it on each
page of the host; pages of equal main text are one page, so copies do not make their
body template. Vectors are taken over all pages of the host and, as hosts have several
layouts, over the pages of each layout (the set of names of a page's containers). Tokens with
equal vectors form an equivalence class (vectors are compared by a fingerprint that Spark
aggregates, so no vector is gathered); classes of two tokens or more that occur on half of the
pages of the host or layout, or for text in an article on half of those with its container, are
the template where the container of their tokens is in a class, too. What lies between template
tokens are the slots; the main text is that of the slots outside menus, headers,
footers and side columns, of the article where it has at least as much text as the rest
of the page. Of that, the text in the fewest forms and containers named like side columns, notices,
adverts or comments is taken, however long the others are: names leave out what they hold, unless
all of the page's (or article's) own text lies in such containers. An article of which the template would take half or more keeps its text
(near copies repeat most of it).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondflow.llm.common import materialise

HOST = 0    # the layout that stands for all pages of a host
WHOLE = ""  # the token of a page itself, container of its outermost tokens
LEAST_PAGES = 3
LEAST_SHARE = 0.5
BROADCAST_TOKENS = 1_000_000  # most template tokens that are broadcast (8 MB); beyond it pages are shuffled to their host's template

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|xmp|iframe)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"""
                   r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>(?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<[!?/]?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<""",
                   re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CONTAINERS = frozenset("head body div section article main nav header footer aside form ul ol dl table figure details dialog menu "
                       "select button fieldset template svg object".split())
BLOCKS = CONTAINERS | frozenset("html p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address hr br "
                                "figcaption summary option optgroup legend center hgroup search".split())
OUTSIDE = frozenset("head nav footer aside dialog menu select button template svg object".split())
FORMS = frozenset(("form", "fieldset"))
HINTS = frozenset("ad ads advert advertisement adverts banner cookie cookies consent notice notices sidebar comment comments menu nav "
                  "navbar navigation footer promo sponsor sponsored share social related subscribe newsletter breadcrumb breadcrumbs "
                  "popup modal gdpr disqus respond replies complementary contentinfo discussion signup".split())
SOFT = frozenset("share social".split())  # names that an article itself may have
HEAD_HINTS = frozenset("header masthead topbar".split())
ABOUT = frozenset("has no not with without".split())  # has-sidebar, post-with-comments: what follows names other containers
LAYOUT = (r"<(?:nav|header|footer|aside|section|div|main|article|form)\b(?:[^>]*?\s(?:class|id)\s*=\s*[\"']?[a-z_ -]*)?")


def _words_of(attributes: str) -> tuple[tuple[str, ...], set[str]]:
    """All words of class, id and role, and those of names that tell of the container itself."""
    found = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes))
    names = [[w for w in re.split(r"[^a-z]+", x) if w] for x in found.lower().split()]
    return tuple(w for x in names for w in x), {w for x in names for w in takewhile(lambda w: w not in ABOUT, x)}


class Box:
    """An open container: whether it lies outside the content, how many containers named like boilerplate
    it is or lies in, and the outermost article or main element that it is or lies in."""

    __slots__ = ("tag", "path", "parent", "outside", "hinted", "root", "chars")

    def __init__(self, tag: str, path: str, parent: Box | None, words=(), own=frozenset()):
        self.tag, self.path, self.parent, self.chars, self.root = tag, path, parent, 0, None
        if parent is None:
            self.outside, self.hinted = False, 0
            return
        named = tag in FORMS or not HINTS.isdisjoint(own)
        self.root = parent.root or (self if tag in ("article", "main") or ("main" in words and not named) else None)
        self.outside = parent.outside or tag in OUTSIDE or (self.root is None and tag == "header")
        if self.root is self:
            named = not (HINTS - SOFT).isdisjoint(own)
        hint = tag != "body" and (named or (self.root is None and not HEAD_HINTS.isdisjoint(own)))
        self.hinted = parent.hinted + hint


def walk(page: str):
    """(token, its Box, text or None, ends a block, in a link) for each token of a page."""
    stack, linked = [Box("", "", None)], False
    for m in TOKEN.finditer(page):
        tag, box = m["tag"], stack[-1]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                yield box.path + "=" + text if not box.outside else None, box, text, False, linked
            continue
        tag = tag.lower()
        if tag == "a" or tag in BLOCKS:
            linked = tag == "a" and not m["end"]
        if m["end"]:
            token = box.path + "</" + tag
            if tag in CONTAINERS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        token, box = stack[i].path + "</", stack[i - 1]
                        del stack[i:]
                        break
            yield token, box, None, tag in BLOCKS, linked
            continue
        if tag not in CONTAINERS or m["attr"].endswith("/"):
            yield box.path + "<" + tag, box, None, tag in BLOCKS, linked
        else:
            words, own = _words_of(m["attr"]) if m["attr"] else ((), frozenset())
            path = f"{box.path}/{tag}.{'.'.join(words)}"
            yield path, box, None, tag in BLOCKS, linked
            stack.append(Box(tag, path, box, words, own))


def name(token: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token) - (1 << 63)


def _content(seen: list, template: set) -> tuple[list | None, int]:
    """(the outermost articles whose text is the page's main text, None for the whole page; the number of
    containers named like boilerplate around that text)."""
    boxes, plain = {}, 0
    for _, box, text, _, _ in seen:
        n = len(text.strip()) if text is not None and not box.outside else 0
        while box is not None and (n or box not in boxes):
            boxes[box] = None
            box.chars += n
            box = box.parent
    roots = [b for b in boxes if b.root is b and b.chars]
    least = min((r.hinted for r in roots), default=0)
    roots = [r for r in roots if r.hinted == least]
    chosen = set(roots)
    if roots:
        for token, box, text, _, linked in seen:
            if text is not None and not linked and not box.outside and box.hinted <= least and box.root not in chosen and name(token) not in template:
                plain += len(text.strip())
        if plain > sum(r.chars for r in roots):
            roots = []
    shown = [(token, box, linked) for token, box, text, _, linked in seen
             if text is not None and text.strip() and not box.outside and (not roots or box.root in chosen)]
    own = [box.hinted for token, box, linked in shown if not linked and (roots or name(token) not in template)]
    return roots or None, min(own or [box.hinted for _, box, _ in shown], default=0)


def _repeated(texts: list, template: set) -> set:
    """The template's texts in the article, unless they are half of it or more."""
    texts = [(token, len(text.strip())) for token, text in texts]
    found = {token for token, n in texts if n and name(token) in template}
    return found if 2 * sum(n for token, n in texts if token in found) < sum(n for _, n in texts) else set()


def main_text(page: str, template: set) -> str:
    """The page's slots outside boilerplate, blocks joined by one space; of the article if it has most of the text."""
    return _joined(list(walk(page)), template)


def _joined(seen: list, template: set) -> str:
    roots, least = _content(seen, template)
    shown = [text is not None and not box.outside and box.hinted == least and (roots is None or box.root in roots) for _, box, text, _, _ in seen]
    repeated = _repeated([(x[0], x[2]) for x, y in zip(seen, shown) if y], template) if roots and template else ()
    blocks, block = [], []
    for (token, _, text, ends, _), show in zip(seen, shown):
        if text is None:
            if ends:
                blocks.append("".join(block))
                block = []
        elif show and (token not in repeated if roots else name(token) not in template):
            block.append(text)
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)


def _occurrences(batches):
    """(host, layout, token, container, page, times, inside an article's text) of every distinct token of a page; ``WHOLE`` is the page itself."""
    import pyarrow as pa

    for batch in batches:
        host, layout, token, inside, digest, times, body = [], [], [], [], [], [], []
        for h, kind, page in zip(*(c.to_pylist() for c in batch.columns)):
            seen = list(walk(page))
            mark = name(_joined(seen, set()))
            found, container = Counter({"": 1}), {"": ("", False)}
            for t, box, text, _, _ in seen:
                if t is not None:
                    found[t] += 1
                    container[t] = box.path, box.root is not None and text is not None
            for t, n in found.items():
                host.append(h)
                layout.append(kind)
                token.append(name(t))
                inside.append(name(container[t][0]))
                digest.append(mark)
                times.append(n)
                body.append(container[t][1])
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string())] + [pa.array(x, pa.int64()) for x in (layout, token, inside, digest, times)] + [pa.array(body, pa.bool_())],
                                         ["host", "layout", "token", "container", "page", "times", "body"])


def _pages(df: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    page = F.coalesce(F.col(html), F.lit(""))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(page), F.lit(LAYOUT), F.lit(0))))
    return df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), page.alias("html"), host.alias("host"), F.xxhash64(names).alias("layout"))


def templates(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, layout, class_id, parent_class, pages, tokens): the valid equivalence classes of every
    host (layout ``HOST``) and of each of its layouts.

    ``tokens`` are hashes; a token of a class occurs on half of the pages of the host or layout
    at least, so their classes together hold at most twice as many tokens as the mean page
    (for text in an article, on half of the pages with its container), and on ``LEAST_PAGES``.
    ``parent_class`` is the class of the container of the tokens (null where it is in none);
    a class whose tokens lie in containers of several classes has a row for each.
    """
    return _templates(_pages(df, page_id, url, html))


def _templates(pages: DataFrame) -> DataFrame:
    group = ["host", "layout"]
    tokens = (pages.select("host", "layout", "html").mapInArrow(_occurrences, "host string, layout long, token long, container long, page long, times long, body boolean")
              .groupBy("host", "token", "layout", "page").agg(F.min("container").alias("container"), F.max("times").alias("times"), F.max("body").alias("body"))
              .withColumn("page", F.xxhash64("layout", "page"))
              .withColumn("layout", F.explode(F.array(F.lit(HOST).cast("long"), F.col("layout"))))
              .groupBy("host", "token", "layout").agg(F.min("container").alias("container"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"),
                                                      F.count("*").alias("pages"), F.sum("times").alias("times"), F.max("body").alias("body"))
              .where(F.col("pages") >= LEAST_PAGES))
    often = materialise(tokens, "tokens")
    sizes = often.where(F.col("token") == name(WHOLE)).select(*group, F.col("pages").alias("all"))
    around = often.select(*group, F.col("token").alias("container"), F.col("pages").alias("with_container"))
    named = (often.join(sizes, group).join(around, [*group, "container"])
             .where(F.col("pages") >= LEAST_SHARE * F.when(F.col("body"), F.col("with_container")).otherwise(F.col("all")))
             .select(*group, "token", "container", "pages", F.xxhash64("vector", "pages", "times").alias("class_id")))
    valid = named.groupBy(*group, "class_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    named = materialise(named.join(valid, [*group, "class_id"]), "classes")
    inside = named.select(*group, F.col("token").alias("container"), F.col("class_id").alias("parent_class"))
    return (named.join(inside, [*group, "container"], "left")
            .where(F.col("token") != name(WHOLE))
            .groupBy(*group, "class_id", "parent_class", "pages").agg(F.sort_array(F.collect_list("token")).alias("tokens")))


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts, known, last = [], set(), None
        for page, tokens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if tokens != last:
                known, last = set(tokens or ()), tokens
            texts.append(main_text(page, known))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``df``; an empty text where there is none.

    Null pages count as empty; very long ones are read whole, one at a time within a batch. Pages without a readable host form one host. Hosts of few pages have no
    template; their pages' structure alone decides. Repeated rows each come out (and cancel in
    pairs in a fingerprint, never in a count); an empty table gives an empty result. The templates are broadcast only while they
    hold ``BROADCAST_TOKENS`` tokens at most; otherwise pages are joined to them by host.
    """
    pages = _pages(df, page_id, url, html)
    found = materialise(_templates(pages).where("parent_class is not null").groupBy("host", "layout")
                        .agg(F.flatten(F.collect_set("tokens")).alias("tokens")), "templates")
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    shape = F.broadcast if size <= BROADCAST_TOKENS else (lambda x: x)
    of_host = shape(found.where(F.col("layout") == HOST).select("host", "tokens"))
    of_layout = shape(found.where(F.col("layout") != HOST).select("host", "layout", F.col("tokens").alias("more")))
    none = F.array().cast("array<bigint>")
    pages = (pages.join(of_host, "host", "left").join(of_layout, ["host", "layout"], "left")
             .select("page_id", "url", "html", F.concat(F.coalesce("tokens", none), F.coalesce("more", none)).alias("tokens")))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
