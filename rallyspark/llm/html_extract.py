"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the edges of block-level elements, with their ancestors. Each
block has features of its ancestors (tags, class and id words) and of its text (length, links, punctuation, capitals); a
two-state chain (article, other) is trained on labelled pages by gradient steps on the exact likelihood (forward and
backward sums) and decoded by Viterbi.

Labelled pages: a bounded, documented sample of pages (``SAMPLE`` of them, those with the smallest hash of page_id)
labels itself where it marks its article (``article``, ``main``) and its furniture; ``LAYOUTS`` adds pages with the kinds of
furniture that the sample may lack (comments, notices, sidebars, forms), laid out around texts of the sample, and texts
without any element. Ancestor features are dropped at random while training, so that text features learn to stand alone.
Features are the strings that training has seen; others weigh nothing.

Defined results: null and empty html give empty text and 0; character references are decoded; white space inside a
block becomes one space; nothing is cut off, whatever its length; broken markup is read leniently (a head ends where
content begins, end tags may be missing, the end of a hidden element ends all that it holds); text without elements is
an article; repeated rows are extracted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE, LAYOUT_PAGES, EPOCHS, DROP = 80, 330, 12, 0.12
#: Pages longer than this are not trained on (all are extracted): the sample passes through the driver.
SAMPLE_CHARS = 200_000
#: Elements whose edges end a block, and elements whose text is never shown. Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas audio video datalist".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class and id attributes and tags that mark furniture or articles, for labelling the training sample.
FURNITURE = frozenset("nav aside footer form button select textarea header ad ads advert advertisement banner promo sponsor sponsored sidebar side menu navbar breadcrumb breadcrumbs cookie cookies "
                      "notice consent gdpr popup modal alert comment comments reply replies disqus share social related recommended newsletter subscribe signup login search pagination pager copyright "
                      "footer masthead toolbar widget".split())
ARTICLE = frozenset("article main content post entry story body-text".split())


class Element:
    """An open element; blocks point at the one that holds them, so ancestors are shared however deep a page is nested."""

    __slots__ = ("tag", "marks", "parent", "in_furniture", "in_article")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: Element | None):
        self.tag, self.marks, self.parent = tag, marks, parent
        names = {tag, *marks}
        self.in_furniture = bool(names & FURNITURE) or (parent is not None and parent.in_furniture)
        self.in_article = bool(names & ARTICLE) or (parent is not None and parent.in_article)


class _Blocks(HTMLParser):
    """Collects (element, words, link characters) of each leaf block. Every tag costs the same at any depth, but for the
    elements that it closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack, by tag
        self.block_at: list[int] = []
        self.blocks: list[tuple[Element | None, str, int]] = []
        self.text: list[str] = []
        self.linked, self.hidden, self.links = 0, 0, 0

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.stack[-1] if self.stack else None, text, self.linked))
            self.text, self.linked = [], 0

    def _leave_head(self):
        """Ends a head whose end tag is missing, unless an element in it is still open."""
        if self.stack and self.stack[-1].tag == "head":
            self._cut(len(self.stack) - 1)

    def _last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else -1

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.end_block()
            return
        if tag in BLOCKS:
            self.end_block()
            if tag == "p" and self._last("p") >= 0:
                self.handle_endtag("p")
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                self._close_until(tag, {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",)}.get(tag, ("table", "select")) if tag != "td" and tag != "th" else ("tr",))
        marks = tuple(w for k, v in attrs if k in ("class", "id", "role") and v for w in re.split(r"[^a-z0-9]+", v.lower()) if w)
        self.at[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.block_at.append(len(self.stack))
        self.stack.append(Element(tag, marks, self.stack[-1] if self.stack else None))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def _close_until(self, tag, limits):
        i = self._last(tag)
        if i > max(map(self._last, limits)):
            self._cut(i)

    def _cut(self, i):
        while len(self.stack) > i:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in BLOCKS:
                self.block_at.pop()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_block()
        i = self._last(tag)
        if i < 0 or (tag not in BLOCKS and tag not in HIDDEN and self.block_at and self.block_at[-1] > i):
            return  # an inline end tag doesn't close a block
        self._cut(i)

    def handle_data(self, data):
        if self.hidden == 1 and data.strip():
            self._leave_head()
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    return parser.blocks


_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)


def features(blocks: list, index: dict[str, int], grow: bool = False, dropped: np.ndarray | None = None) -> list[list[int]]:
    """Feature numbers of each block by ``index``, which grows while training; ``dropped`` marks blocks whose ancestors are hidden."""
    out, known, lists = [], {None: frozenset()}, {}
    number = (lambda s: index.setdefault(s, len(index))) if grow else (lambda s: index.get(s, -1))

    def ancestors(element: Element | None) -> frozenset:
        """Numbers of all elements around a block: those of the parent, the same set if an element adds none."""
        path = []
        while element not in known:
            path.append(element)
            element = element.parent
        for e in reversed(path):
            above, own = known[e.parent], {k for k in map(number, [f"tag {e.tag}", *[f"class {m}" for m in e.marks]]) if k >= 0}
            known[e] = above if own <= above else above | own
        return known[path[0] if path else element]

    for i, (element, text, linked) in enumerate(blocks):
        n, found = len(text), []
        if dropped is None or not dropped[i]:
            key = (ancestors(element), element.tag if element else "")
            found = lists.get(key)
            if found is None:
                found = lists[key] = sorted(key[0]) + [k for k in [number(f"leaf {key[1]}")] if k >= 0]
        words = text.count(" ") + 1
        stops, caps = sum(map(text.count, ".,;!?")), len(text.encode("utf-8", "replace").translate(None, _NOT_CAPITAL))
        shape = [f"words {min(6, words.bit_length())}", f"links {min(4, 4 * linked // max(1, n))}", f"stops {min(4, 20 * stops // words)}", f"end {text[-1] in '.!?…'}",
                 f"caps {min(4, 8 * caps // n)}", f"mark {'©' in text or '|' in text}", f"place {min(3, 4 * i // len(blocks))}", "bias"]
        out.append(found + [k for k in map(number, shape) if k >= 0])
    return out


def label_of(element: Element | None) -> int | None:
    """1 in an article, 0 in furniture, None where the page doesn't say."""
    if element is None:
        return None
    return 0 if element.in_furniture else 1 if element.in_article else None


#: Furniture around an article, as (html before, html after); {0}..{2} are short texts of the sample, {3} is a whole one.
LAYOUTS = (
    ("", ""),
    ('<header><h1>{0}</h1><p>{1}</p></header>', '<aside><p>{3}</p></aside><div class="comments"><p>{3}</p><p>{2}</p></div>'),
    ('<header class="masthead"><h2>{0}</h2></header><nav class="navbar"><a href="/">{1}</a></nav>', '<section id="comments"><h2>{0}</h2><article class="comment"><p>{3}</p></article></section><footer><p>{2}</p></footer>'),
    ('<div class="notice"><p>{3}</p></div><div class="sidebar"><h3>{0}</h3><p>{3}</p></div>', '<div class="reply"><p>{3}</p></div><div class="footer"><p>{1}</p></div>'),
    ('<form class="login"><p>{1}</p><label>{0}</label></form><div class="promo"><p>{3}</p></div>', '<aside class="related"><h4>{0}</h4><p>{2}</p></aside><div class="sponsored"><p>{3}</p></div>'),
    ('<header><a href="/">{0}</a></header><nav><a href="/a">{1}</a> <a href="/b">{2}</a></nav>', '<footer><p>&copy; {0}</p></footer>'),
    ('<div class="menu"><ul><li><a href="/a">{0}</a></li><li><a href="/b">{1}</a></li></ul></div><div class="cookie-notice"><p>{2}</p></div>', '<div class="footer">{1}</div>'),
    ('<div id="banner"><p>{0}</p></div>', '<section class="comments"><h3>{1}</h3><div class="comment"><p>{2}</p></div><div class="comment"><p>{0}</p></div></section>'),
    ('<div class="ad"><p>{1}</p></div><aside class="sidebar"><p>{0}</p><ul><li><a href="/x">{2}</a></li></ul></aside>', '<form action="/s"><label>{0}</label><button>{1}</button></form>'),
    ('<div role="alert" class="notice">{0}</div>', '<div class="related"><a href="/r">{1}</a><a href="/s">{2}</a></div><div id="comments"><p>{0}</p><p>{2}</p></div>'),
    ('<p class="consent">{2}</p><div class="breadcrumbs"><a href="/">{0}</a></div>', '<div class="newsletter"><p>{1}</p><form><input><button>{0}</button></form></div><footer>{2}</footer>'),
)
#: How the article itself stands in those pages.
SHELLS = ("<article>{0}</article>", "<main>{0}</main>", "<div>{0}</div>", '<div id="main">{0}</div>', "{0}", '<div class="article-body" role="main">{0}</div>', "<section>{0}</section>", '<div class="content">{0}</div>', '<div id="post"><div class="entry">{0}</div></div>', '<main><div class="story">{0}</div></main>')

#: How a text stands by itself.
BARE = ("{0}", "<p>{0}</p>", "<body>{0}</body>", "<body><p>{0}</p></body>", "<div>{0}</div>", "<body><div><p>{0}</p></div></body>", "<p>{0}</p><p>{0}</p>")
#: What an article is made of.
INNER = ("<p>{0}</p>", "<ul><li>{1}</li><li>{2}</li></ul>", "<blockquote>{1}</blockquote>", "<table><tr><td>{1}</td><td>{2}</td></tr></table>", "<h2>{1}</h2><p>{0}</p>", "<pre>{1}</pre>",
         "<ol><li><p>{1}</p></li></ol>", "<figure><figcaption>{1}</figcaption></figure>", "{1}<div>{0}</div>")


def training_pages(pages: list[str]) -> list[tuple[list, list[int]]]:
    """(blocks, labels) of the sample's pages and of layouts filled with its texts."""
    rng, out, texts = np.random.default_rng(3), [], []
    for html in pages:
        blocks = leaf_blocks(html)
        marked = [(b, y) for b in blocks if (y := label_of(b[0])) is not None]
        if any(y for _, y in marked):
            out.append(([b for b, _ in marked], [y for _, y in marked]))
        texts += [t for b, _ in marked if (t := b[1].replace("<", "").replace("&", "").strip())]
    texts = texts or ["Lorem ipsum dolor sit amet, consectetur.", "Home", "Sed ut perspiciatis unde omnis iste natus error sit."]
    short = lambda: " ".join(texts[rng.integers(len(texts))].split()[: int(rng.integers(1, 25))])
    for i in range(LAYOUT_PAGES):
        before, after = LAYOUTS[i % len(LAYOUTS)]
        body = f"<h{1 + i % 3}>{short()}</h{1 + i % 3}>" * bool(i % 7) + "".join(
            INNER[max(0, int(rng.integers(-6, len(INNER))))].format(texts[rng.integers(len(texts))], short(), short()) for _ in range(int(rng.integers(1, 9))))
        if i % 4 == 3:
            body += f'<div class="comments"><h3>{short()}</h3><p>{texts[rng.integers(len(texts))]}</p></div>'
        fill = [short(), short(), short(), texts[rng.integers(len(texts))]]
        parts = [before.format(*fill), SHELLS[i % len(SHELLS)].format(body), after.format(*fill)]
        blocks = leaf_blocks("<body>" + "".join(parts) + "</body>")
        out.append((blocks, [int(label_of(b[0]) != 0) for b in blocks]))
        if i % 4 == 0:  # a text by itself is an article, long or short
            alone = [short(), texts[rng.integers(len(texts))], f"{short()} {texts[rng.integers(len(texts))]}"][i // 4 % 3]
            blocks = leaf_blocks(BARE[i // 4 % len(BARE)].format(alone))
            out.append((blocks, [1] * len(blocks)))
    return out


class Chain:
    """Two-state linear-chain CRF: a weight per feature and state, and per pair of states."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w, self.pair = np.zeros((0, 2)), np.zeros((2, 2))

    def emissions(self, feats: list[list[int]]) -> np.ndarray:
        flat = np.concatenate([np.asarray(f) for f in feats])
        return np.add.reduceat(self.w[flat], np.cumsum([0] + [len(f) for f in feats[:-1]]), axis=0)

    def fit(self, data: list[tuple[list, list[int]]], epochs: int = EPOCHS, rate: float = 0.3) -> Chain:
        rng = np.random.default_rng(5)
        for blocks, _ in data:
            features(blocks, self.index, True)
        self.w = np.zeros((len(self.index), 2))
        gw, gp = np.full_like(self.w, 1e-2), np.full_like(self.pair, 1e-2)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                blocks, labels = data[k]
                feats, y = features(blocks, self.index, dropped=rng.random(len(blocks)) < DROP), np.asarray(labels)
                e, n = self.emissions(feats), len(y)
                fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
                fw[0] = e[0]
                for t in range(1, n):
                    fw[t] = e[t] + np.logaddexp(fw[t - 1, 0] + self.pair[0], fw[t - 1, 1] + self.pair[1])
                for t in range(n - 2, -1, -1):
                    after = e[t + 1] + bw[t + 1]
                    bw[t] = np.logaddexp(self.pair[:, 0] + after[0], self.pair[:, 1] + after[1])
                z = np.logaddexp(*fw[-1])
                step = np.exp(fw + bw - z)
                step[np.arange(n), y] -= 1
                two = np.zeros((2, 2))
                if n > 1:
                    two = np.exp(fw[:-1, :, None] + self.pair + (e[1:] + bw[1:])[:, None, :] - z).sum(axis=0)
                    np.subtract.at(two, (y[:-1], y[1:]), 1)
                flat, grad = np.concatenate([np.asarray(f) for f in feats]), np.repeat(step, [len(f) for f in feats], axis=0)
                touched, inverse = np.unique(flat, return_inverse=True)
                g = np.zeros((len(touched), 2))
                np.add.at(g, inverse, grad)
                g += 1e-4 * self.w[touched]
                gw[touched] += g * g
                self.w[touched] -= rate * g / np.sqrt(gw[touched])
                gp += two * two
                self.pair -= rate * two / np.sqrt(gp)
        return self

    def decode(self, feats: list[list[int]]) -> list[int]:
        """The likeliest labels, by Viterbi; ties go to the article."""
        e = self.emissions(feats).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            from0, from1 = b + p10 >= a + p00, b + p11 >= a + p01
            back.append((from0, from1))
            a, b = x + (b + p10 if from0 else a + p00), y + (b + p11 if from1 else a + p01)
        state = int(b >= a)
        out = [state]
        for from0, from1 in reversed(back):
            state = int(from1 if state else from0)
            out.append(state)
        return out[::-1]


def main_text(html: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    return " ".join(b[1] for b, y in zip(blocks, chain.decode(features(blocks, chain.index))) if y)


def train(pages: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain from a bounded sample of ``pages``: those with the smallest hashes of their ids, by ids first."""
    usable = pages.filter(F.length("html").between(1, SAMPLE_CHARS)).select("page_id", F.col("html").cast("string").alias("html"))
    # A few times as many rows as pages, since ids may repeat; only these small rows are sorted.
    least = usable.filter("page_id is not null").select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id").limit(8 * sample).collect()
    ids = list(dict.fromkeys(r.page_id for r in least))[:sample]
    rows = usable.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).collect() if ids else usable.agg(F.min("html").alias("html")).collect()
    return Chain().fit(training_pages(sorted(r.html for r in rows if r.html)))


def extract(spark: SparkSession, pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    chain = spark.sparkContext.broadcast(train(pages, sample))
    ids = pages.select("page_id", "url")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h, chain.value) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {ids.schema['page_id'].dataType.simpleString()}, url {ids.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
