"""Operator 9, main text of web pages: a recurrent block labeller.

A page is read as the sequence of its blocks: the runs of text between block-level tags, each with
the path of open tags above it. A block becomes a vector of its hashed tag path (tags, classes,
ids, parent), its hashed words and a few counts; a bidirectional LSTM in numpy reads
the vectors of the whole page in both directions, and a logistic layer labels every block main
text or not with that context. Main blocks are joined in page order.

The network is trained here on at most ``SAMPLE`` pages (lowest hash of page_id), with labels from the
structure that authors mark up (``structural_label``), and on variants of the same pages whose
other parts stand in different places and under different names, so that what it learns is not one
site's layout. It has a fixed number of weights, whatever the table's size. Pages are labelled in one pass
without a shuffle.

Text is passed over unread only in scripts, styles, titles and form fields (textarea, select). The head
needs no end tag, and the text of math, svg, object, noscript, iframe and template is read like any other, for the
network to judge.

Cases: null or empty html, and pages without main text, give an empty text; unclosed tags (a script or style without
an end tag goes on to the end of the page, as in browsers; a title, textarea or select ends at a tag), tags cut
off at the end, and unknown character references are read as far as they go; repeated rows and
null ids or urls come out as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, task_cache

SAMPLE = 160
#: Variants of each of them that are trained on too.
VARIANTS = 8
HIDDEN = 16
EPOCHS = 24
RATE = 0.02
#: Blocks of a page read in one training sequence; longer pages give several.
WINDOW = 48
PATH_DIMS, WORD_DIMS, COUNTS = 256, 64, 5
INPUT = PATH_DIMS + WORD_DIMS + COUNTS

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea)(?=[\s/>])[^>]*>"
    # A quote counts only after "=", and one that is never closed is a character like any other.
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^>])*))>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S | re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in ("script", "style", "title", "textarea")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr"
    " math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt"
    " mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of a paragraph that have a path of their own.
_WITHIN = frozenset("iframe noscript object select svg template".split())
_OPTIONS = frozenset("hr optgroup option".split())
# Blocks that close an open paragraph; list items and cells close their like.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Words of class, id and role that name other things than the article, and words that go with them. A name is of another thing
#: if all its words are of these and one is of the first: ``cookie-notice`` and ``main-nav`` are, ``share-price`` is not.
_OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent footer header"
    " masthead menu menus modal nav navbar navigation newsletter notice notices popup promo promos related share sharing sidebar social sponsor sponsored"
    " subscribe toolbar widget widgets disqus reply replies login signup".split())
_PLAIN_WORDS = frozenset(
    "a and area articles bar bottom box block body button buttons container content entry form global group info inner item items left layout link links list main"
    " outer page panel post posts primary right secondary section site slot sticky sub text top wrap wrapper".split())
_ROLES = frozenset("banner complementary contentinfo dialog navigation search".split())
_OTHER_TAGS = frozenset("nav header footer aside form button menu dialog fieldset".split())
_MAIN_TAGS = frozenset(("article", "main"))


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of the text in links) of every block that has text. A path entry is ``tag`` or ``tag names``."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[str] = []
    parts: list[str] = []
    linked = 0

    def is_open(tag: str) -> bool:
        return any(entry.split(" ", 1)[0] == tag for entry in stack)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not is_open("select"):
                out.append((tuple(stack), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k].split(" ", 1)[0]
            if name == tag:
                del stack[k:]
                return
            if name in within:
                return

    at, link = 0, 0
    endless: set[str] = set()  # tags without an end tag from here on
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text = html_lib.unescape(page[at : m.start()])
            parts.append(text)
            linked += len(text) if link else 0
        at = m.end()
        tag = (m.group("tag") or m.group("raw") or "").lower()
        if not tag:
            continue
        if m.group("raw"):
            flush()
            if m.group().endswith("/>") and is_open("svg"):
                continue
            end = None if tag in endless else _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:
                endless.add(tag)
                at = page.find("<", at)
                at = len(page) if at < 0 else at
            continue
        if tag in ("br", "annotation"):
            parts.append(" ")
        elif tag in _INLINE:
            if tag == "a":
                link = 0 if m.group("end") else 1
        else:
            flush()
            if m.group("end"):
                close(tag)
            elif tag != "head":
                if tag not in _OPTIONS:
                    close("select")
                if tag not in _WITHIN and any(s.split(" ", 1)[0] == "p" for s in stack[-1:]):
                    close("p")
                for like in _CLOSES.get(tag, ()):
                    close(like, ("ul", "ol", "dl", "table", "select"))
                if tag not in _VOID and not (m.group().endswith("/>") and is_open("svg")):
                    names = " ".join(x for g in _NAMES.findall(m.group("attrs") or "") for x in g if x).lower()
                    stack.append(f"{tag} {names}" if names else tag)
    if at < len(page):
        parts.append(html_lib.unescape(page[at:]))
    flush()
    return out


def names_other(name: str) -> bool:
    """Whether a class, id or role names something else than the article."""
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    return name in _ROLES or bool(words) and not _OTHER_WORDS.isdisjoint(words) and all(w in _OTHER_WORDS or w in _PLAIN_WORDS for w in words)


def structural_label(path: tuple[str, ...], has_article: bool) -> bool:
    """Whether markup says that a block is main text: in the article (where the page has one) and in nothing else."""
    inside = False
    for entry in path:
        tag, _, names = entry.partition(" ")
        if tag in _MAIN_TAGS:
            inside = True
        elif tag in _OTHER_TAGS and (tag != "header" or not inside):
            return False
        if any(map(names_other, names.split())) and tag not in ("html", "body"):
            return False
    return inside or not has_article


def _labels(blocks) -> list[bool]:
    has_article = any(e.split(" ", 1)[0] in _MAIN_TAGS for path, _, _ in blocks for e in path)
    return [structural_label(path, has_article) for path, _, _ in blocks]


class _Buckets(dict):
    """Hash buckets of words, remembered up to a bound."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = k = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.dims
        return k


#: Of the numbers of a path, those for tags, for names, and for what the lexicon says of the path.
TAG_DIMS, NAME_DIMS, SIGNS = 176, 72, 8

_word_bucket, _tag_bucket, _name_bucket = _Buckets(WORD_DIMS), _Buckets(TAG_DIMS), _Buckets(NAME_DIMS)
_path_rows: dict[tuple[str, ...], np.ndarray] = {}


@task_cache
def _forget() -> None:
    for kept in (_word_bucket, _tag_bucket, _name_bucket, _path_rows):
        kept.clear()


def _path_row(path: tuple[str, ...]) -> np.ndarray:
    row = _path_rows.get(path)
    if row is None:
        if len(_path_rows) > 20_000:
            _path_rows.clear()
        row = _path_rows[path] = np.zeros(PATH_DIMS)
        signs = row[TAG_DIMS + NAME_DIMS :]
        for depth, entry in enumerate(path):
            tag, _, names = entry.partition(" ")
            row[_tag_bucket[f"<{tag}"]] = 1
            for name in names.split():
                row[TAG_DIMS + _name_bucket[name]] = 0.5
                signs[0] += names_other(name)
            signs[1 if tag in _OTHER_TAGS else 2 if tag in _MAIN_TAGS else 3] += 1
            if tag in _OTHER_TAGS and signs[2]:
                signs[4] = 1  # inside the article
        signs[3] /= 8
        if path:
            row[_tag_bucket[f">{path[-1].split(' ', 1)[0]}"]] = 1
    return row


def vectors(blocks) -> np.ndarray:
    """A row of ``INPUT`` numbers for each block."""
    n = len(blocks)
    out = np.zeros((n, INPUT))
    if not n:
        return out
    words = [text.split(" ") for _, text, _ in blocks]
    size = np.array(list(map(len, words)))
    bucket = np.fromiter((_word_bucket[w] for ws in words for w in ws), np.int64, int(size.sum()))
    hit = np.bincount(np.repeat(np.arange(n) * WORD_DIMS, size) + bucket, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    out[:, :PATH_DIMS] = [_path_row(path) for path, _, _ in blocks]
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = hit / np.sqrt(np.sum(hit * hit, 1))[:, None]
    out[:, -5] = np.log1p(size) / 5
    out[:, -4] = [links for _, _, links in blocks]
    out[:, -3] = np.array([text.count(".") + text.count(",") for _, text, _ in blocks]) / size
    out[:, -2] = np.arange(n) / max(1, n - 1)
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Lstm:
    """One direction. Sequences are padded to (steps, pages, INPUT); a mask marks real steps."""

    def __init__(self, inward: np.ndarray, across: np.ndarray, bias: np.ndarray):
        self.inward, self.across, self.bias = inward, across, bias

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        into = x.reshape(steps * pages, -1) @ self.inward + self.bias
        into = into.reshape(steps, pages, -1)
        out, tape = np.zeros((steps, pages, HIDDEN)), []
        for t in range(steps):
            z = into[t] + h @ self.across
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            act = np.tanh(new)
            if keep:
                tape.append((h, c, i, f, o, g, act, m))
            c = np.where(m, new, c)
            h = np.where(m, o * act, h)
            out[t] = h
        return (out, tape) if keep else out

    def slopes(self, x: np.ndarray, tape, d_out: np.ndarray):
        """Gradients of the weights, given those of the outputs."""
        steps, pages, _ = x.shape
        d_in, d_across = np.zeros((steps, pages, 4 * HIDDEN)), np.zeros_like(self.across)
        dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, act, m = tape[t]
            dh = dh + d_out[t]
            on_h, on_c = np.where(m, dh, 0), np.where(m, dc, 0)
            d_new = on_c + on_h * o * (1 - act * act)
            dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), on_h * act * o * (1 - o), d_new * i * (1 - g * g)], 1)
            d_in[t] = dz
            d_across += h.T @ dz
            dh = np.where(m, 0, dh) + dz @ self.across.T
            dc = np.where(m, d_new * f, dc)
        flat = d_in.reshape(steps * pages, -1)
        return x.reshape(steps * pages, -1).T @ flat, d_across, flat.sum(0)


def _reversed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse; the padding stays at the end."""
    step = np.arange(len(x))[:, None]
    at = np.where(step < sizes, sizes - 1 - step, step)
    return x[at, np.arange(x.shape[1])]


class BlockLabeller:
    """The bidirectional network: (forward, backward) LSTMs and the output layer."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights
        self.ahead, self.back = Lstm(*weights[:3]), Lstm(*weights[3:6])
        self.out, self.lean = weights[6], weights[7]

    @classmethod
    def fresh(cls, seed: int = 3) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        one = lambda: [rng.normal(0, 0.1, (INPUT, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)),
                       np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]]
        return cls([*one(), *one(), rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)])

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pages])
        x = np.zeros((sizes.max(), len(pages), INPUT))
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        return x, np.arange(sizes.max())[:, None] < sizes, sizes

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):  # pages of like length together, so little is padding
            to = at + 1
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= 4096 and len(pages[order[to]]) <= 2 * len(pages[order[at]]) + 8:
                to += 1
            group = order[at:to]
            x, mask, sizes = self._padded([pages[k] for k in group])
            h = np.concatenate([self.ahead.run(x, mask), _reversed(self.back.run(_reversed(x, sizes), mask), sizes)], 2)
            p = _sigmoid(h @ self.out + self.lean)
            for j, k in enumerate(group):
                out[k] = p[: sizes[j], j]
            at = to
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> None:
        """Cross-entropy by Adam with backpropagation through time, in batches of pages."""
        rng = np.random.default_rng(seed)
        mean, square = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 128):
                group = order[at : at + 128]
                x, mask, sizes = self._padded([pages[k] for k in group])
                y = np.zeros(mask.shape)
                for j, k in enumerate(group):
                    y[: sizes[j], j] = labels[k]
                a, tape_a = self.ahead.run(x, mask, True)
                back_x = _reversed(x, sizes)
                b, tape_b = self.back.run(back_x, mask, True)
                h = np.concatenate([a, _reversed(b, sizes)], 2)
                miss = np.where(mask, _sigmoid(h @ self.out + self.lean) - y, 0) / mask.sum()
                d_h = miss[:, :, None] * self.out
                slopes = [*self.ahead.slopes(x, tape_a, d_h[:, :, :HIDDEN]),
                          *self.back.slopes(back_x, tape_b, _reversed(d_h[:, :, HIDDEN:], sizes)),
                          np.tensordot(miss, h, ([0, 1], [0, 1])), np.array([miss.sum()])]
                step += 1
                rate = RATE * (1 - 0.9 * epoch / epochs)
                for w, g, m, s in zip(self.weights, slopes, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


#: Places and names for the other parts of a training page; ``~`` stands for a name of another thing.
_PLACES = [("nav",), ("header",), ("footer",), ("aside",), ("form",), ("div ~",), ("section ~",), ("ul ~", "li"), ("nav", "ul", "li"), ("header", "nav", "ul", "li"),
           ("footer", "p"), ("footer", "ul", "li"), ("aside", "p"), ("aside", "ul", "li"), ("div ~", "p"), ("div ~", "ul", "li"), ("div ~", "div", "p"),
           ("section ~", "h2"), ("section ~", "ul", "li"), ("form", "fieldset"), ("form", "p"), ("div ~", "form"), ("div ~", "h3"), ("div ~", "div ~"),
           ("nav ~", "div"), ("dialog",), ("menu", "li"), ("div ~", "figure", "figcaption"), ("div ~", "table", "tr", "td"), ("div ~", "article", "p")]
_NAMED = ["ad", "ads", "advert", "banner", "breadcrumbs", "comments", "comment-list", "cookie notice", "cookie-consent", "site-footer", "site-header", "menu", "main-nav",
          "navbar", "navigation", "newsletter", "newsletter-box", "notice", "promo", "popup", "related", "related-posts", "share", "share-buttons", "sidebar",
          "left sidebar", "social-links", "sponsored", "subscribe", "widget", "login-form", "replies"]
#: Homes of the article, with and without tags that say so, and names that pages give them and their parts.
_HOMES = [("article",), ("main",), ("main", "article"), ("div ?", "article"), ("article ?",), ("div ?", "main ?", "div"), ("main ?", "section"), ("article ?", "div ?")]
_BARE_HOMES = [(), ("div ?",), ("div ?", "div ?"), ("section ?",), ("table", "tr", "td ?"), ("div",), ("div ?", "section")]
_OWN_NAMES = ["content", "post", "entry-content", "article-body", "main", "story", "wrapper", "container", "page", "text", "body-text", "share-price", "header-files",
              "navigation-history", "comment-on-law", "menu-of-the-day", "ad-hoc", "column", "lead", "prose", "markdown", "chapter"]
_LEAVES = [("p",), ("p",), ("p",), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("div",), ("div ?",), ("figure", "figcaption"),
           ("table", "tr", "td"), ("table", "tbody", "tr", "th"), ("table", "caption"), ("dl", "dt"), ("dl", "dd"), ("pre",), ("section", "p"), ("section ?", "h2"),
           ("div ?", "p"), ("header", "p"), ("details", "summary"), ("address",), ("ul", "li", "p"), ("object", "p"), ("noscript", "p")]


def _variant(blocks, rng):
    """The page's blocks, its main ones under another home and in leaves of any kind, its others in other places. Texts change
    places too (a short one may be main, a long one not), so that where a block stands decides, not what it says."""
    labels = _labels(blocks)
    main = [b for b, y in zip(blocks, labels, strict=True) if y]
    texts = [b[1] for b in blocks]
    pick = lambda of: of[rng.integers(len(of))]
    named = lambda path: tuple(f"{e[:-1]}{pick(_NAMED)}" if e.endswith("~") else f"{e[:-1]}{pick(_OWN_NAMES)}" if e.endswith("?") else e for e in path)
    bare = rng.random() < 0.45
    home = named(("html", "body", *pick(_BARE_HOMES if bare else _HOMES)))
    leaves_of = _LEAVES if not bare else [x for x in _LEAVES if x[0] != "header"]
    few = [named(pick(leaves_of)) for _ in range(rng.integers(1, 5))]

    def others(inner: bool):
        path = named(pick(_PLACES))
        if inner:
            path = ("html", "body", *home[2:], *(path if path[0] != "header" else ("footer", *path[1:])))
        else:
            path = ("html", "body", *path)
        return [(path, pick(texts), float(rng.random() < 0.5)) for _ in range(rng.integers(1, 7))]

    out = []
    for k, b in enumerate(main):
        leaf = ("h1",) if k == 0 and rng.random() < 0.7 else named(("p",)) if rng.random() < 0.3 else pick(few)
        for _ in range(rng.integers(1, 5) if leaf[-1].split(" ")[0] in ("li", "td", "th", "dt", "dd") else 1):
            out.append(((*home, *leaf), b[1] if rng.random() < 0.5 else pick(texts), float(rng.random() < 0.1)))
    if len(out) > 2 and rng.random() < 0.5:
        k = int(rng.integers(1, len(out)))
        out = out[:k] + others(True) + out[k:]
    for _ in range(rng.integers(0, 3)):
        out = others(False) + out
    for _ in range(rng.integers(0, 3)):
        out = out + others(bool(rng.random() < 0.3))
    return out


def train(pages: list[str], epochs: int = EPOCHS, seed: int = 11) -> BlockLabeller:
    """The network fitted to the pages and to ``VARIANTS`` variants of each."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        if blocks:
            for version in (blocks, *[_variant(blocks, rng) for _ in range(VARIANTS)]):
                rows, truth = vectors(version), np.array(_labels(version), float)
                for k in range(0, len(rows), WINDOW):
                    x.append(rows[k : k + WINDOW])
                    y.append(truth[k : k + WINDOW])
    model = BlockLabeller.fresh()
    if x:
        model.fit(x, y, epochs)
    return model


def train_on(pages: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> BlockLabeller:
    """Fit on at most ``sample`` of the pages, the same ones in every run, in one task; the weights come to the driver."""
    rows = pages.filter("html IS NOT NULL AND html <> ''").select(F.xxhash64(F.col("page_id").cast("string"), "html").alias("k"), "html")

    def run(batches):
        pages = [h for b in batches for h in b.column("html").to_pylist()]
        weights = train(pages, epochs).weights
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in weights], pa.binary())], ["weights"])

    chosen = rows.orderBy("k", "html").limit(sample).repartition(1).sortWithinPartitions("k", "html")
    shapes = [w.shape for w in BlockLabeller.fresh().weights]
    found = map_arrow(chosen, run, "weights binary").collect()
    if not found:  # no page with text
        return BlockLabeller.fresh()
    return BlockLabeller([np.frombuffer(r.weights).reshape(shape) for r, shape in zip(found, shapes, strict=True)])


def extract(pages: DataFrame, model: BlockLabeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    from pyspark.sql import types as T

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks_of(h) for h in part.column("_html").to_pylist()]
                chosen = model.label([vectors(b) for b in found])
                texts = [" ".join(b[1] for b, p in zip(bs, ps, strict=True) if p >= 0.5) for bs, ps in zip(found, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    fields = [rows.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_arrow(rows, run, T.StructType(fields))


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train_on(pages))
