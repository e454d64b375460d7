"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf sequence: the stretches of text between block-level tags, each with the path of open tags
(names, classes and ids) above it, however deep; an element that is open several times counts once, where it is innermost.
Every block becomes a vector of hashed path elements, all its words hashed and a few lengths;
a bidirectional LSTM in numpy runs over the whole page and labels each block from both directions' state and its own
vector. Blocks labelled main are joined in page order.

The labeller is trained here, in seconds, on ``SITES`` pages that a generator lays out from site templates (menus,
headers, notices, adverts, sidebars, forms, comments around and inside articles of many wrappings), so no page of the
table is needed and none is a label source. Training is seeded; every call with one version of numpy gives one model.

Null html counts as empty and gives an empty text. Scripts, styles, comments and unfinished tags are no text, each found
in page order: what looks like a script inside a comment or a quoted value is none. A page that ends early is read as far
as it goes, and a very long page whole, in time in line with its length. Repeated rows are extracted each for itself.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm.common import table

PATHS, WORDS, NUMBERS, HIDDEN = 192, 24, 6, 16
WIDTH = PATHS + WORDS + NUMBERS
SITES = 2400
TEXTS = "page_id long, url string, text string, n_chars long"

# The block-level elements of HTML, those that hold no text, and those without an end tag.
BLOCKS = frozenset("html head title body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd section article header footer nav aside main blockquote pre table thead tbody tr td th caption form fieldset legend label button option figure figcaption details summary address hr menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TEXT = frozenset("script style noscript template svg iframe textarea select".split())
NESTING = frozenset("noscript template svg select".split())
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comments
    r"|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"  # declarations and end tags without a name
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",  # tags; only a value can be quoted
    re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@cache
def _edge(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])(?:[^>]*>|[^>]*\Z)", re.I)


def _after_hidden(page: str, name: str, at: int) -> int | None:
    """Where an element without visible text ends that begins before ``at``: at its own end tag, or the next one of its name."""
    depth, first = 1, None
    for m in _edge(name).finditer(page, at):
        if m[1]:
            first = first or m.end()
            depth -= 1
        elif name in NESTING:
            depth += 1
        if not depth:
            return m.end()
    return first


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path elements, characters inside links) of every block with text."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    endless: set[str] = set()
    linked, links, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, stack[-1][1] if stack else (), linked))
        parts.clear()
        linked = 0

    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(piece := html.unescape(page[at : m.start()]))
            linked += len(piece) if links else 0
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in HIDDEN_TEXT:
            parts.append(" ")
            if not m[1] and name not in endless and not (name == "svg" and m[3].endswith("/")):
                end = _after_hidden(page, name, at)
                if end is None:  # scripts and styles run to the end of the page; of others only the start tag is hidden
                    endless.add(name)
                    end = len(page) if name in ("script", "style") else at
                at = end
            continue
        if name == "a":
            links = max(0, links + (-1 if m[1] else 1))
        if name not in BLOCKS:
            if name == "br":
                parts.append(" ")
            continue
        close()
        if m[1]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name == "p":
                for i in range(len(stack) - 1, -1, -1):  # an open element of the kind ends here, unless a container stands between
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] != "p":
                        break
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if name not in VOID:
                own = [f"{w.lower()}" for x in NAMES.findall(m[3] or "") for w in re.split(r"[\s_-]+", "".join(x)) if w]
                own = list(dict.fromkeys([f"<{name}>", *own]))
                stack.append((name, (*(e for e in stack[-1][1] if e not in own), *own) if stack else tuple(own)))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close()
    return out


@lru_cache(4096)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    x = np.zeros(PATHS, np.float32)
    for depth, e in enumerate(reversed(path)):
        x[zlib.crc32(e.encode()) % PATHS] += 1.0 if depth < 8 else 0.5
    return x


def block_vectors(blocks: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for i, (text, path, linked) in enumerate(blocks):
        x[i, :PATHS] = _path_vector(path)
        words = text.lower().encode("utf-8", "replace").split()
        x[i, PATHS : PATHS + WORDS] = np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS) * (0.1 / len(words) ** 0.5)
        n = len(text)
        x[i, -NUMBERS:] = np.log1p(n) / 5, min(1.0, linked / n), min(1.0, sum(map(text.count, ".,;:!?")) / n * 10), i / len(blocks), (len(blocks) - i) / len(blocks), 1.0
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors; pages of a batch are padded to one length and masked."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.normal(size=s) / s[0] ** 0.5).astype(np.float64)
        self.p = {"out": np.zeros(2 * HIDDEN + WIDTH)}
        for d in "fb":
            self.p |= {f"x{d}": scale(WIDTH, 4 * HIDDEN), f"h{d}": scale(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        n, steps = mask.shape
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        out = np.zeros((n, steps, HIDDEN), x.dtype)
        fed = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fed[:, t] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            m = mask[:, t : t + 1]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            h, c = np.where(m, o * tanh, h), np.where(m, new, c)
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        runs = [self._run(d, x, mask, keep.setdefault(d, []) if keep is not None else None) for d in "fb"]
        full = np.concatenate([*runs, x], axis=2)
        if keep is not None:
            keep["full"] = full
        return full @ self.p["out"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        error = np.where(mask, _sigmoid(self.logits(x, mask, keep)) - y, 0) / mask.sum()
        grads = {"out": np.einsum("nt,ntk->k", error, keep["full"])}
        for k, d in enumerate("fb"):
            back = error[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            gx, gh, gc = (np.zeros_like(self.p[f"{w}{d}"]) for w in "xhc")
            for t, h, c, i, f, o, g, tanh, m in reversed(keep[d]):
                dh = dh + back[:, t]
                own_h, own_c = np.where(m, dh, 0), np.where(m, dc, 0)
                own_c = own_c + own_h * o * (1 - tanh * tanh)
                dz = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * tanh * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
                gx += x[:, t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dh = np.where(m, 0, dh) + dz @ self.p[f"h{d}"].T
                dc = np.where(m, 0, dc) + own_c * f
            grads |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 40, rate: float = 0.012) -> None:
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for at in range(0, len(pages), batch):
                x, mask = padded([p[0] for p in pages[at : at + batch]])
                y = np.zeros(mask.shape)
                for row, (_, labels) in zip(y, pages[at : at + batch], strict=True):
                    row[: len(labels)] = labels
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = g + 1e-4 * self.p[k]
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Pages of similar length go through together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            x, mask = padded([pages[i] for i in some], np.float32)
            for i, row in zip(some, self.logits(x, mask), strict=True):
                out[i] = row[: len(pages[i])] > 0
        return out


def padded(pages: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, WIDTH), kind), np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def site_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page laid out from templates, and its main blocks in order."""
    letters = rng.choice(["abcdefghilmnoprstu", "aeiountrslé", "üäöchenrstiu"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice([".", ".", "", "?", " %%%"])
    main: list[str] = []

    def kept(text: str) -> str:
        main.append(" ".join(text.split()))
        return text

    def pick(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' class="{name} {word()}"'])

    def nested(inner: str) -> str:
        """Now and then the inside of a container stands many elements deeper."""
        if rng.random() < 0.9:
            return inner
        depth = rng.randrange(2, 40)
        named = [pick("wrapper", "row", "col", "inner", "grid") if rng.random() < 0.3 else "" for _ in range(depth)]
        return "".join(f"<div{n}>" for n in named) + inner + "</div>" * depth

    def box(tag: str, inner: str, *names: str, plain: bool = False) -> str:
        if tag not in ("p", "ul", "ol"):
            inner = nested(inner)
        return f"<{tag}{'' if plain and (rng.random() < 0.6 or not names) else pick(*names) if names else ''}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}{rng.choice(["", "", ",", "."])}</a></li>' for _ in range(n)) + "</ul>"

    def prose() -> str:
        text = kept(sentence(*rng.choice([(1, 4), (3, 12), (10, 60), (40, 160)])))
        kind = rng.random()
        if kind < 0.12:
            text = f"<b>{text}"
        elif kind < 0.25 and " " in text:
            head, _, tail = text.partition(" ")
            text = f'<a href="#">{head}</a> <em>{tail}</em>'
        end = rng.choice(["</p>", "</p>", "<br>", ""])
        return f"<p>{text}{end}"

    def extra() -> str:
        kind = rng.randrange(6)
        if kind == 0:
            return f"<h{(n := rng.randrange(2, 5))}>{kept(words(2, 8))}</h{n}>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{kept(sentence(2, 15))}</li>" for _ in range(rng.randrange(2, 5))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{kept(sentence(5, 30))}</p></blockquote>"
        if kind == 3:
            return f"<figure><img src=x><figcaption>{kept(sentence(3, 10))}</figcaption></figure>"
        if kind == 4:
            return "<table><tr>" + "".join(f"<td>{kept(words(1, 4))}</td>" for _ in range(3)) + "</tr></table>"
        return junk(inside=True)

    def junk(inside: bool = False) -> str:
        kind = rng.choice(["ad", "ad", "notice", "side", "form", "share"] + ([] if inside else ["menu", "crumbs", "told"]))
        text = rng.choice([sentence(3, 12), sentence(10, 40)])
        if kind == "ad":
            return box(rng.choice(["div", "div", "section", "p"]), rng.choice([text, f"<p>{text}</p>"] if rng.random() < 0.9 else [text]), "ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "advertisement")
        if kind == "notice":
            return box("div", f"<p>{text}</p>" + rng.choice(["", f"<button>{word()}</button>"]), "cookie-notice", "notice", "consent", "alert", "newsletter", "popup", "gdpr", "cookie-banner", "subscribe")
        if kind == "side":
            return box(rng.choice(["aside", "aside", "div", "section"]), f"<h3>{words(1, 4)}</h3>" + rng.choice([links(4), f"<p>{text}</p>"]), "sidebar", "related", "widget", "teaser", "recommended", plain=False) if rng.random() < 0.6 else f"<aside><p>{text}</p></aside>"
        if kind == "form":
            return box("form", f"<label>{words(1, 4)}</label><input><p>{sentence(2, 10)}</p><button>{word()}</button>", "search", "contact", "login", "signup", plain=True)
        if kind == "told":  # paragraphs where one would look for links
            told = "".join(f"<p>{sentence(*rng.choice([(3, 12), (10, 60)]))}</p>" for _ in range(rng.randrange(2, 5)))
            return box(rng.choice(["nav", "aside", "aside", "div"]), rng.choice(["", f"<h3>{words(1, 4)}</h3>"]) + told, "sidebar", "nav", "menu", "related") if rng.random() < 0.5 else rng.choice([f"<nav>{told}</nav>", f"<aside>{told}</aside>"])
        if kind == "share":
            return box("div", links(3), "share", "social", "tags", "author-links")
        if kind == "menu":
            return box(rng.choice(["nav", "nav", "div", "ul"]), links(rng.randrange(3, 9)), "menu", "nav", "navigation", "navbar", plain=True) if rng.random() < 0.7 else f"<nav>{links(6)}</nav>"
        return box(rng.choice(["div", "nav", "ol"]), f"<a href=/>{word()}</a> &gt; <a href=/x>{words(1, 3)}</a>", "breadcrumb", "breadcrumbs", "crumbs")

    def comments() -> str:
        one = lambda: box(rng.choice(["div", "li", "article"]), f"<h4>{words(1, 3)}</h4><p>{sentence(3, 40)}</p>" + rng.choice(["", f"<a href=#>{word()}</a>"]), "comment", "reply", "comment-body")
        return box(rng.choice(["section", "div", "ol"]), f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randrange(1, 5))), "comments", "commentlist", "comment-list", "discussion", "responses")

    alone = rng.random() < 0.1  # a page of hardly anything else
    top = ""
    if rng.random() < 0.5:
        top += box("header", f"<div{pick('logo', 'site-title', 'brand')}>{words(1, 3)}</div>" + rng.choice(["", f"<p>{sentence(3, 9)}</p>"]) + rng.choice(["", links(5)]), "header", "site-header", "masthead", "top", plain=True)
    if rng.random() < 0.75:
        top += f"<nav>{links(rng.randrange(3, 9))}</nav>" if rng.random() < 0.6 else junk()
    top += "".join(junk() for _ in range(rng.choice([0, 0, 1, 1, 2])))
    title = f"<h1>{kept(sentence(2, 12))}</h1>" if rng.random() < (0.4 if alone else 0.85) else ""
    title, body = ("", title) if rng.random() < 0.85 else (title, "")  # now and then it stands before the container
    for _ in range(rng.choice([1, 2, 2, 3] if alone else [1, 2, 4, 8, 14])):
        body += prose() if rng.random() < (0.95 if alone else 0.78) else extra()
    inner_comments = comments() if rng.random() < 0.15 and not alone else ""
    wrap = rng.choice(["article", "article", "article", "main", "div", "section", "none", "none", "plain", "plain", "unknown", "unknown", "cell"])
    body = nested(body) if wrap != "none" else body
    if wrap == "article" or (wrap == "main" and rng.random() < 0.6):
        body = f"<{wrap}{rng.choice(['', '', pick('post', 'article', 'entry', 'story')])}>{body}{inner_comments}</{wrap}>"
    elif wrap == "none":
        body += inner_comments
    elif wrap == "plain":
        body = f"<div>{body}{inner_comments}</div>"
    elif wrap == "unknown":
        body = box(rng.choice(["div", "div", "section"]), body + inner_comments, word(), f"{word()}-{word()}__{word()}", f"{word()}_{word()}", "main", "page", "inner", "body")
    elif wrap == "cell":
        body = f"<table><tr><td>{links(4)}</td><td>{body}{inner_comments}</td></tr></table>"
    else:
        body = box(wrap, body + inner_comments, "content", "post-body", "article-body", "entry-content", "main-content", "post-content", "article", "story", "text")
    if rng.random() < 0.3 and wrap != "none":
        body = box("main", body, plain=True) if wrap != "main" else f'<div class="wrapper">{body}</div>'
    body = title + body
    after = "".join(junk() for _ in range(rng.choice([0, 0, 1, 2]))) + (comments() if rng.random() < 0.3 else "")
    if alone:
        top, after = "", ""
    foot = box("footer", rng.choice([f"&copy; {word()}.com &middot; {sentence(3, 20)}", f"<p>{sentence(3, 15)}</p>{links(3)}"]), "footer", "site-footer", plain=True) if rng.random() < 0.8 else box("div", f"&copy; {words(2, 12)}", "footer", "copyright", "legal")
    foot = "" if alone and rng.random() < 0.7 else foot
    end = rng.choice(["</body></html>", "</body></html>", ""])
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{top}<!-- {word()} -->{body}{after}{foot}{end}", main


@cache
def labeller(sites: int = SITES, seed: int = 17) -> Labeller:
    rng = random.Random(seed)
    pages = []
    for _ in range(sites):
        page, main = site_page(rng)
        blocks = leaf_blocks(page)
        labels, k = [], 0
        for text, _, _ in blocks:  # main blocks come in order; those of other parts that read the same are rare
            labels.append(float(k < len(main) and text == main[k]))
            k += int(labels[-1])
        pages.append((block_vectors(blocks), np.array(labels)))
    model = Labeller()
    model.train(pages)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    model = model or labeller()
    weights = {k: v.astype(np.float32) for k, v in model.p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = weights
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                blocks = [leaf_blocks(t.as_py()) for t in some.column("html")]
                chosen = own.labels([block_vectors(b) for b in blocks])
                texts = ["\n".join(b[0] for b, keep in zip(bs, ks, strict=True) if keep) for bs, ks in zip(blocks, chosen, strict=True)]
                yield pa.record_batch([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return source.mapInArrow(run, TEXTS)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
