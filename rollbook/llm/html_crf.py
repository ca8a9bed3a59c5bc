"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)                                                        # a comment
      |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      |<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*+)(?:>|\Z)       # a tag with an open quote or no end
      |<[!?][^>]*>?
      |(?P<text>[^<]++|<)""",
    re.S | re.X,
)
ATTR = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")
#: Elements that hold no markup, and whose content is never shown: up to the end tag or the end of the page.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title")}
#: Elements that hold markup, and whose content is not shown as text.
HIDDEN = frozenset("noscript template svg iframe object canvas annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of the values.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}

#: Labelled pages on which the field is trained, and the seed they are made with.
TRAIN_PAGES = 300
SEED = 11


def _names(attrs: str) -> tuple[tuple[str, ...], str | None]:
    """Words of an element's class, id and role, and its label if it has one."""
    found, label = [], None
    for m in ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-y":
            label = value
        else:
            found += NAME_PART.findall(value.lower())
    return tuple(dict.fromkeys(found)), label


class Place:
    """An open block element of a page: the element around it, the features it is the first to bring, and those of its own."""

    __slots__ = ("around", "fresh", "own")

    def __init__(self, around: "Place | None", fresh: tuple[str, ...], own: tuple[str, ...]):
        self.around, self.fresh, self.own = around, fresh, own


def leaf_blocks(page: str | None) -> list[tuple[tuple, str, float, str | None]]:
    """(path, text, share of the text in links, label) of each block of a page, in page order.

    A block is the text between two tags of block elements; inline elements stay inside. The path is (place,) of the innermost
    open block element, () outside of all; a place points at the one around it, so that pages of any depth cost their length.
    The text of a hidden element is dropped at its end tag; one that is not closed before the element around it hides
    nothing. References are decoded, white space is one space.
    """
    out: list[tuple[tuple, str, float, str | None]] = []
    if not page:
        return out
    #: Open block elements: tag, name words, the label that holds in it, and its place.
    stack: list[tuple[str, tuple[str, ...], str | None, Place]] = []
    opened: Counter = Counter()
    #: The text of the block begins at begun; what is before it is kept while a hidden element is open, which may give it back.
    text: list[str] = []
    begun = 0
    linked = [0]
    in_link = 0
    #: Open hidden elements: tag, open elements around it, and blocks, text, begin of the block, and links before it.
    hidden: list[tuple[str, int, int, int, int, int, int]] = []
    covered: Counter = Counter()
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal begun
        if len(text) > begun:
            words = " ".join(_html.unescape("".join(text[begun:])).split())
            if words:
                path, label = ((stack[-1][3],), stack[-1][2]) if stack else ((), None)
                out.append((path, words, min(1.0, linked[0] / len(words)), label))
        if not hidden:
            text.clear()
        begun = len(text)
        linked[0] = 0

    def close(depth: int) -> None:
        for entry in stack[depth:]:
            opened["in " + entry[0]] -= 1
            for w in entry[1]:
                opened["name " + w] -= 1
        del stack[depth:]

    def uncover(k: int) -> None:
        for entry in hidden[k:]:
            covered[entry[0]] -= 1
        del hidden[k:]

    while pos < n:
        m = TOKEN.match(page, pos)
        if m is None:
            break
        pos = m.end()
        piece = m["text"]
        if piece is not None:
            text.append(piece)
            if in_link:
                linked[0] += len(piece.strip())
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag == "a":
                in_link = 0
            elif tag in HIDDEN:
                for k in range(len(hidden) - 1, -1, -1) if covered[tag] else ():
                    if hidden[k][0] == tag:
                        _, depth, blocks, end, begun, linked[0], in_link = hidden[k]
                        uncover(k)
                        close(depth)
                        del out[blocks:]
                        text[end:] = [" "]
                        break
            elif tag not in INLINE:
                flush()
                for k in range(len(stack) - 1, -1, -1) if opened["in " + tag] else ():
                    if stack[k][0] == tag:
                        close(k)
                        in_link = 0
                        # Hidden elements lie in one another, so those inside what is closed are the last.
                        while hidden and hidden[-1][1] > k:
                            uncover(len(hidden) - 1)
                        break
            continue
        foreign = tag in ("svg", "math") or covered["svg"] > 0
        if foreign and (m["attrs"] or m["attrs2"] or "").endswith("/"):
            text.append(" ")
            continue
        if tag in RAW:
            end = RAW[tag].search(page, pos)
            pos = end.end() if end else n
            text.append(" ")
            continue
        if tag in HIDDEN:
            hidden.append((tag, len(stack), len(out), len(text), begun, linked[0], in_link))
            covered[tag] += 1
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        floor = hidden[-1][1] if hidden else 0
        if len(stack) > floor and stack[-1][0] == "p":
            close(len(stack) - 1)
        while len(stack) > floor and stack[-1][0] in CLOSES.get(tag, ()):
            close(len(stack) - 1)
        if tag not in VOID and tag not in ("html", "body", "head"):
            names, label = _names(m["attrs"] or m["attrs2"] or "")
            label = stack[-1][2] if label is None and stack else label
            brings = ("in " + tag, *("name " + w for w in names))
            fresh = tuple(f for f in brings if not opened[f])
            opened.update(brings)
            named = bool(names) or bool(stack) and stack[-1][3].own[-1] == "named"
            pair = f"{stack[-1][0]}/{tag}" if stack else tag
            own = (*("own " + w for w in names), f"tag {tag}", f"tags {pair}", "named" if named else "unnamed")
            stack.append((tag, names, label, Place(stack[-1][3] if stack else None, fresh, own)))
    flush()
    return out


#: Features of a block outside of all block elements.
NOWHERE = ("in none", "tag none", "tags none", "unnamed")


def path_features(path: tuple) -> tuple[str, ...]:
    """Features of the ancestors: their tags and name words, the innermost element's words, tag and two tags, and if any is named."""
    if not path:
        return NOWHERE
    chain, place = [], path[0]
    while place is not None:
        chain.append(place.fresh)
        place = place.around
    return (*(f for fresh in reversed(chain) for f in fresh), *path[0].own)


def text_features(text: str, linked: float) -> tuple[str, ...]:
    """Features of the text: length, links, sentence end, signs that footers and menus have."""
    n = text.count(" ") + 1
    size = "1" if n == 1 else "2-4" if n < 5 else "5-11" if n < 12 else "12-29" if n < 30 else "30+"
    links = "none" if linked == 0 else "some" if linked < 0.5 else "most"
    end = "stop" if text[-1] in ".!?\"'”»…" else "other"
    more = ["copyright"] if "©" in text or "copyright" in text[:40].lower() else []
    return (f"words {size}", f"links {links}", f"end {end}", f"words {size} links {links} end {end}", *more)


class Field:
    """A trained field: features by name, emission weights (feature, 2), transitions (2, 2) and first states (2)."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.index, self.emit, self.move, self.first = index, emit, move, first
        self.sums: dict[tuple[str, ...], np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "sums": {}}

    def _sum(self, names: tuple[str, ...]) -> np.ndarray:
        found = self.sums.get(names)
        if found is None:
            if len(self.sums) > 50_000:
                self.sums.clear()
            ids = [self.index[f] for f in names if f in self.index]
            found = self.sums[names] = self.emit[ids].sum(axis=0) if ids else np.zeros(2)
        return found

    def scores(self, blocks: list) -> np.ndarray:
        """Emission scores (block, 2): each place adds what it brings to the sum of the place around it."""
        out = np.zeros((len(blocks), 2))
        sums: dict[Place | None, np.ndarray] = {None: np.zeros(2)}
        for k, (path, text, linked, _) in enumerate(blocks):
            chain, place = [], path[0] if path else None
            while place not in sums:
                chain.append(place)
                place = place.around
            for place in reversed(chain):
                sums[place] = sums[place.around] + self._sum(place.fresh)
            out[k] = sums[path[0]] + self._sum(path[0].own) if path else self._sum(NOWHERE)
            out[k] += self._sum(text_features(text, linked))
        return out

    def decode(self, pages: list[list]) -> list[np.ndarray]:
        """The most probable labels of each page's blocks (Viterbi); of equal ones the boilerplate label."""
        lengths = np.array([len(p) for p in pages], np.int64)
        if not lengths.sum():
            return [np.zeros(0, np.int64) for _ in pages]
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max())
        alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
        emit = [self.scores(pages[k]) for k in order]
        begin = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
        flat = np.concatenate([e for e in emit if len(e)])
        back = np.zeros((len(flat), 2), np.int64)
        score = self.first + flat[begin[: alive[0]]]
        final = np.zeros((len(pages), 2))
        final[: alive[0]] = score
        for t in range(1, longest):
            a = alive[t]
            through = score[:a, :, None] + self.move[None]
            best = through.argmax(axis=1)
            back[begin[:a] + t] = best
            score = np.take_along_axis(through, best[:, None, :], axis=1)[:, 0] + flat[begin[:a] + t]
            final[:a] = score
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
        for j, k in enumerate(order):
            labels = np.zeros(lengths[k], np.int64)
            state = int(final[j].argmax())
            for t in range(lengths[k] - 1, -1, -1):
                labels[t] = state
                state = int(back[begin[j] + t, state])
            out[k] = labels
        return out


def train(pages: list[list], l2: float = 0.02, rounds: int = 110, rate: float = 0.15) -> Field:
    """Fits a field to labelled pages (lists of blocks whose label is '1' or '0') by gradient ascent on the likelihood.

    Pages without a block teach nothing; of no others comes a field without features, which takes no block for the article.
    """
    pages = [p for p in pages if p]
    if not pages:
        return Field({}, np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2))
    names = [[(*path_features(b[0]), *text_features(b[1], b[2])) for b in p] for p in pages]
    index = {f: k for k, f in enumerate(sorted({f for p in names for b in p for f in b}))}
    longest = max(map(len, pages))
    x = np.zeros((len(pages), longest, len(index)), np.float32)
    y = np.zeros((len(pages), longest), np.int64)
    mask = np.zeros((len(pages), longest), bool)
    for i, (p, fs) in enumerate(zip(pages, names, strict=True)):
        for t, (b, f) in enumerate(zip(p, fs, strict=True)):
            x[i, t, [index[g] for g in f]] = 1
            y[i, t] = int(b[3] or 0)
            mask[i, t] = True
    onehot = np.eye(2)[y] * mask[..., None]
    pairs = mask[:, 1:] & mask[:, :-1]
    emit, move, first = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    params = [emit, move, first]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    flat = x[mask]
    seen_moves = np.einsum("ita,itb->ab", onehot[:, :-1] * pairs[..., None], onehot[:, 1:])
    for step in range(1, rounds + 1):
        e = np.zeros((len(pages), longest, 2))
        e[mask] = flat @ emit.astype(np.float32)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = first + e[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, axis=1) + e[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2), 0.0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        node = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        edge = np.exp(fwd[:, :-1, :, None] + move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        grads = [
            (flat.T @ (onehot - node)[mask].astype(np.float32)) / len(pages) - l2 * emit,
            (seen_moves - edge.sum(axis=(0, 1))) / len(pages) - l2 * move,
            (onehot[:, 0] - node[:, 0]).sum(axis=0) / len(pages) - l2 * first,
        ]
        for p, g, m, s in zip(params, grads, moment, square, strict=True):
            m *= 0.9
            m += 0.1 * g
            s *= 0.999
            s += 0.001 * g * g
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Field(index, emit, move, first)


#: Name words of the parts of made pages; fixed values.
MAIN_NAMES = ("content", "main-content", "post-body", "entry-content", "article-body", "story", "post", "text", "page-content", "body-text")
SIDE_NAMES = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "tabs", "toc-menu", "topbar", "pagination", "site-nav", "links"),
    "header": ("header", "masthead", "site-header", "top", "branding", "logo"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon"),
    "sidebar": ("sidebar", "related", "widget", "recommended", "popular", "aside", "rail", "more-stories", "teaser", "tags"),
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "ad-slot"),
    "notice": ("cookie", "cookie-banner", "notice", "consent", "alert", "newsletter", "subscribe", "popup", "modal", "gdpr", "paywall"),
    "share": ("share", "social", "share-buttons", "follow", "byline-tools"),
    "comments": ("comments", "comment", "comment-list", "responses", "discussion", "reply", "disqus", "reader-comments", "user-comments"),
}


def made_page(seed: int) -> str:
    """A labelled page: an article in one of many layouts among menus, headers, sidebars, adverts, notices, forms and comments.

    Elements carry the label of their text in data-y. The words are random letters, so that no language is learned.
    """
    rng = np.random.default_rng([SEED, seed])
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def words(a: int, b: int) -> str:
        n = int(rng.integers(a, b + 1))
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 9)))) for _ in range(n))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(2, 14).capitalize() + "." for _ in range(int(rng.integers(a, b + 1))))

    def prose() -> str:
        if chance(0.12):
            return words(1, 3).capitalize() + "."
        if chance(0.08):
            return " | ".join(words(1, 1) for _ in range(int(rng.integers(3, 20))))
        text = sentences(1, 6) if chance(0.9) else words(5, 40)
        return text.replace(" ", " <b>", 1) + "</b>" if chance(0.1) else text.replace(" ", f' <a href="/{words(1, 1)}">', 1) + "</a>" if chance(0.06) else text

    def name(kind: str) -> str:
        value = pick(SIDE_NAMES[kind])
        value = pick((value, value, f"site-{value}", f"{value}-box", f"{value} {pick(('inner', 'wrap', 'col', 'clearfix'))}"))
        return f' {pick(("class", "class", "id"))}="{value}"'

    def links(n: int, wrap: bool = True) -> str:
        item = lambda: f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if wrap else " ".join(item() for _ in range(n))

    def side(kind: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside"}.get(kind)
        bare = tag and chance(0.6)
        tag = tag if bare else pick(("div", "div", "section", "ul" if kind == "menu" else "div"))
        head = f'<{tag} data-y="0"' + ("" if bare and chance(0.7) else name(kind)) + ">"
        few = int(rng.integers(2, 9))
        if kind == "menu":
            body = links(few, tag != "ul" and chance(0.8)) if tag != "ul" else "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(few))
        elif kind == "header":
            body = pick(("<h1>", "<div>", "<p>")) + words(1, 5) + (links(few) if chance(0.5) else "")
        elif kind == "footer":
            body = pick(("&copy; ", "", "© ")) + words(1, 3) + " " + sentences(0, 2) + (links(few, chance(0.5)) if chance(0.5) else "")
        elif kind == "sidebar":
            body = f"<h3>{words(1, 4)}</h3>" * chance(0.6) + (links(few) if chance(0.6) else f"<p>{sentences(1, 3)}</p>" * (few // 2 + 1))
        elif kind == "ad":
            body = pick((sentences(1, 2), words(2, 8), f"<p>{sentences(1, 2)}</p>", f'<a href="http://x">{sentences(1, 1)}</a>'))
        elif kind == "notice":
            body = pick((sentences(1, 3), f"<p>{sentences(1, 3)}</p>")) + f"<button>{words(1, 2)}</button>" * chance(0.6)
        elif kind == "share":
            body = links(few, chance(0.5))
        else:
            item = pick(("div", "li", "article", "p"))
            one = lambda: f'<{item} class="{pick(("comment", "comment-body", "reply"))}">{"<b>" + words(1, 2) + "</b> " if chance(0.5) else ""}{sentences(1, 4)}</{item}>'
            body = f"<h3>{words(1, 3)}</h3>" * chance(0.7) + "".join(one() for _ in range(few))
        return head + body + f"</{tag}>"

    def form() -> str:
        return f'<form data-y="0"{name("notice") if chance(0.3) else ""}><label>{words(1, 3)}</label><input type="text"><p>{words(2, 9)}</p><select><option>{words(1, 1)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button></form>'

    def article() -> str:
        tag = pick(("article", "article", "article", "main", "div", "section", "div"))
        named = tag in ("div", "section") or chance(0.2)
        out = [f'<{tag} data-y="1"' + (f' {pick(("class", "id"))}="{pick(MAIN_NAMES)}"' if named and chance(0.9) else "") + ">"]
        if chance(0.85):
            title = f"<h1>{words(2, 12)}</h1>"
            out.append(f"<header>{title}</header>" if chance(0.12) else title)
        for _ in range(int(rng.integers(2, 14))):
            kind = rng.random()
            if kind < 0.78:
                out.append(f"<p>{prose()}" + pick(("</p>", "</p>", "</p>", "", "<br>")))
            elif kind < 0.85:
                out.append(f"<h2>{words(1, 8)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{words(2, 14)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote><p>{sentences(1, 3)}</p></blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                out.append(f"<div>{sentences(1, 4)}</div>")
            else:
                out.append(side(pick(("ad", "share", "notice", "sidebar"))))
        return "".join(out) + f"</{tag}>"

    before = [side(k) for k in ("menu", "header", "notice", "ad", "sidebar", "share") if chance(0.45)] + ([form()] if chance(0.15) else [])
    after = [side(k) for k in ("comments", "sidebar", "ad", "notice", "share", "menu") if chance(0.4)] + ([form()] if chance(0.25) else [])
    rng.shuffle(before)
    rng.shuffle(after)
    if chance(0.85):
        after.append(side("footer"))
    wrap = ("<div class=\"wrapper\">", "</div>") if chance(0.2) else ("", "")
    return f"<html><head><title>{words(2, 6)}</title></head><body>{wrap[0]}{''.join(before)}{article()}{''.join(after)}{wrap[1]}</body></html>"


@lru_cache(maxsize=1)
def default_field(pages: int = TRAIN_PAGES) -> Field:
    """The field trained on made pages; the same for the same number of pages."""
    return train([leaf_blocks(made_page(k)) for k in range(pages)])


def extract(pages: DataFrame, field: Field | None = None, html: str = "html", added: str = "text") -> DataFrame:
    """pages with the main text of html added: the blocks that the field takes for the article, joined by one space.

    Null, empty and text-free pages, and pages without a block of the article: the empty text. Whole pages are read, of any
    length. A column named like the added one is replaced; other columns stay. Row-local: no shuffle.
    """
    pages = pages.drop(added)
    at = pages.columns.index(html)
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                blocks = [leaf_blocks(p) for p in b.column(at).to_pylist()]
                labels = shared.value.decode(blocks)
                text = [" ".join(x[1] for x, y in zip(p, ys, strict=True) if y) for p, ys in zip(blocks, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, added])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(added, T.StringType())]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.selectExpr("page_id", "url", "text", "cast(length(text) AS bigint) AS n_chars")
