"""Main text of web pages by a tree-structured graphical model over the DOM.

The block elements of a page are the nodes; inline elements belong to the block around them. A node is
content if main text stands in or below it. Its own features (tag, words of class, id and role, whether it
holds prose, length, share of links, place) and a parent-child potential define the model; messages passed from the
leaves to the root and back give each node's marginal, exactly and for all pages of a batch at once,
level by level. The weights maximise the likelihood of labelled pages: generated site layouts
whose labels are known by construction, and a bounded sample (TRAIN_PAGES, of TRAIN_CHARS together) of the input's own
pages in which semantic elements (article, main against nav, aside, footer, form, ...) give the labels. Sidebars, forms, menus,
footers and dialogs are ruled out, wherever they stand, unless an article, a main part or a first heading is in them.

Text of a content node is kept whole: character references decoded, white space inside a block made one
space, blocks in page order joined by a line feed. What browsers never show as text (HIDDEN: scripts, styles,
templates, the head, fallbacks of media) and form controls don't count; everything else is up to the model.
Pages are read in one pass with the open elements counted by tag, so time is linear in their length
however deep or unclosed the markup is; nodes nested deeper than DEEPEST become siblings, as in browsers.
Null or empty html gives an empty text; cut-off pages are read as far as they go, equal pages give equal texts, repeated
rows their row each. Columns named text or n_chars give way to the results. An empty table gives none.
"""

from __future__ import annotations

import html as references
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS, KEEP, DEEPEST = 200, 20_000_000, 1600, 0.5, 512
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3
#: Log-odds against what can't be.
RULED_OUT = 60.0

#: Elements of HTML by how they are read.
RAW = frozenset("script style template textarea title iframe xmp noembed noframes".split())
HIDDEN = (RAW - {"xmp"}) | frozenset("head select button audio video canvas datalist annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input math".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An opening tag ends open ones of these kinds, no further up than the given elements.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Semantic elements that label the sampled pages.
MAIN, ASIDE = frozenset({"article", "main"}), frozenset({"nav", "aside", "footer", "form", "header", "menu", "dialog", "search"})

#: Elements that hold no main text, unless an article, a main part or a first heading stands in them (a form around a whole page).
NEVER, UNLESS = frozenset("aside form nav footer menu dialog search".split()), frozenset("article main h1".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S
)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_WORD = re.compile(r"[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])|[A-Z][^\W\d_A-Z]*")
#: Last words of names that say nothing of what a box holds.
BOXES = frozenset("wrap wrapper box inner outer area block container section item holder pane panel row col column group".split())
#: Characters from which a node can hold prose.
PROSE = 60
HIDES = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)


class Page:
    """Block nodes of a page: tag, parent, depth, words of their names; and its text blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.names = ["#root"], [-1], [0], [()]
        self.chars, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the node that each belongs to
        places: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
        blocks = [0]  # places of those that aren't inline
        hidden = links = formulas = 0
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = " ".join(references.unescape("".join(text)).split())
                text.clear()
                if joined:
                    node = stack[-1][1]
                    self.blocks.append((node, joined))
                    self.chars[node] += len(joined)

        def opened(tag: str, node: int, inline: bool) -> None:
            nonlocal hidden, links, formulas
            places.setdefault(tag, []).append(len(stack))
            if not inline:
                blocks.append(len(stack))
            stack.append((tag, node))
            hidden += tag in HIDDEN
            links += tag == "a"
            formulas += tag == "math"

        def close(to: int) -> None:
            nonlocal hidden, links, formulas
            while len(stack) > to:
                tag, _ = stack[-1]
                if blocks[-1] == len(stack) - 1:
                    flush()
                    blocks.pop()
                stack.pop()
                places[tag].pop()
                hidden -= tag in HIDDEN
                links -= tag == "a"
                formulas -= tag == "math"

        def place(tag: str) -> int:
            """Place of the innermost open element of the tag, 0 if there is none."""
            own = places.get(tag)
            return own[-1] if own else 0

        def last(kinds: frozenset | set, stop: frozenset | set) -> int:
            k = max(map(place, kinds))
            return k if k > max(map(place, stop), default=0) else 0

        at, n = 0, len(source)
        while at < n:
            m = MARKUP.search(source, at)
            chunk = source[at : m.start() if m else n]
            if chunk and not hidden:
                text.append(chunk)
                if links:
                    self.linked[stack[-1][1]] += len(chunk)
            if not m:
                break
            at = m.end()
            tag = m[2] and m[2].lower()
            if not tag:
                continue
            if m[1]:
                if tag == "p" and not place("p"):
                    flush()
                k = place(tag)
                if k and (blocks[-1] <= k or tag not in INLINE):
                    close(k)
                continue
            if tag in CLOSES_P and (k := last({"p"}, {"table", "td", "th", "button"})):
                close(k)
            if tag in IMPLIED and (k := last(*IMPLIED[tag])):
                close(k)
            if tag == "body" and (k := place("head")):
                close(k)
            if tag == "br":
                text.append(" ")
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            rest = m[3] or ""
            if tag in INLINE or formulas:
                if not (formulas and rest.endswith("/")):
                    opened(tag, stack[-1][1], True)
                continue
            flush()
            if tag in RAW:  # ends at its own closing tag only
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                stop = source.find(">", end.start()) if end else -1
                if tag != "xmp":
                    at = stop + 1 if stop >= 0 else n
                    continue
                # Shown as it stands, markup and all: a block of its own.
                raw, at = source[at : end.start() if end else n], stop + 1 if stop >= 0 else n
            if rest.endswith("/") and tag not in CLOSES_P:
                continue
            up = stack[-1][1]
            while self.depth[up] >= DEEPEST:
                up = self.parent[up]
            names: list[str] = []
            if rest:
                for value in NAMES.finditer(rest):
                    names += (value[1] or value[2] or value[3] or "").split()
                if HIDES.search(rest):
                    names.append("#hidden")
            self.tag.append(tag)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.names.append(tuple(names))
            self.chars.append(0)
            self.linked.append(0)
            opened(tag, len(self.tag) - 1, False)
            if tag == "xmp":
                if not hidden:
                    text.append(references.escape(raw))
                close(len(stack) - 1)
        close(1)
        flush()

    def never(self) -> list[int]:
        """Nodes that can't be content: NEVER elements without an UNLESS element in them."""
        excused = [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            if excused[i] or self.tag[i] in UNLESS:
                excused[self.parent[i]] = True
        return [i for i, tag in enumerate(self.tag) if tag in NEVER and not excused[i]]

    def features(self) -> list[list[str]]:
        """Names of the features of each node."""
        n = len(self.tag)
        chars, linked = list(self.chars), list(self.linked)
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        out = []
        inside, piece = [False] * n, [False] * n
        prosaic = [c >= PROSE and a < 0.4 * c for c, a in zip(chars, linked)]
        heads, beside = [0] * n, [0] * n  # children that are headings, that hold prose
        for i in range(1, n):
            heads[self.parent[i]] += self.tag[i] in HEADINGS
            beside[self.parent[i]] += prosaic[i]
        twins: dict[tuple, int] = {}
        for i in range(1, n):
            if self.names[i]:
                key = (self.parent[i], self.tag[i], self.names[i])
                twins[key] = twins.get(key, 0) + 1
        for i in range(n):
            up = self.parent[i]
            inside[i] = up >= 0 and (inside[up] or self.tag[up] in MAIN)
            piece[i] = up >= 0 and (piece[up] or self.tag[up] == "article")
            share = linked[i] / chars[i] if chars[i] else 0.0
            prose = "prose" if chars[i] >= PROSE and share < 0.4 else "links" if share >= 0.4 else "short"
            where = "in" if inside[i] else "out of"
            own = [
                "tag " + self.tag[i],
                f"tag {self.tag[i]} {where} main",
                f"links {min(4, int(share * 5))}",
                f"chars {min(7, chars[i].bit_length() // 2)}",
                f"own {min(7, self.chars[i].bit_length() // 2)} links {min(4, int(share * 5))}",
                f"{prose} {where} main",
                f"part {min(4, 5 * chars[i] // max(1, chars[0]))} {where} main {prose}",
            ]
            if up >= 0:
                # How much prose stands beside the node, and beside the one it is in.
                near, above = min(3, beside[up] - prosaic[i]), min(3, beside[self.parent[up]] - prosaic[up]) if up else 0
                own += [f"beside {near} {prose}", f"beside {near} {prose} {self.tag[i]} {'named' if self.names[i] else 'bare'}", f"above {above} beside {near} {prose}"]
            if self.tag[i] == "header":
                own.append(f"header {min(1, heads[i])} {where} main {prose}")
            if piece[i] and self.tag[i] == "article":
                own.append("article in article")
            if self.names[i]:
                own.append(f"twins {min(3, twins.get((up, self.tag[i], self.names[i]), 1))} {where} main")
            strange = bool(self.names[i])
            for name in set(self.names[i]):
                # A compound is named by its last word, share-buttons, share-price, but for words that name any box.
                parts = [w.lower() for w in NAME_WORD.findall(name)] or [name]
                while len(parts) > 1 and parts[-1] in BOXES:
                    parts.pop()
                strange &= parts[-1] not in LISTED
                own += ["name " + parts[-1], "name " + parts[-1].rstrip("s"), f"stem {parts[-1][:5]}", f"{prose} {where} main stem {parts[-1][:5]}"]
            if strange:  # none of its names is on a list
                near = min(3, beside[up] - prosaic[i]) if up >= 0 else 0
                own += [f"strange {prose} beside {near}", f"strange {prose} {self.tag[i]}"]
            out.append(sorted(set(own)))
        return out


class TreeModel:
    """Node weights and the parent-child potential."""

    def __init__(self, names: list[str]):
        self.number = {x: k for k, x in enumerate(names)}
        self.weight = np.zeros(len(names) + 1)
        self.edge = np.zeros((2, 2))
        self.edge[0, 1] = -RULED_OUT  # a node is content if anything below it is

    def forest(self, pages: list[Page]) -> dict[str, np.ndarray]:
        """All pages as one forest: parents, levels, and (row, feature) pairs."""
        parent, depth, row, col, never, base = [], [], [], [], [], 0
        for p in pages:
            never += [base + i for i in p.never()]
            parent += [base + x if x >= 0 else -1 for x in p.parent]
            depth += p.depth
            for i, own in enumerate(p.features()):
                got = [self.number[x] for x in own if x in self.number]
                row += [base + i] * len(got)
                col += got
            base += len(p.parent)
        depth = np.array(depth)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth)))[:-1] if base else []
        return {"parent": np.array(parent), "levels": levels, "row": np.array(row, np.int64), "col": np.array(col, np.int64), "never": np.array(never, np.int64)}

    def score(self, f: dict) -> np.ndarray:
        out = np.bincount(f["row"], self.weight[f["col"]], f["parent"].size) + self.weight[-1]
        out[f["never"]] = -RULED_OUT
        return out

    def marginals(self, f: dict, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the expected parent-child pairs: sum-product upward, then downward."""
        parent, levels = f["parent"], f["levels"]
        below = np.stack([np.zeros_like(score), score], axis=1)  # own potential and the children's messages
        up = np.zeros_like(below)  # message to the parent, by the parent's state
        for at in levels[:0:-1]:
            for s in (0, 1):
                up[at, s] = np.logaddexp(below[at, 0] + self.edge[s, 0], below[at, 1] + self.edge[s, 1])
            np.add.at(below, parent[at], up[at])
        both = below.copy()
        pairs = np.zeros((2, 2))
        for at in levels[1:]:
            above = both[parent[at]] - up[at]
            pair = above[:, :, None] + self.edge + below[at][:, None, :]
            flat = pair.reshape(-1, 4)
            top = flat.max(axis=1, keepdims=True)
            total = top + np.log(np.exp(flat - top).sum(axis=1, keepdims=True))
            pairs += np.exp(flat - total).sum(axis=0).reshape(2, 2)
            both[at] = np.logaddexp(pair[:, 0, :], pair[:, 1, :])
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs

    def fit(self, f: dict, y: np.ndarray) -> None:
        parent = f["parent"]
        inner = np.flatnonzero(parent >= 0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[parent[inner]], y[inner]), 1)
        m, v = np.zeros(self.weight.size), np.zeros(self.weight.size)
        ms, vs = np.zeros((2, 2)), np.zeros((2, 2))
        for k in range(1, ROUNDS + 1):
            p, pairs = self.marginals(f, self.score(f))
            off = y - p
            g = np.bincount(f["col"], off[f["row"]], self.weight.size) / 100 - RIDGE * self.weight
            g[-1] += off.sum() / 100
            h = (seen - pairs) / 100 - RIDGE * self.edge
            h[0, 1] = 0.0
            for grad, a, b, at in ((g, m, v, self.weight), (h, ms, vs, self.edge)):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                at += RATE * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)

    def extract(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        f = self.forest(pages)
        p, _ = self.marginals(f, self.score(f)) if pages else (np.zeros(0), None)
        out, base = [], 0
        for page in pages:
            out.append("\n".join(t for node, t in page.blocks if p[base + node] >= KEEP))
            base += len(page.tag)
        return out


#: Names that the generated layouts use, in the four languages of the documents; a choice, not a standard.
CONTENT_NAMES = (
    "content article post entry story main body text article-body post-content entry-content story-body main-content blog-post page-content prose "
    "inhalt artikel beitrag contenu texte contenido articulo texto"
).split()
OTHER_NAMES = (
    "ad ads advert advertisement adsbygoogle banner sponsor sponsored promo promotion sidebar side-bar aside menu nav navbar navigation topbar header site-header masthead "
    "footer site-footer bottom copyright cookie cookie-notice cookie-banner consent gdpr notice site-notice alert warning popup modal overlay newsletter subscribe signup login "
    "share share-buttons share-bar share-links social social-share sharing follow related related-posts related-articles recommended popular trending breadcrumb breadcrumbs pagination pager tags "
    "widget toolbar search skip disclaimer legal toc-nav links "
    "werbung anzeige hinweis seitenleiste kopf fuss leiste anmeldung impressum publicite pub avis barre pied entete abonnement "
    "publicidad anuncio aviso lateral pie cabecera suscripcion"
).split()
COMMENT_NAMES = (
    "comments comment comment-list reader-comments reply replies respond responses discussion feedback disqus thread "
    "kommentare kommentar leserkommentare diskussion commentaires commentaire reactions avis-lecteurs comentarios comentario opiniones reacties kommentarer commenti"
).split()
#: Names of boxes that belong to the text.
BOX_NAMES = "callout note tip example summary abstract lead intro definition theorem remark quote highlight infobox figure caption key-points pull-quote remark merke beispiel exemple resumen nota".split()
#: Words that end the names of sections of an article, whatever stands before them.
SECTION_WORDS = "work price period study history method result note law model rate question figure budget theory market chapter story value review".split()

LISTED = frozenset(w for name in CONTENT_NAMES + OTHER_NAMES + COMMENT_NAMES + BOX_NAMES + SECTION_WORDS for w in name.split("-"))


def layouts(seed: int, count: int) -> list[tuple[str, set[str]]]:
    """Pages of known layout: (html, marks of the main text's blocks). Marks are the blocks' first words."""
    rng = random.Random(seed)
    out = []
    syllables = "ra ne to li ka mo su ve di po".split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def block(marks: set[str] | None, tag: str, long: bool) -> str:
        mark = f"m{rng.randrange(10**9)}"
        if marks is not None:
            marks.add(mark)
        body = f"{mark} {words(rng.randint(8, 90) if long else rng.randint(0, 12))}."
        if rng.random() < 0.25:
            body += f' <a href="/x">{words(2)}</a> {words(3 if long else 0)}'
        if rng.random() < 0.2:
            body = f"<{(t := rng.choice('b i em strong span'.split()))}>{body}</{t}>"
        return f"<{tag}>{body}</{tag}>" if rng.random() < 0.85 or tag == "div" else f"<{tag}>{body}"

    def linked(n: int) -> str:
        links = [f'<a href="/{k}">{words(rng.randint(1, 3))}</a>' for k in range(n)]
        return rng.choice(["<br>", " | ", " "]).join(links) if rng.random() < 0.3 else "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"

    def inner(marks: set[str]) -> str:
        def cited(tag: str) -> str:
            """A paragraph or an item that is one link, or plain words without a tag."""
            mark = f"m{rng.randrange(10**9)}"
            marks.add(mark)
            body = f"{mark} {words(rng.randint(2, 30))}"
            return f'<{tag}><a href="/c">{body}</a></{tag}>' if tag else body

        parts = [block(marks, rng.choice(["h1", "h2"]), False)] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 9])):
            kind = rng.random()
            if kind < 0.5:
                parts.append(block(marks, "p", rng.random() < 0.85))
            elif kind < 0.53:
                parts.append(cited("p"))
            elif kind < 0.555:
                parts.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(cited("li") for _ in range(rng.randint(1, 5))) + f"</{t}>")
            elif kind < 0.575:
                parts.append("<dl>" + "".join(block(marks, "dt", False) + block(marks, "dd", rng.random() < 0.5) for _ in range(rng.randint(1, 3))) + "</dl>")
            elif kind < 0.63:
                tag, name = rng.choice(["div", "div", "section"]), rng.choice(BOX_NAMES)
                parts.append(f'<{tag} class="{name}{rng.choice(["", "", "-box", "-block"])}">' + (f"{cited('')}" if rng.random() < 0.2 else "".join(block(marks, "p", rng.random() < 0.7) for _ in range(rng.randint(1, 2)))) + f"</{tag}>")
            elif kind < 0.67:
                parts.append("<ul>" + "".join(block(marks, "li", rng.random() < 0.4) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.7:
                parts.append("<blockquote>" + block(marks, "p", True) + "</blockquote>")
            elif kind < 0.73:
                parts.append("<table><tr>" + "".join(block(marks, "td", False) for _ in range(3)) + "</tr></table>")
            elif kind < 0.75:
                parts.append(block(marks, rng.choice(["h2", "h3", "pre", "div"]), False))
            else:
                first = rng.choice(OTHER_NAMES + COMMENT_NAMES).split("-")[0] if rng.random() < 0.7 else words(1).strip()
                first = "-".join([first, words(1)][: rng.choice([1, 1, 1, 2])])
                last = rng.choice(SECTION_WORDS) if rng.random() < 0.5 else words(1)
                name = f' {rng.choice(["class", "class", "id"])}="{first}-{last}"' if rng.random() < 0.7 else ""
                tag = rng.choice(["section", "div"])
                parts.append(f"<{tag}{name}>" + block(marks, "h2", False) * (rng.random() < 0.4) + "".join(block(marks, "p", True) for _ in range(rng.randint(1, 3))) + f"</{tag}>")
        return "".join(parts)

    def comments(within: bool = False) -> str:
        """What readers wrote: often alike siblings, articles where they stand within one, with names and times, under many names."""
        tag, each = rng.choice(["div", "section", "ul", "ol"]), rng.choice(["div", "p", *["article", "article"] * within])
        each = "li" if tag in ("ul", "ol") else each
        outer = f' {rng.choice(["class", "id"])}="{rng.choice(COMMENT_NAMES)}"' if rng.random() < (0.85 if each != "article" else 0.5) else ""
        inner_name = f' class="{rng.choice(COMMENT_NAMES + ["item", "media", "row", "user", "post"])}"' if rng.random() < 0.6 else ""
        said = ""
        for _ in range(rng.randint(1, 5)):
            who = f'<span>{words(1)}</span> <time>{rng.randint(1, 28)}</time>' if rng.random() < 0.5 else ""
            what = words(rng.randint(3, 40)) + "."
            said += f"<{each}{inner_name}>{who}" + (f"<p>{what}</p>" if each != "p" and rng.random() < 0.7 else what) + ('<a href="#">Reply</a>' if rng.random() < 0.3 else "") + f"</{each}>"
        return f"<{tag}{outer}>" + (f"<h3>{words(1)}</h3>" if rng.random() < 0.4 and tag in ("div", "section") else "") + said + f"</{tag}>"

    def other() -> str:
        if rng.random() < 0.25:
            return comments()
        kind = rng.random()
        name = rng.choice(OTHER_NAMES) if rng.random() < 0.93 else words(1)
        attribute = f' {rng.choice(["class", "class", "class", "id", "role"])}="{name}{rng.choice(["", "", "-" + rng.choice(["wrap", "box", "inner", "area"])])}"'
        if kind < 0.25:
            tag = rng.choice(["nav", "header", "header", "footer", "aside", "menu"])
            if tag == "header" and rng.random() < 0.5:
                return f"<header>{rng.choice(['', '<div>', '<p>'])}{words(rng.randint(1, 4))}</header>"
            return f"<{tag}{attribute if rng.random() < 0.4 else ''}>" + (linked(rng.randint(2, 8)) if rng.random() < 0.6 else block(None, rng.choice(["p", "div", "h2", "h3"]), rng.random() < 0.4)) + f"</{tag}>"
        if kind < 0.35:
            return f"<form{attribute if rng.random() < 0.4 else ''}>" + block(None, rng.choice(["p", "label", "div"]), False) + '<input name="q"><button>Go</button></form>'
        tag = rng.choice(["div", "div", "section", "ul" if kind > 0.95 else "div"])
        if tag == "ul":
            return f"<ul{attribute}>" + "".join(block(None, "li", False) for _ in range(4)) + "</ul>"
        body = linked(rng.randint(2, 8)) if rng.random() < 0.25 else words(rng.randint(3, 40)) + "." if rng.random() < 0.4 else "".join(block(None, "p", rng.random() < 0.6) for _ in range(rng.randint(1, 5)))
        return f"<{tag}{attribute}>{body}</{tag}>"

    for _ in range(count):
        marks: set[str] = set()
        before = "".join(other() for _ in range(rng.randint(0, 4)))
        after = "".join(other() for _ in range(rng.randint(0, 4)))
        text = inner(marks)
        if rng.random() < 0.35:
            cut_at = [m.start() for m in re.finditer("<p>|<h2>", text)]
            k = rng.choice(cut_at) if cut_at else 0
            depth_free = text[:k].count("<ul>") == text[:k].count("</ul>") and text[:k].count("<section>") == text[:k].count("</section>") and text[:k].count("<blockquote>") == text[:k].count("</blockquote>")
            text = text[:k] + other() + text[k:] if depth_free else text + other()
        shape = rng.random()
        if shape < 0.35:
            text = f"<article>{text}{comments(True) if rng.random() < 0.3 else ''}</article>"
            if rng.random() < 0.3:
                text = f"<main>{text}</main>"
        elif shape < 0.5:
            text = f"<main>{text}</main>"
        else:
            # Many sites name their parts as no list knows.
            name = rng.choice(CONTENT_NAMES) if rng.random() < 0.6 else words(1)
            text = f'<div {rng.choice(["class", "id"])}="{name}">{text}</div>'
        if shape > 0.93:  # laid out by a table
            text = f"<table><tr><td>{linked(rng.randint(2, 9))}</td><td>{text}</td></tr></table>"
        page = before + text + after
        if rng.random() < 0.4:
            page = f'<div {rng.choice(["class", "id"])}="{rng.choice(["page", "wrapper", "container", "site", "layout", "row"])}">{page}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{page}</body></html>", marks))
    return out


def _labels(page: Page, content: list[bool]) -> np.ndarray:
    """Nodes in or below which a content block stands."""
    y = np.zeros(len(page.tag), np.int64)
    for (node, _), good in zip(page.blocks, content):
        while good and node >= 0 and not y[node]:
            y[node] = 1
            node = page.parent[node]
    return y


def _by_semantics(page: Page) -> list[bool] | None:
    """Labels of the blocks by the nearest semantic element; an article in an article is a comment. None if a page has no main part."""
    state, piece = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        up, tag = page.parent[i], page.tag[i]
        piece[i] = piece[up] or page.tag[up] == "article"
        state[i] = False if tag in ASIDE or tag == "article" and piece[i] else True if tag in MAIN else state[up]
    got = [state[node] for node, _ in page.blocks]
    return got if any(got) else None


def train(df: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAIN_PAGES, seed: int = 8) -> TreeModel:
    pages, labels = [], []
    for source, marks in layouts(seed, LAYOUTS):
        page = Page(source)
        pages.append(page)
        labels.append(_labels(page, [t.split(" ", 1)[0] in marks for _, t in page.blocks]))
    # The first pages by hash that fit into TRAIN_CHARS: one that doesn't is passed over, the next ones still count.
    key = F.xxhash64(id_col, html_col).alias("h")
    first = df.where(F.col(html_col).isNotNull()).select(key, F.length(html_col).cast("long").alias("n")).distinct().orderBy("h", "n").limit(most).collect()
    chosen, chars = [], 0
    for r in first:
        if chars + r["n"] <= TRAIN_CHARS:
            chosen.append(r["h"])
            chars += r["n"]
    sample = df.where(key.isin(chosen)).groupBy(key).agg(F.min(html_col).alias("html")).select("html").collect() if chosen else []
    for (source,) in sorted(sample):
        page = Page(source)
        blocks = _by_semantics(page)
        if blocks:
            pages.append(page)
            labels.append(_labels(page, blocks))
    counts: dict[str, int] = {}
    for page in pages:
        for own in page.features():
            for x in own:
                counts[x] = counts.get(x, 0) + 1
    model = TreeModel(sorted(x for x, n in counts.items() if n >= 3))
    model.fit(model.forest(pages), np.concatenate(labels))
    return model


def extract(df: DataFrame, model: TreeModel, html_col: str = "html") -> DataFrame:
    """`df` without its html, with `text` and `n_chars` (code points)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def compute(sources: list[str]) -> list[np.ndarray]:
        texts = shared.value.extract(sources)
        return [np.array(texts, object), np.array([len(t) for t in texts], np.int64)]

    return map_text(df, html_col, compute, "text string, n_chars long")
