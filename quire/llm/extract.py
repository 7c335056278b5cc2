"""Main text of web pages by boosted trees over DOM nodes (operator 4).

Every element and every loose run of text gets features: its tag, its hashed attribute
tokens (as log-odds learned for each bucket) and those of its ancestors, depth, density of text, links and tags in its subtree, and
statistics of its siblings. Boosted trees give log-odds that a node's subtree holds
main text. Decoding is hierarchical: the labelling with the highest total that never
puts a kept node under a dropped one is found by one pass up and one down the tree.

The trees are trained here, on pages composed from labelled layouts (``PAGES`` of them
from a fixed seed): the layouts vary in containers, class names, and in the menus,
headers, footers, sidebars, notices, adverts, forms and comments around the article.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import Boosted, fit
from quire.llm.common import col, small_batches
from quire.llm.dom import BLOCK, Dom, attributes

#: Bound of the training set: composed pages and their seed.
PAGES, SEED = 3000, 20

#: Buckets of hashed attribute tokens and their parts, and occurrences with which a token speaks as much as its parts.
BUCKETS, ENOUGH = 1 << 13, 8.0

# Tags whose meaning speaks for or against main text.
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset label input".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = (
    "depth good_tag bad_tag good_tokens bad_tokens over_good over_bad tag_p tag_heading tag_item tag_container tag_text tag_header in_article_header"
    " length share link_share tags_per_word words_per_block stops_per_word paragraphs position siblings alike_siblings sibling_length"
    " near_good inner_good inner_bad"
).split()


def _tokens(raw: str) -> list[str]:
    if not raw.strip():
        return []
    a = attributes(raw)
    words = _WORD.findall(_CAMEL.sub(" ", " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop"))).lower())
    if "hidden" in a or "display:none" in a.get("style", "").replace(" ", "") or a.get("aria-hidden") == "true":
        words.append("hidden")
    return words


def _buckets(token: str) -> list[int]:
    """Buckets of a token (first) and of its four-letter parts."""
    edged = f"^{token}$"
    return [zlib.crc32(x.encode()) % BUCKETS for x in (edged + "=", *(edged[i : i + 4] for i in range(len(edged) - 3)))]


class TokenWeights:
    """Log-odds of holding main text for hashed attribute tokens, learned from labelled nodes.

    A token that was seldom or never seen is judged by its four-letter parts.
    """

    def __init__(self, tokens: list[list[str]], y: np.ndarray):
        held = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for t, label in zip(tokens, y):
            if t:
                held[int(label)][np.unique(np.concatenate([_buckets(x) for x in set(t)]))] += 1
        labels_ = [label for t, label in zip(tokens, y) if t]
        base = float(np.mean(labels_)) if labels_ else 0.5
        self.seen = held[0] + held[1]
        self.odds = np.log((held[1] + 2 * base) / (held[0] + 2 * (1 - base))) - np.log(base / (1 - base)) if 0 < base < 1 else np.zeros(BUCKETS)
        self.known: dict[str, float] = {}

    def __call__(self, token: str) -> float:
        if token not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            b = _buckets(token)
            own = self.seen[b[0]] / (self.seen[b[0]] + ENOUGH)
            parts = np.mean(self.odds[b[1:]]) if len(b) > 1 else 0.0
            self.known[token] = float(own * self.odds[b[0]] + (1 - own) * parts)
        return self.known[token]


class Page:
    """Nodes of a page for the model: block elements and, beside them, loose runs of text."""

    def __init__(self, source: str):
        dom = Dom(source)
        self.blocks = dom.blocks()
        n0 = len(dom.tag)
        keep = [k == 0 or dom.tag[k] in BLOCK or dom.tag[k] not in _INLINE for k in range(n0)]
        self.node = [0] * n0
        self.tag, self.parent, self.tokens = [], [], []
        for k in range(n0):
            up = self.node[dom.parent[k]] if k else -1
            if not keep[k]:
                self.node[k] = up
                continue
            self.node[k] = len(self.tag)
            self.tag.append(dom.tag[k]), self.parent.append(up), self.tokens.append(_tokens(dom.attrs[k]))
        parents = {p for p in self.parent if p >= 0}
        self.at: list[int] = []  # node of each block of text
        for block, _ in self.blocks:
            k = self.node[block]
            if k in parents:  # loose text beside other elements is a node of its own
                k = len(self.tag)
                self.tag.append("#text"), self.parent.append(self.node[block]), self.tokens.append([])
            self.at.append(k)
        self.links = [0] * len(self.tag)
        for k in range(n0):
            self.links[self.node[k]] += dom.link[k]

    def features(self, weight: TokenWeights) -> np.ndarray:
        n = len(self.tag)
        odds = [[weight(x) for x in t] for t in self.tokens]
        own_good = [sum(x for x in w if x > 0) for w in odds]
        own_bad = [-sum(x for x in w if x < 0) for w in odds]
        parent = self.parent
        length, words, stops, count, first = ([0] * n for _ in range(5))
        total = 0
        for (_, text), k in zip(self.blocks, self.at):
            length[k] += len(text)
            words[k] += text.count(" ") + 1
            stops[k] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
            count[k] += 1
            first[k] = first[k] or total
            total += len(text)
        paras = [int(t == "p") for t in self.tag]
        link, tags = list(self.links), [1] * n
        good = [2 * (t in GOOD_TAGS) + g for t, g in zip(self.tag, own_good)]
        bad = [2 * (t in BAD_TAGS) + b for t, b in zip(self.tag, own_bad)]
        in_good, in_bad = list(good), list(bad)
        kids: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            kids[parent[k]].append(k)
        order = range(n)
        for k in reversed(order):  # children come after their parents
            p = parent[k]
            if p >= 0:
                for x in (length, words, stops, count, paras, link, tags, in_good, in_bad):
                    x[p] += x[k]
                if length[k]:
                    first[p] = min(first[p], first[k]) if first[p] else first[k]
        depth, over_good, over_bad, in_header = [0] * n, [0] * n, [0] * n, [0] * n
        for k in order[1:]:
            p = parent[k]
            depth[k] = depth[p] + 1
            over_good[k] = over_good[p] + good[p]
            over_bad[k] = over_bad[p] + bad[p] + 2 * (self.tag[p] == "header" and over_good[p] < 1)
            in_header[k] = int(in_header[p] or (self.tag[k] == "header" and over_good[k] >= 1))
        out = np.zeros((n, len(FEATURES)))
        for k in order:
            p, t = parent[k], self.tag[k]
            sib = kids[p] if p >= 0 else [k]
            ns = len(sib)
            sib_len = (length[p] - length[k]) / max(1, ns - 1) if p >= 0 else 0
            out[k] = (
                depth[k], t in GOOD_TAGS, t in BAD_TAGS, own_good[k], own_bad[k], over_good[k], over_bad[k],
                t == "p", len(t) == 2 and t[0] == "h" and t[1].isdigit(), t in ("li", "dt", "dd"), t in ("div", "section", "body", "html", "#root", "table", "td"),
                t == "#text", t == "header", in_header[k],
                np.log1p(length[k]), length[k] / max(1, total), link[k] / max(1, length[k]), tags[k] / max(1, words[k]),
                words[k] / max(1, count[k]), stops[k] / max(1, words[k]), paras[k], first[k] / max(1, total), min(ns, 50),
                0, np.log1p(sib_len), 0, in_good[k] - good[k], in_bad[k] - bad[k],
            )
        alike, near = FEATURES.index("alike_siblings"), FEATURES.index("near_good")
        for p in range(n):
            if kids[p]:
                names: dict[str, int] = {}
                for k in kids[p]:
                    names[self.tag[k]] = names.get(self.tag[k], 0) + 1
                held = sum(in_good[k] >= 1 for k in kids[p])
                for k in kids[p]:
                    out[k, alike] = min(names[self.tag[k]], 50)
                    out[k, near] = held - (in_good[k] >= 1)
        return out

    def decode(self, margin: np.ndarray) -> list[bool]:
        """Best labels under "no kept node below a dropped one"; ``margin`` are log-odds of keeping."""
        n = len(self.tag)
        keep, drop = (-np.logaddexp(0.0, -margin)).tolist(), (-np.logaddexp(0.0, margin)).tolist()
        dropped = list(drop)  # the subtree dropped whole
        kept = list(keep)  # the node kept, its children as is best
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            dropped[p] += dropped[k]
            kept[p] += max(kept[k], dropped[k])
        out = [False] * n
        for k in range(n):
            p = self.parent[k]
            out[k] = (p < 0 or out[p]) and kept[k] >= dropped[k]
        return out

    def text(self, labels: list[bool]) -> str:
        return "\n".join(t for (_, t), k in zip(self.blocks, self.at) if labels[k])


_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)


# Labelled layouts for training.


class _Composer:
    """Writes a page together with the texts of its article."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
        self.main: list[str] = []
        self.opaque = rng.random() < 0.25

    def some(self, lo: int, hi: int, end: str = ".") -> str:
        """Text of any make, whatever block it is for: also one word over and over, no stops at all, or capitals."""
        n, how = self.r.randrange(lo, hi), self.r.random()
        stops = self.r.choice([0.0, 0.1, 0.1, 0.2])
        w = [self.r.choice(self.words)] * n if how < 0.06 else [self.r.choice(self.words) + (self.r.choice(",.") if self.r.random() < stops else "") for _ in range(n)]
        mark = self.r.choice(["", "", "", "", "", "###", "$$$", "|", "!!"])
        out = " ".join(x + mark for x in w) + (end if self.r.random() < 0.8 else "")
        return out.upper() if 0.06 <= how < 0.1 else out.capitalize()

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.some(1, 3, "")}</a></li>' for i in range(n))

    def cls(self, kind: str) -> str:
        """An attribute with a name for the kind of block; some pages use none, or opaque ones."""
        how = self.r.random()
        if self.opaque and how < 0.8:
            return "" if how < 0.4 else f' class="{"".join(self.r.choices("abcdefghijkmnpqrstuvwxyz0123456789", k=6))}"'
        name = self.r.choice(_NAMES[kind].split())
        how = self.r.random()
        name = name if how < 0.5 else self.r.choice([f"site-{name}", f"{name}-wrap", f"{name} box", f"{name}_1", f"c-{name}", f"{name}s", f"mod{name.capitalize()}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def par(self, text: str, main: bool) -> str:
        if main:
            self.main.append(text)
        how = self.r.random()
        if how < 0.1:
            return f"<p><b>{text}<br>"
        if how < 0.2:
            i = text.find(" ")
            return f'<p>{text[: i + 1]}<a href="/x">{text[i + 1 :]}</a></p>' if 0 < i and self.r.random() < 0.4 else f"<p><em>{text}</em></p>"
        return f"<p>{text}</p>"

    def article(self) -> str:
        r, out = self.r, []
        title = self.some(2, 12, r.choice(["", "."]))
        self.main.append(title)
        h = f"<h1>{title}</h1>"
        out.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 30])):
            how = r.random()
            if how < 0.8:
                out.append(self.par(self.some(*r.choice([(1, 2), (1, 4), (3, 12), (20, 60), (60, 160)])), True))
            elif how < 0.87:
                t = self.some(1, 6, "")
                self.main.append(t)
                out.append(f"<h2>{t}</h2>")
            elif how < 0.93:
                items = [self.some(2, 20) for _ in range(r.randrange(1, 5))]
                self.main += items
                out.append("<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>")
            elif how < 0.97:
                t = self.some(5, 40)
                self.main.append(t)
                out.append(f"<blockquote>{t}</blockquote>")
            else:
                out.append(self.waste())
        return "".join(out)

    def waste(self) -> str:
        """Something that does not belong to the article."""
        r = self.r
        text = self.some(*r.choice([(1, 4), (4, 15), (15, 60)]))
        k = r.randrange(9)
        if k == 0:
            return f"<div{self.cls('advert')}{r.choice(['', '', '', ' hidden', ' style="display: none"'])}>{text}</div>"
        if k == 1:
            return f"<aside{self.cls('side') if r.random() < 0.6 else ''}>{self.par(text, False)}</aside>"
        if k == 2:
            return f"<div{self.cls(r.choice(['side', 'share']))}><h3>{self.some(1, 4, '')}</h3><ul>{self.links(r.randrange(1, 8))}</ul></div>"
        if k == 3:
            return f"<form action='/s'{self.cls('form') if r.random() < 0.5 else ''}><label>{self.some(1, 4, '')}</label><p>{text}</p><input name=q><button>{self.some(1, 3, '')}</button></form>"
        if k == 4:
            return f"<div{self.cls('notice')}>{self.par(text, False)}<button>OK</button></div>"
        if k in (5, 6):
            n = r.randrange(1, 6)
            inner = "".join(f"<div{self.cls('comment')}>{self.par(self.some(3, 60), False)}</div>" if r.random() < 0.6 else f"<li>{self.par(self.some(3, 60), False)}</li>" for _ in range(n))
            tag = r.choice(["div", "section", "ol"])
            return f"<{tag}{self.cls('comment')}><h3>{self.some(1, 3, '')}</h3>{inner}</{tag}>"
        if k == 7:
            return f"<nav><ul>{self.links(r.randrange(1, 9))}</ul></nav>"
        return f"<div{self.cls('menu')}>" + " ".join(f"<a href='/{i}'>{self.some(1, 3, '')}</a>" for i in range(r.randrange(1, 7))) + "</div>"

    def page(self) -> str:
        r = self.r
        before, after = [], []
        if r.random() < 0.75:
            before.append(f"<nav><ul>{self.links(r.randrange(2, 12))}</ul></nav>")
        if r.random() < 0.4:
            head = f"<a href='/'>{self.some(1, 3, '')}</a>" + (f"<h1>{self.some(1, 4, '')}</h1>" if r.random() < 0.3 else "") + (f"<p>{self.some(2, 8)}</p>" if r.random() < 0.5 else "")
            before.append(f"<header>{head}</header>" if r.random() < 0.6 else f"<div{self.cls('header')}>{head}</div>")
        before += [self.waste() for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
        r.shuffle(before)
        after += [self.waste() for _ in range(r.choice([0, 0, 1, 1, 2, 4]))]
        if r.random() < 0.85:
            foot = f"&copy; {self.some(1, 10)}" if r.random() < 0.6 else self.par(self.some(2, 30), False) + f"<ul>{self.links(3)}</ul>"
            after.append(f"<footer>{foot}</footer>" if r.random() < 0.7 else f"<div{self.cls('footer')}>{foot}</div>")
        body = self.article()
        how = r.random()
        if how < 0.45:
            body = f"<article{self.cls('article') if r.random() < 0.3 else ''}>{body}</article>"
        elif how < 0.55:
            body = f"<main>{body}</main>"
        elif how < 0.62:
            body = f"<main><article>{body}</article>{self.waste() if r.random() < 0.5 else ''}</main>"
        elif how < 0.87:
            body = f"<div{self.cls('article')}>{body}</div>"
        elif how < 0.92:
            body = f"<div>{body}</div>"
        if r.random() < 0.3:
            body = f"<div{self.cls('frame')}>" + (self.waste() if r.random() < 0.4 else "") + body + "</div>"
        head = '<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        return head + "".join(before) + body + "".join(after) + r.choice(["</body></html>", ""])


# Names that sites give to their blocks, by kind.
_NAMES = {
    "article": "article content post entry main body story text prose maincontent articlebody postcontent entrycontent artikel beitrag inhalt meldung contenu texte articulo contenido cuerpo noticia",
    "advert": "ad ads advert advertisement banner sponsor sponsored promo promotion anzeige werbung publicite reklame anuncio publicidad outbrain taboola",
    "side": "sidebar side aside rail widget related recommended teaser seitenleiste randspalte lateral colonne mehr-zum-thema",
    "share": "share sharing social follow newsletter subscribe teilen partager compartir",
    "form": "search login signup register suche anmeldung recherche connexion buscar",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay toast hinweis datenschutz avis aviso",
    "comment": "comment comments reply replies discussion disqus responses kommentar leserkommentar leserbrief forum commentaire reactions comentarios opiniones",
    "menu": "menu nav navbar navigation breadcrumb tags pagination pager toolbar menue brotkrumen fil-ariane migas navegacion",
    "header": "header head masthead topbar kopf entete cabecera",
    "footer": "footer foot copyright legal colophon fuss impressum pied mentions pie",
    "frame": "container wrapper row layout grid page wrap col",
}
_SYLLABLES = "the an er re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()


def composed(pages: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Pages with the blocks of their articles, in page order."""
    out = []
    for i in range(pages):
        c = _Composer(random.Random(seed * 100_003 + i))
        out.append((c.page(), c.main))
    return out


def labels(page: Page, main: list[str]) -> np.ndarray:
    """1 for every node whose subtree holds text of the article."""
    y, todo = np.zeros(len(page.tag)), [" ".join(t.split()) for t in main]
    for (_, text), k in zip(page.blocks, page.at):
        if todo and text == todo[0]:
            todo.pop(0)
            y[k] = 1
    for k in range(len(y) - 1, 0, -1):
        y[page.parent[k]] = max(y[page.parent[k]], y[k])
    return y


@dataclass
class Extractor:
    """What was learned: token weights and trees."""

    weight: TokenWeights
    trees: Boosted

    def texts(self, sources: list[str | None]) -> list[str]:
        """Main text of each page; null and empty pages give an empty text."""
        pages = [Page(s or "") for s in sources]
        if not pages:
            return []
        margin = self.trees.margin(np.concatenate([p.features(self.weight) for p in pages]))
        ends = np.cumsum([len(p.tag) for p in pages])
        return [p.text(p.decode(m)) for p, m in zip(pages, np.split(margin, ends[:-1]))]


@lru_cache(maxsize=2)
def train(pages: int = PAGES, seed: int = SEED) -> Extractor:
    """Token weights from one half of the composed pages, trees from the other, so trees see weights as they will be."""
    made = [(Page(h), m) for h, m in composed(pages, seed)]
    y = [labels(p, m) for p, m in made]
    half = len(made) // 2
    weight = TokenWeights([t for p, _ in made[:half] for t in p.tokens], np.concatenate(y[:half]))
    return Extractor(weight, fit(np.concatenate([p.features(weight) for p, _ in made[half:]]), np.concatenate(y[half:])))


def extract(html: Column, model: Extractor, session) -> Column:
    shared = session.sparkContext.broadcast(model)

    def extracted(html: pa.Array) -> pa.Array:
        out: list[str] = []
        for i in range(0, len(html), 64):
            out += shared.value.texts(html.slice(i, 64).to_pylist())
        return pa.array(out, pa.string())

    return F.arrow_udf(extracted, "string")(html)


def extract_pages(pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Blocks of the article in page order, joined by one line feed; character references
    decoded, white space inside a block as one space. Null or empty html gives an empty
    text. Repeated rows are extracted each; an empty table gives no rows; other columns
    are ignored.
    """
    rows = small_batches(pages).select(col("page_id").alias("page_id"), col("url").alias("url"), col("html").alias("html"))
    out = rows.select("page_id", "url", extract(F.col("html"), model or train(), pages.sparkSession).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
