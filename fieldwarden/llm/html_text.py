"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

1. A tolerant reader turns a page into block nodes and text segments (scripts, styles, comments and titles have none).
2. Every node gets features: subtree text and link density, attribute tokens, tag group, depth, place and siblings.
3. No table holds labels for pages, so a bounded sample of pages whose own markup says what is article (``article``,
   ``main``) and what is not (``nav``, ``footer``, known attribute tokens) teaches the trees. Half of the teaching rows
   have their markup features blanked, so that density and place decide on pages without such markup.
4. Decoding chooses for every node to keep its subtree, to drop it, or to let its children decide, by the largest sum of
   log-likelihoods. A dropped ancestor thus never has a kept descendant, and the other way round.

Null and empty pages give the empty text. Broken markup is read as far as it goes: a script or style without its end
takes the rest of the page, other elements without theirs do not; a tag without ">" is left out with what follows it.
Very long pages are read in one pass; a page is held by one task. With no page to learn from, the markup alone decides:
blocks that say what else they are (and those inside them) go, the others stay. Ties between keeping and dropping keep.
Repeated rows get equal results; extra columns are ignored; empty tables are fine; nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.shared import bound_text_batches, slices_by_bytes

#: Bound of the pages that teach the trees.
PAGES = 1500
TREES, DEPTH, RATE, LEVELS = 40, 3, 0.3, 32
#: What letting the children decide costs, in log-likelihood.
MIXED_COST = 1.0

# Quotation marks hold a ">" only after "="; what was read is not tried in another way, so that reading stays linear.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"'=]+|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>",
    re.S,
)
_UNENDED = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "svg", "template"}
_ENDLESS = {"script", "style"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_GROUPS = (
    {"p"},
    {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"ul", "ol", "li", "dl", "dt", "dd", "menu"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    {"div", "section", "center", "details", "summary"},
    {"article", "main"},
    {"nav"},
    {"header", "footer", "aside"},
    {"form", "button", "select", "option", "fieldset", "legend", "label", "dialog"},
    {"blockquote", "pre", "figure", "figcaption", "address"},
    {"html", "body", "head"},
)
_GROUP_OF = {tag: k for k, group in enumerate(_GROUPS) for tag in group}
_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead"}, "option": {"select"}}
_CONTENT_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text", "prose"}
_OTHER_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie",
    "consent", "disclaimer", "footer", "form", "header", "hidden", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "recommended", "related",
    "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "tags", "toolbar", "widget",
}
_OTHER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu"}
_ARTICLE_TAGS = {"article", "main"}
NUMERIC = 18
MARKUP = len(_GROUPS) + 5
FEATURES = NUMERIC + MARKUP


class Page:
    """Block nodes in page order (a parent before its children) and the text segments of each."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.words: list[frozenset[str]] = [frozenset()]
        self.segments: list[tuple[int, str, int]] = []
        self._read(source)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        words: set[str] = set()
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                words.update(_WORD.findall((value or name).lower()))
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(frozenset(words))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # tag, and node or -1 for inline elements
        held: list[str] = []
        linked = links = 0

        def block() -> int:
            return next(n for _, n in reversed(stack) if n >= 0)

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    self.segments.append((block(), text, min(linked, len(text))))
                held.clear()
            linked = 0

        at, last = 0, source.rfind(">") + 1  # no tag ends behind it
        unclosed: set[str] = set()
        while at < len(source):
            found = _TAG.search(source, at, last) if at < last else None
            if found:
                text = source[at : found.start()]
            else:
                text = _UNENDED.split(source[at:], maxsplit=1)[0]
            if text:
                held.append(text)
                if links:
                    linked += len(text)
            if not found or found.group().startswith("<!--") and not found.group().endswith("-->"):
                break
            at = found.end()
            closing, name, attributes = found.group(1), found.group(2), found.group(3)
            if name is None:
                continue
            tag = name.lower()
            if tag in _RAW:
                if not closing and not attributes.endswith("/") and tag not in unclosed:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    if end:
                        at = end.end()
                    elif tag in _ENDLESS:
                        break
                    else:
                        unclosed.add(tag)
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    held.append(" ")
                continue
            if tag not in _GROUP_OF:
                if not closing:
                    stack.append((tag, -1))
                    links += tag == "a"
                else:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][1] >= 0:
                            break
                        if stack[k][0] == tag:
                            links -= tag == "a"
                            del stack[k]
                            break
                continue
            flush()
            if closing:
                cut = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            else:
                cut = self._implied(stack, tag)
            if cut and not (closing and tag in ("html", "body")):
                links -= sum(t == "a" for t, _ in stack[cut:])
                del stack[cut:]
            if not closing:
                stack.append((tag, self._open(tag, block(), attributes)))
        flush()

    @staticmethod
    def _implied(stack: list[tuple[str, int]], tag: str) -> int:
        """Where the stack is cut because the new block ends an open paragraph, item or cell; 0 if nowhere."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "p":
                return k
            if stack[k][1] >= 0:
                break
        if tag in _CLOSES:
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in same:
                    return k
                if stack[k][0] in _CLOSES[tag]:
                    break
        return 0

    def features(self) -> np.ndarray:
        """One row for each node: numeric features first, then those read from the markup itself."""
        n = len(self.tag)
        parent = self.parent
        chars, links, words, marks, parts = (np.zeros(n) for _ in range(5))
        longest, start = np.zeros(n), np.zeros(n)
        first = np.full(n, -1.0)
        total = 0
        for node, text, linked in self.segments:
            if first[node] < 0:
                first[node] = total
            chars[node] += len(text)
            links[node] += linked
            words[node] += text.count(" ") + 1
            marks[node] += text.count(".") + text.count(",")
            parts[node] += 1
            longest[node] = max(longest[node], len(text))
            total += len(text)
        own = chars.copy()
        nodes, children, place = np.ones(n), np.zeros(n), np.zeros(n)
        depth = np.zeros(n)
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for v in (chars, links, words, marks, parts, nodes):
                v[p] += v[i]
            longest[p] = max(longest[p], longest[i])
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
        start = np.maximum(first, 0) / max(total, 1)
        up = np.array([max(p, 0) for p in parent])
        alike = np.array([1] + [same[parent[i], self.tag[i]] for i in range(1, n)])
        before = np.zeros(n)
        last: dict[int, int] = {}
        for i in range(1, n):
            before[i] = chars[last[parent[i]]] if parent[i] in last else 0
            last[parent[i]] = i
        numeric = [
            np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), chars / nodes, np.log1p(longest),
            chars / np.maximum(parts, 1), words / np.maximum(parts, 1), marks / np.maximum(words, 1), np.log1p(nodes), children,
            depth, place, alike / np.maximum(children[up], 1), children[up], chars / np.maximum(chars[up], 1),
            chars / max(total, 1), start, np.log1p(before),
        ]
        markup = np.zeros((n, MARKUP))
        for i in range(n):
            group = _GROUP_OF.get(self.tag[i])
            if group is not None:
                markup[i, group] = 1
            good, bad = self.hints(i)
            p = parent[i]
            base = len(_GROUPS)
            markup[i, base], markup[i, base + 1] = good, bad
            markup[i, base + 2] = 1 if good else (markup[p, base + 2] if i else 0)
            markup[i, base + 3] = bad + (markup[p, base + 3] if i else 0)
            markup[i, base + 4] = self.tag[i] == "h1"
        # single precision, as the trees are taught
        return np.column_stack([*numeric, markup]).astype(np.float32).astype(np.float64)

    def hints(self, i: int) -> tuple[int, int]:
        """Whether the node's own markup says article, and whether it says something else."""
        inside = self.tag[i] in _ARTICLE_TAGS or bool(self.words[i] & _CONTENT_WORDS)
        header = self.tag[i] == "header" and not self._in_article(i)
        other = self.tag[i] in _OTHER_TAGS or header or bool(self.words[i] & _OTHER_WORDS)
        return int(inside and not other), int(other)

    def _in_article(self, i: int) -> bool:
        while i > 0:
            i = self.parent[i]
            if self.tag[i] in _ARTICLE_TAGS:
                return True
        return False

    def taught(self) -> np.ndarray:
        """1 for article, 0 for other, -1 where the markup does not say."""
        label = np.full(len(self.tag), -1)
        for i in range(1, len(self.tag)):
            good, bad = self.hints(i)
            above = label[self.parent[i]]
            label[i] = 0 if bad or above == 0 else 1 if good and self.tag[i] in _ARTICLE_TAGS else above
        return label

    def told(self) -> np.ndarray:
        """Chances of being article as far as the markup alone tells."""
        chance = np.full(len(self.tag), 0.8)
        for i in range(1, len(self.tag)):
            good, bad = self.hints(i)
            above = chance[self.parent[i]]
            chance[i] = 0.02 if bad or above < 0.5 else 0.95 if good else above
        return chance

    def decoded(self, chance: np.ndarray) -> str:
        """The text of the kept segments for the nodes' chances of being article."""
        p = np.clip(chance, 1e-4, 1 - 1e-4)
        yes, no = np.log(p), np.log(1 - p)
        keep, drop, mixed = yes.copy(), no.copy(), np.maximum(yes, no) - MIXED_COST
        n = len(p)
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            keep[up] += keep[i]
            drop[up] += drop[i]
            mixed[up] += max(keep[i], drop[i], mixed[i])
        state = np.zeros(n, np.int8)  # 1 keep, 0 drop, 2 children decide
        for i in range(n):
            above = state[self.parent[i]] if i else 2
            own = 1 if keep[i] >= max(drop[i], mixed[i]) else 2 if mixed[i] > drop[i] else 0
            state[i] = own if above == 2 else above
        kept = (state == 1) | ((state == 2) & (p >= 0.5))
        return "\n".join(text for node, text, _ in self.segments if kept[node])


class BoostedTrees:
    """Gradient boosting for logistic loss with small trees over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(y):
            return
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, LEVELS + 1)))[:-1] for c in x.T]
        binned = self._binned(x)
        mean = float((y * weight).sum() / weight.sum())
        self.base = np.log(mean / (1 - mean))
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grown(binned, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            raw += self._leaf(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v) for c, v in zip(self.cuts, x.T, strict=True)]).astype(np.int64)

    @staticmethod
    def _grown(binned: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = np.zeros(len(gradient), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, LEVELS)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(binned.shape[1]):
                key = node * (LEVELS + 1) + binned[:, f]
                g = np.bincount(key, gradient, width * (LEVELS + 1)).reshape(width, -1).cumsum(1)
                h = np.bincount(key, curve, width * (LEVELS + 1)).reshape(width, -1).cumsum(1)
                gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                top = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(width), top] > best)
                best[better] = gain[better, top[better]]
                feature[base + better], cut[base + better] = f, top[better]
            node = node * 2 + (binned[np.arange(len(node)), feature[base + node]] > cut[base + node])
        g, h = np.bincount(node, gradient, 2**DEPTH), np.bincount(node, curve, 2**DEPTH)
        return feature, cut, RATE * g / (h + 1)

    @staticmethod
    def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = node * 2 + (binned[rows, feature[at]] > cut[at])
        return value[node]

    def chance(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._leaf(t, binned) for t in self.trees))))


def _teaching_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the nodes of teaching pages; every page also comes once without its markup."""
    for batch in batches:
        for part in slices_by_bytes(batch, "body"):
            rows, labels = [np.zeros((0, FEATURES))], [np.zeros(0, int)]
            for source in part.column("body").to_pylist():
                page = Page(source or "")
                label = page.taught()
                if (label == 1).any():
                    rows.append(page.features()[label >= 0])
                    labels.append(label[label >= 0])
            x, y = np.concatenate(rows), np.concatenate(labels)
            plain = x.copy()
            plain[:, NUMERIC:] = 0
            x = np.concatenate([x, plain])
            offsets = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate([y, y]).astype(np.int32))], ["x", "y"])


def fit(pages: DataFrame, bound: int = PAGES) -> BoostedTrees:
    """The trees, fitted on the nodes of at most about ``bound`` pages (chosen by a hash of the page)."""
    share = int(1_000_000 * min(1.0, bound / max(pages.count(), 1)))
    some = pages.filter(F.pmod(F.xxhash64("body"), F.lit(1_000_000)) < share).dropDuplicates(["body"]).limit(2 * bound)
    rows = some.mapInArrow(_teaching_rows, "x array<float>, y int").toArrow()
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column("x").chunks] or [np.zeros(0, np.float32)])
    y = rows.column("y").to_numpy().astype(float)
    x = x.reshape(-1, FEATURES).astype(float)
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        return BoostedTrees(x[:0], y[:0], y[:0])
    return BoostedTrees(x, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))


def main_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", source: str = "html", bound: int = PAGES) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``."""
    bound_text_batches(pages.sparkSession)
    given = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("body")
    )
    fitted = given.sparkSession.sparkContext.broadcast(fit(given.select("body").filter("body is not null"), bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted.value
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                read = [Page(s or "") for s in part.column("body").to_pylist()]
                if model.trees:
                    x = np.concatenate([p.features() for p in read])
                    chance = np.split(model.chance(x), np.cumsum([len(p.tag) for p in read])[:-1])
                else:
                    chance = [p.told() for p in read]
                texts = [p.decoded(c) for p, c in zip(read, chance, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    return given.mapInArrow(run, "page_id long, url string, text string")
