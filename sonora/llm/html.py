"""Main text of web pages by the maximum-scoring run of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import read
from .textmodels import sampled

#: Labelled pages (those that mark their article) that the weights are counted on, about.
LABELLED = 2000
# Element names by their role, and words of class and id names that mark what isn't the article.
RAW = "script style noscript template iframe textarea title xmp noembed noframes"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = ("svg", "math")
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = set("nav aside footer form head menu button select dialog search fieldset datalist".split())
MARKS = set("ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead topbar comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser teasers card cards widget widgets pagination pager toolbar skip hidden copyright legal disclaimer".split())
WEAK = set("header banner notice notices alert legal copyright disclaimer hidden footer overlay popup modal widget widgets toolbar skip".split())
REMARKS = set("comment comments commentlist reply replies respond disqus".split())
HOLDERS = set("div section aside ul ol dl table nav header footer article main form iframe".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = {"article", "main"}

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})(?![^\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S | re.I)
#: What opens beyond the last ">" of a page is never closed.
UNCLOSED = re.compile(r"<(?=[a-zA-Z/!?])")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
LIGHT = set("a p br h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th td caption blockquote pre figure figcaption details summary hr".split())
#: Least cost of a tag that labelled pages have, costs of others (of text, lists and tables; of structure), and the weight of a word in a context that no labelled page has.
TAG_COST, LIGHT_COST, HEAVY_COST, WORD_DEFAULT = 0.25, 0.02, 0.1, 0.5
#: Weight of a word beyond the element that a page marks as its article.
BEYOND = -2.0
#: Log odds up to which a class or id counts as outside the article, and labelled pages that must hold it for that.
CLASS_OUT, CLASS_PAGES = -2.0, 3


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    """Whether an element is hidden, or its role says that it isn't the article."""
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "role" and value in ROLES) for name, value in attributes)


def _names(attributes: list[tuple[str, str]]) -> list[str]:
    """The element's classes and its id."""
    return [token for name, value in attributes if name in ("class", "id") for token in value.split()]


def _mark(names: tuple[str, ...], weight: dict[tuple[str, str], float]) -> int:
    """0 where no class or id marks what isn't the article; 1 for a weak mark (words that also name parts of articles); 2 for a sure one; 3 for remarks of readers.

    Names that labelled pages have go by where they stand there: only those outside of articles are marks.
    Others go by their words: a mark is made of such words alone ("comments", "cookie-notice", but not "no-sidebar").
    """
    most = 0
    for token in names:
        own = weight.get(("class", token))
        words = set(WORDS.findall(token))
        if own is not None and own > CLASS_OUT or own is None and not (words and MARKS >= words):
            continue
        most = max(most, 3 if words & REMARKS else 1 if own is None and WEAK >= words else 2)
    return most


class Page:
    """A page's elements and items, and which of them lie outside of its article or inside it.

    Elements stand in page order: name, parent, whether they go for sure (menus, forms, raw and hidden elements),
    class and id names, nearest block, open links. Items are (tag or text, name or text, element). One pass reads
    the page, and each of the passes over its elements takes the same time for any depth.
    """

    def __init__(self, page: str, weight: dict[tuple[str, str], float]):
        self.names, self.parent, self.gone, self.classes, self.block, self.links = ["body"], [-1], [False], [()], ["body"], [0]
        self.items: list[tuple[str, str, int]] = []
        self.within = [False]  # an article or main element, at any distance
        self._read(page)
        self._weigh()
        self._place(weight)

    def _read(self, page: str) -> None:
        stack, open_, drawn = [0], Counter(), 0
        at, last = 0, page.rfind(">") + 1

        def text(piece: str) -> None:
            if piece:
                self.items.append(("text", entities.unescape(piece), stack[-1]))

        def close(name: str) -> None:
            nonlocal drawn
            while open_[name] > 0:
                out = self.names[stack.pop()]
                open_[out] -= 1
                drawn -= out in FOREIGN
                if out == name:
                    break

        for m in TOKEN.finditer(page, 0, last):
            text(page[at : m.start()])
            at = m.end()
            name = (m[3] or m[6] or "").lower()
            if not name:
                continue
            if m[2] or m[5]:
                self.items.append(("tag", name, stack[-1]))
                close(name)
                continue
            source = m[4] or m[7] or ""
            if name in BLOCKS:  # a block closes an open paragraph; a list item or cell closes the one before
                close("p")
                if name in ("li", "dd", "dt", "tr", "td", "th", "option") and any(self.names[e] == name for e in stack[-3:]):
                    close(name)
            up, number = stack[-1], len(self.names)
            attributes = [(x.lower(), (a or b or c).lower()) for x, a, b, c in ATTRIBUTE.findall(source)] if source else []
            within = self.within[up]
            self.names.append(name)
            self.parent.append(up)
            self.within.append(within or name in CONTENT)
            self.gone.append(name in OUTSIDE or (name in ("header", "svg") and not within) or (name not in ("html", "body", "main") and _hidden(attributes)))
            self.classes.append(tuple(_names(attributes)) if attributes and name not in ("html", "body") else ())
            self.block.append(name if name in BLOCKS else self.block[up])
            self.links.append(self.links[up] + (name == "a"))
            self.items.append(("tag", name, number))
            if name not in VOID and not (source.endswith("/") and (name in FOREIGN or drawn > 0)):
                open_[name] += 1
                drawn += name in FOREIGN
                stack.append(number)
        text(UNCLOSED.split(page[max(at, last) :], maxsplit=1)[0] if at <= last else page[at:])

    def _sum(self, skip: list[bool]) -> list[int]:
        """Words below each element, without the subtrees of elements to skip."""
        out = [0] * len(self.names)
        for words, element in self.texts:
            out[element] += words
        for e in range(len(out) - 1, 0, -1):
            if not skip[e]:
                out[self.parent[e]] += out[e]
        return out

    def _weigh(self) -> None:
        self.texts = [(len(value.split()), e) for kind, value, e in self.items if kind == "text"]
        self.words = self._sum(self.gone)
        self.lost = list(self.gone)
        for e in range(1, len(self.lost)):
            self.lost[e] = self.lost[e] or self.lost[self.parent[e]]

    def _place(self, weight: dict[tuple[str, str], float]) -> None:
        n = len(self.names)
        mark = [_mark(c, weight) if c else 0 for c in self.classes]
        below = [bool(m) for m in mark]
        for e in range(1, n):
            below[e] = below[e] or below[self.parent[e]]
        found = [e for e in range(n) if self.names[e] in CONTENT and not self.lost[e] and self.words[e]]
        self.article = self._articles(found, below, mark)
        kept = set()  # the articles and what they stand in, whatever their names
        for e in self.article:
            while e >= 0 and e not in kept:
                kept.add(e)
                e = self.parent[e]
        own = set(self.article)
        size = max((self.words[e] for e in self.article), default=0)
        self.inside, self.outside = [False] * n, list(self.lost)
        for e in range(n):
            up = self.parent[e]
            self.inside[e] = e in own or (up >= 0 and self.inside[up])
            out = mark[e] > 0 and e not in kept
            if out and self.inside[e] and mark[e] < 3:  # a weak mark of a paragraph or heading is none, nor is one of most of the article
                out = self.words[e] <= size / 2 and (mark[e] > 1 or self.names[e] in HOLDERS)
            self.outside[e] = self.outside[e] or out or (up >= 0 and self.outside[up])

    def _articles(self, found: list[int], below: list[bool], mark: list[int]) -> list[int]:
        """The elements that hold the page's article: its one article, or the largest by far, or several alike; or main, where articles hold little of it; none, if the page marks none."""
        clean = [e for e in found if not below[e]] or [e for e in found if not mark[e]] or found
        articles = self._topmost([e for e in clean if self.names[e] == "article"])
        mains = [e for e in clean if self.names[e] == "main"]
        if mains:
            text = self._sum([g or m > 0 for g, m in zip(self.gone, mark, strict=True)])
            main = max(mains, key=lambda e: text[e])
            if 4 * sum(self.words[e] for e in articles) < text[main]:
                return [main]
        if not articles:
            return []
        largest = max(articles, key=lambda e: self.words[e])
        return [largest] if 2 * self.words[largest] >= sum(self.words[e] for e in articles) else articles

    def _topmost(self, chosen: list[int]) -> list[int]:
        """Those that stand in no other one."""
        own = set(chosen)
        under = [False] * len(self.names)
        for e in range(1, len(under)):
            under[e] = under[self.parent[e]] or self.parent[e] in own
        return [e for e in chosen if not under[e]]


def evidence(page: str) -> Counter:
    """Counts of ("text" or "tag" or "class", context or name, inside the marked article), and one ("page", "", True).

    Texts and tags count where they aren't surely outside; a page that marks no article has nothing else. What a
    mark puts outside of the article counts as beyond it for the classes and ids around.
    """
    read_ = Page(page, {})
    out: Counter = Counter({("page", "", True): 1})
    if not read_.article:
        return out
    n = len(read_.names)
    words = ([0] * n, [0] * n)  # beyond and inside
    for count, e in read_.texts:
        words[read_.inside[e] and not read_.outside[e]][e] += count
    for e in range(n - 1, -1, -1):
        for token in set(read_.classes[e]):
            out["class", token, True] += words[1][e]
            out["class", token, False] += words[0][e]
            out["class page", token, True] = 1
        if e:
            for side in words:
                side[read_.parent[e]] += side[e]
    for kind, value, e in read_.items:
        if read_.outside[e]:
            continue
        if kind == "text":
            out["text", f"{read_.block[e]}{' a' if read_.links[e] else ''}", read_.inside[e]] += len(value.split())
        elif value in BLOCKS or value == "a":
            out["tag", value, read_.inside[e]] += 1
    return out


def weights(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Smoothed log odds of standing in the article, within -4 and 4; a tag never scores above -TAG_COST."""
    out = {}
    for kind, context in {(k, c) for k, c, _ in counts if k in ("text", "tag", "class")}:
        odds = math.log((counts.get((kind, context, True), 0) + 1) / (counts.get((kind, context, False), 0) + 1))
        out[kind, context] = max(-4.0, min(-TAG_COST if kind == "tag" else 4.0, odds))
    return out


def best_run(blocks: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last of the contiguous blocks (cost of the tags before, own score) of greatest sum, by one scan.

    The cost before the first one doesn't count. (0, -1) where no sum is above 0; of equal sums the first found stays.
    """
    best, first, last = 0.0, 0, -1
    total, start = 0.0, 0
    for i, (before, own) in enumerate(blocks):
        if i == 0 or total + before <= 0:
            total, start = own, i
        else:
            total += before + own
        if total > best:
            best, first, last = total, start, i
    return first, last


def extract(page: str | None, weight: dict[tuple[str, str], float]) -> str:
    """The best contiguous run of a page's items, as blocks joined by one line feed.

    Words score their context's weight and tags their cost; what is surely outside (menus, forms, hidden
    elements, and those whose class or id stands outside the articles of labelled pages or is made of marks)
    neither scores nor is returned. Where the page marks its article, words inside it score at least WORD_DEFAULT
    and its tags cost nothing, while words beyond it score BEYOND: the run lies within it. One scan finds the run
    of greatest sum. Blocks aren't parted.
    """
    if not page:
        return ""
    found = Page(page, weight)
    blocks: list[list] = []  # cost of the tags before, score, text
    cost, pieces, score = 0.0, [], 0.0
    marked = bool(found.article)

    def flush() -> None:
        nonlocal cost, pieces, score
        if pieces:
            line = SPACES.sub(" ", "".join(pieces)).strip()
            if line:
                blocks.append([cost, score, line])
                cost = 0.0
        pieces, score = [], 0.0

    for kind, value, e in found.items:
        outside, inside = found.outside[e], found.inside[e]
        if kind == "tag":
            if value in BLOCKS:
                flush()
            elif value == "br" and not outside:
                pieces.append(" ")
            if not outside and not inside and (value in BLOCKS or value == "a"):
                cost += weight.get(("tag", value), -LIGHT_COST if value in LIGHT else -HEAVY_COST)
        elif not outside:
            pieces.append(value)
            own = weight.get(("text", f"{found.block[e]}{' a' if found.links[e] else ''}"), WORD_DEFAULT)
            score += len(value.split()) * (max(own, WORD_DEFAULT) if inside else BEYOND if marked else own)
    flush()

    first, last = best_run([(before, own) for before, own, _ in blocks])
    return "\n".join(line for _, _, line in blocks[first : last + 1])


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", labelled: int = LABELLED, seed: int = 7) -> dict[tuple[str, str], float]:
    """Weights counted on about `labelled` pages that mark their article, drawn by a hash of their key and text.

    Contexts are block names; of classes and ids, those are kept that at least CLASS_PAGES drawn pages hold, so
    what reaches the driver is bounded by the sample. Pages that draw nothing are an error.
    """
    ship_package(pages.sparkSession)
    marked = pages.filter(F.col(html).rlike(r"(?i)<(article|main)\b"))
    n = marked.count()
    if not n:
        return {}
    drawn = marked.filter(sampled(F.xxhash64(F.col(key), F.col(html)), seed, labelled / n)).select(F.col(html).cast("string").alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(evidence(page.as_py()))
        rows = [(k, c, i, n) for (k, c, i), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], [], []), (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], ["kind", "context", "inside", "n"])

    found = drawn.mapInArrow(count, "kind string, context string, inside boolean, n long").groupBy(F.when(F.col("kind") == "class page", "class").otherwise(F.col("kind")).alias("kind"), "context")
    counts = found.agg(F.sum(F.when((F.col("kind") != "class page") & F.col("inside"), F.col("n"))).alias("inside"), F.sum(F.when((F.col("kind") != "class page") & ~F.col("inside"), F.col("n"))).alias("beyond"), F.sum(F.when(F.col("kind") == "class page", F.col("n"))).alias("pages"))
    kept = counts.filter((F.col("kind") != "class") | (F.col("pages") >= CLASS_PAGES)).collect()
    if not any(r["kind"] == "page" for r in kept):
        raise RuntimeError("nothing was drawn from a table with marked pages")
    return weights({(r["kind"], r["context"], i): r[c] or 0 for r in kept for i, c in ((True, "inside"), (False, "beyond"))})


def main_texts(pages: DataFrame, weight: dict[tuple[str, str], float], keep: list[str], html: str = "html") -> DataFrame:
    """The keep columns, text and n_chars of every page.

    Null and empty html gives an empty text; repeated rows and null keys are pages of their own; other
    columns are ignored; nothing is cut from long pages.
    """
    ship_package(pages.sparkSession)
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weight) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [f.name for f in schema])

    return pages.select(*keep, F.col(html).cast("string").alias("_html")).mapInArrow(run, schema)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty html gives an empty text, and odd rows are treated as in main_texts."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_texts(pages, fit(pages), ["page_id", "url"])
