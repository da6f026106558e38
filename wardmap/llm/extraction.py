r"""Main text of web pages: the contiguous region of maximal score.

A page is read as a sequence of words and tags, each with a weight learned from labelled pages, that is pages that mark
their content themselves with ``article`` or ``main``. What a word scores depends on its surroundings: the block element
it stands in, whether it is linked, and how many words the block has; words as they stand in content score positive,
words as they stand in menus and the like negative. A tag scores negative, the more so the more often it stands outside
the content, by its name and that of the block around it. So many tags for few words, links, and paths that hold no
content make a part of a page unlikely, whatever its name. One linear scan finds the region of maximal sum.

Inside the region, elements known as menus, adverts, forms and the like are left out: by the names of HTML, by classes
that labelled pages have outside their content, and, as a weak prior that a few pages correct, by classes, ids and roles
made of nothing but common words for such parts. Class words say nothing about ``html``, ``body`` and elements that wrap
the content: those around the marked content, or with most of the words around them. Where a page marks its content, the
region is that mark; of several articles it is the one that holds most of their content.

Weights are fitted on a bounded sample of the labelled pages. Reading a page takes time in proportion to its length,
however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardmap.llm.arrays import small_batches

#: Labelled pages that the weights are fitted on.
SAMPLE = 2000
#: Pages that the meaning of an element's name counts for, and that of a class, id or role.
PRIOR, CLASS_PRIOR = 50, 10
#: Labelled text pieces and tags that the general weights of words and tags count for.
TOKEN_PRIOR = 5
#: From this share outside the content on, an element is not content.
OUTSIDE = 0.9
#: Least pages that a learned share rests on.
EVIDENCE = 5
#: What any tag costs, in words; what is added at most for one that holds no content; and for an element left out.
TAG, TAG_OUTSIDE, BOUNDARY = 0.001, 1.0, 2.0
#: Blocks of up to so many words differ in their weights.
LENGTHS = (3, 9, 24)
#: Readings of a page in search of wrapping elements.
READINGS = 8

#: So many times the words left elsewhere make an element without a heading the content.
MOST = 9

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
                "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
NOT_CONTENT = frozenset(
    "nav footer aside form dialog menu head noscript select button fieldset input label search template".split())
CONTENT = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
# Words of classes, ids and roles that name something beside the content.
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice "
    "notices notification paywall popup promo promoted promotion related replies respond share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget widgets complementary contentinfo alert hidden responses feedback "
    "discussion advertorial recommended trending signup login searchbox skiplink topbar sitemap".split())
# Words that name a page's head or foot, but may also name those of an article.
ENDS = frozenset("header top foot".split())
# Words that say how a part is built or where it stands, not what it is.
BUILD = frozenset(
    "area bar block body bottom box button buttons col column container desktop global group icon icons inner item items "
    "left link links list main mobile outer page panel primary region right row secondary section side site small text "
    "title unit wrap wrapper zone".split())
#: Elements that mark content or only hold it together are one for the paths of words and tags.
PLAIN = frozenset("article main section body html center".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe|noscript|template|svg|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<(?:[/!?]|[a-z])[^>]*\Z", re.I | re.S)
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")

Weights = dict[str, tuple[int, int]]


def keys_of(name: str, attributes: str) -> tuple[list[str], frozenset[str]]:
    """The element's name, its classes, id and roles; and those of their words that mean something beside the content.

    Words mean it only where a class has no others: ``ad-box`` is an advert, ``alert-level`` is no alert and
    ``entry-header`` no page header.
    """
    keys, meant = [name], set()
    if not attributes:
        return keys, frozenset()
    if HIDDEN.search(attributes):
        keys.append(".hidden")
        meant.add("hidden")
    if "=" in attributes:
        for found in NAMES.findall(attributes):
            for token in "".join(found).lower().split():
                keys.append("." + DIGITS.sub("#", token))
                words = WORD.findall(token)
                if words and all(w in NOT_CONTENT_WORDS or w in ENDS or w in BUILD for w in words):
                    named = [w for w in words if w not in BUILD]
                    meant.update(named)
                    keys += ["." + w for w in named if w != token]
    return keys, frozenset(meant)


def outside_share(keys: list[str], meant: frozenset[str], weights: Weights, in_main: bool) -> float:
    """Largest share, over the keys, of pages where such an element holds no content.

    A name without a meaning of its own, such as ``div``, tells nothing by itself; its classes do.
    """
    most = 0.0
    for key in keys:
        if key[0] != "." and key not in NOT_CONTENT and key not in CONTENT and key != "header":
            continue
        inside, outside = weights.get(key, (0, 0))
        if key[0] != ".":
            inside += PRIOR * (key in CONTENT)
            outside += PRIOR * (key in NOT_CONTENT or key == "header" and not in_main)
        elif key[1:] in meant:
            outside += CLASS_PRIOR * (key[1:] in NOT_CONTENT_WORDS or not in_main)
        if inside + outside >= EVIDENCE:
            most = max(most, outside / (inside + outside))
    return most


class Element:
    """An element of a page and what it takes from those around it.

    ``share`` is that of ``outside_share``, ``named`` that without its classes. ``out`` and ``named_out`` tell whether it
    or an element around it is left out by them; ``block`` is the nearest element that starts a block, itself included.
    """

    __slots__ = ("name", "keys", "share", "named", "main", "holds", "parent", "words", "every", "left", "heads", "out",
                 "named_out", "block", "linked", "article", "within", "marked")

    def __init__(self, name: str, keys: list[str], share: float = 0.0, named: float = 0.0, parent: Element | None = None):
        self.name, self.keys, self.share, self.named, self.parent = name, keys, share, named, parent
        self.holds, self.words = False, 0
        self.main = name in ("article", "main") and share < OUTSIDE
        self.out = share >= OUTSIDE or parent is not None and parent.out
        self.named_out = named >= OUTSIDE or parent is not None and parent.named_out
        self.linked = name == "a" or parent is not None and parent.linked
        self.block = self if name in BLOCKS or parent is None else parent.block
        # The outermost article around it, the nearest mark around it, and whether there is one at all.
        self.article = parent.article if parent and parent.article else self if self.main and name == "article" else None
        self.within = (parent if parent.main else parent.within) if parent else None
        self.marked = self.main or self.within is not None

    @property
    def path(self) -> str:
        return "div" if self.block.name in PLAIN else self.block.name


#: What stands around a text that no element holds.
ROOT = Element("body", ["body"])


def tokens(page: str, weights: Weights, wrapping: frozenset[int] = frozenset()) -> Iterator[tuple[str, object]]:
    """('text', (text, innermost element)), ('open', element) and ('close', element), in page order.

    Paragraphs, list items and cells end where the next begins; an end tag without its start is passed over.
    Classes of the elements with the numbers ``wrapping`` say nothing.
    """
    stack: list[Element] = []
    named: Counter = Counter()
    at = number = 0

    def ended() -> tuple[str, Element]:
        element = stack.pop()
        named[element.name] -= 1
        return "close", element

    for token in TOKEN.finditer(page):
        if token.start() > at:
            yield "text", (page[at:token.start()], stack[-1] if stack else None)
        at = token.end()
        name = token[3]
        if not name:
            continue
        name = name.lower()
        if token[2]:
            if named[name]:
                while stack[-1].name != name:
                    yield ended()
                yield ended()
            elif name in BLOCKS:
                yield "close", Element(name, [name])
            continue
        while stack and name in SELF_CLOSING.get(stack[-1].name, ()):
            yield ended()
        if name in BLOCKS and name != "br" and stack and stack[-1].block.name == "p" and stack[-1].block is not stack[-1]:
            # A paragraph with inline elements left open also ends.
            paragraph = stack[-1].block
            while stack[-1] is not paragraph:
                yield ended()
            yield ended()
        parent = stack[-1] if stack else None
        in_main = parent is not None and parent.marked
        keys, meant = ([name], frozenset()) if name in ("html", "body") else keys_of(name, token[4] or "")
        if number in wrapping:
            keys, meant = [k for k in keys if k[0] != "." or k[1:] not in meant], frozenset()
        number += 1
        share = by_name = outside_share(keys, meant, weights, in_main)
        if share >= OUTSIDE and len(keys) > 1:
            own = [name, ".hidden"] if "hidden" in meant and HIDDEN.search(token[4]) else [name]
            by_name = outside_share(own, meant, weights, in_main)
        element = Element(name, keys, share, by_name, parent)
        yield "open", element
        if name not in VOID and not (token[4] or "").endswith("/"):
            stack.append(element)
            named[name] += 1
    if at < len(page):
        yield "text", (page[at:], stack[-1] if stack else None)


Sequence = list[tuple[str, object]]


def parsed(page: str, weights: Weights) -> Sequence:
    """The tokens of a page, with the classes of wrapping elements ignored."""
    wrapping: frozenset[int] = frozenset()
    for _ in range(READINGS):
        sequence = list(tokens(page, weights, wrapping))
        more = wrappers(sequence)
        if not more:
            break
        wrapping |= more
    return sequence


def wrappers(sequence: Sequence) -> frozenset[int]:
    """Numbers of the elements that classes leave out though they wrap the content.

    They hold a ``main``; or most words of the article around them, or else of the page, and either its heading
    or nearly all words that are left. Where every article is left out, also what leaves out the one with most
    words, if it has more than what is left.
    """
    elements = [what for kind, what in sequence if kind == "open"]
    judged = {i for i, e in enumerate(elements) if e.share >= OUTSIDE and e.named < OUTSIDE}
    if not judged:
        return frozenset()
    root = Element("", [])
    for kind, what in sequence:
        if kind == "text":
            (what[1] or root).words += len(what[0].split())
    # All words, those that are left, and what is in there of main and h1; children are opened after their parents.
    for e in (root, *elements):
        e.every, e.left, e.heads = e.words, e.words, {e.name} & {"main", "h1"}
    for e in reversed(elements):
        above = e.parent or root
        if e.named < OUTSIDE:
            above.every += e.every
            above.left += e.left * (e.share < OUTSIDE)
            above.heads |= e.heads
    out = set()
    for i in judged:
        e = elements[i]
        around = e.within or root
        if "main" in e.heads or 2 * e.left > around.every and (e.heads or e.left >= MOST * around.left):
            out.add(i)
    marks = [e for e in elements if e.name in ("article", "main")]
    if not out and marks and all(e.out for e in marks):
        best = max(marks, key=lambda e: e.left)
        if best.left > root.left and not best.named_out:
            above, at = set(), best
            while at is not None:
                above.add(id(at))
                at = at.parent
            out = {i for i in judged if id(elements[i]) in above}
    return frozenset(out)


def block_sizes(sequence: Sequence) -> list[int]:
    """Number of words of the block that each token stands in."""
    number, words, numbers = 0, Counter(), []
    for kind, what in sequence:
        if kind != "text":
            number += what.name in BLOCKS
        else:
            words[number] += len(what[0].split())
        numbers.append(number)
    return [words[n] for n in numbers]


def word_key(element: Element, size: int) -> str:
    """What a word's weight depends on: its block element, the size of the block, and whether it is linked."""
    return f"w:{element.path}:{sum(size > n for n in LENGTHS)}{':a' * element.linked}"


def tag_key(element: Element) -> str:
    """What a tag's weight depends on: its name and the block element around it."""
    return f"t:{(element.parent or ROOT).path}>{'div' if element.name in PLAIN else element.name}"


def word_weight(element: Element, size: int, weights: Weights) -> float:
    """From -1 to 1: twice the share of such text pieces in the content, less 1.

    Without labelled pages short linked texts are unlikely, and so are a few words that stand in no paragraph or heading.
    """
    inside, outside = weights.get(word_key(element, size), (0, 0))
    if element.linked:
        general = 0.2 if size <= LENGTHS[1] else 0.6
    else:
        general = 0.95 if element.path != "div" else 0.7
    return 2 * (inside + TOKEN_PRIOR * general) / (inside + outside + TOKEN_PRIOR) - 1


def tag_cost(element: Element, weights: Weights) -> float:
    """What a tag costs by the share of such tags outside the content."""
    inside, outside = weights.get(tag_key(element), (0, 0))
    return TAG + TAG_OUTSIDE * max(0.0, 2 * outside / (inside + outside + TOKEN_PRIOR) - 1)


def the_mark(sequence: Sequence, weights: Weights) -> tuple[str, Element | None] | None:
    """What marks the content: ``article`` or else ``main``; and the article that holds most of all articles' content.

    The article is None if none has more than half: all of them are the content then.
    """
    held: Counter = Counter()
    named = {what.name for kind, what in sequence if kind == "open" and what.main and not what.out}
    if "article" not in named:
        return ("main", None) if "main" in named else None
    articles = {}
    for (kind, what), size in zip(sequence, block_sizes(sequence), strict=True):
        if kind == "text" and what[1] is not None and what[1].article is not None and not what[1].out:
            key = id(what[1].article)
            articles[key] = what[1].article
            held[key] += max(0.0, word_weight(what[1], size, weights)) * len(what[0].split())
    if not held:
        return "article", None
    best, most = held.most_common(1)[0]
    return "article", articles[best] if 2 * most > sum(held.values()) else None


def in_content(element: Element | None, mark: tuple[str, Element | None]) -> bool:
    """Whether a text's innermost element is in the marked content."""
    if element is None:
        return False
    if mark[0] == "main":
        return element.marked
    return element.article is not None and (mark[1] is None or element.article is mark[1])


def evidence(page: str) -> Counter:
    """Of a labelled page: elements that hold content (key, 1) and outermost ones without (key, 0), text pieces by
    ``word_key`` and tags by ``tag_key`` in the content and outside.

    In the marked content, element names may leave something out, but classes do not: pages correct them. An element
    that wraps the content counts without those of its class words that would leave it out.
    """
    counts: Counter = Counter()
    sequence = parsed(page, {})
    mark = the_mark(sequence, {})
    if not mark:
        return counts
    for (kind, what), size in zip(sequence, block_sizes(sequence), strict=True):
        if kind == "text" and what[0].strip():
            element = what[1] or ROOT
            content = in_content(what[1], mark) and not element.named_out
            counts[word_key(element, size), int(content)] += 1
            while content and element is not None and not element.holds:
                element.holds = True
                element = element.parent
        elif kind == "open" and what.name not in PLAIN:
            counts[tag_key(what), int(in_content(what, mark) and not what.named_out)] += 1
    for kind, e in sequence:
        if kind != "open":
            continue
        if e.holds:
            counts.update((k, 1) for k in set(e.keys))
        elif e.name not in VOID and (e.parent is None or e.parent.holds):
            counts.update((k, 0) for k in set(e.keys))
    return counts


def pieces(page: str, weights: Weights) -> list[tuple[float, str | None, int]]:
    """(score, text or None for a tag, block number) in page order.

    Words in elements that are left out score 0 and have no text. On pages that mark their content the words of the mark
    score 1 and others -1; else words score by ``word_weight``. Outside marked content a tag that opens an element which is
    left out costs ``BOUNDARY`` words, and any other by ``tag_cost``; tags inside such elements cost next to nothing.
    """
    sequence = parsed(page, weights)
    mark = the_mark(sequence, weights)
    out: list[tuple[float, str | None, int]] = []
    block = 0
    for (kind, what), size in zip(sequence, block_sizes(sequence), strict=True):
        if kind == "text":
            text, element = what
            words = len(text.split())
            if element is not None and element.out:
                out.append((0.0, None, block))
            elif mark is None:
                out.append((words * word_weight(element or ROOT, size, weights), text, block))
            elif in_content(element, mark):
                out.append((float(words), text, block))
            else:
                out.append((-float(words), None, block))
            continue
        if what.name in BLOCKS:
            block += 1
        cost = TAG
        if what.within is None and (what.parent is None or not what.parent.out):
            if what.share >= OUTSIDE:
                cost += BOUNDARY * what.share * (kind == "open")
            else:
                cost = tag_cost(what, weights)
        out.append((-cost, None, block))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first of the contiguous regions of largest sum; empty if no score is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: Weights) -> str:
    """The text of the best region, a line for each block."""
    parts = pieces(page, weights)
    start, stop = best_region([p[0] for p in parts])
    lines: dict[int, list[str]] = {}
    for _, text, block in parts[start:stop]:
        if text is not None:
            lines.setdefault(block, []).append(text)
    joined = (" ".join(entities.unescape("".join(texts)).split()) for texts in lines.values())
    return "\n".join(line for line in joined if line)


def learned(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", sample: int = SAMPLE) -> Weights:
    """Counts of elements, text pieces and tags in and outside the content, over at most ``sample`` labelled pages.

    Those with the smallest hashes of id and html are taken. Keys are names, classes and paths of two elements of these
    pages alone, so their number is bounded by the sample.
    """
    marked = pages.select(pages[id_column].alias("id"), pages[html_column].alias("html")).where(
        F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    key = F.xxhash64("id", "html").alias("key")
    # At most ``sample`` hashes.
    chosen = marked.select(key).distinct().orderBy("key").limit(sample)
    texts = marked.select("html", key).join(F.broadcast(chosen), "key").select("html")

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(evidence(page.as_py()))
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array([k for k, _ in total], pa.string()), "inside": pa.array([i for _, i in total], pa.int32()),
             "pages": pa.array(list(total.values()), pa.int64())})

    sums = texts.mapInArrow(count, "key string, inside int, pages bigint").groupBy("key").agg(
        F.sum(F.col("pages") * F.col("inside")).alias("inside"),
        F.sum(F.col("pages") * (1 - F.col("inside"))).alias("outside"))
    return {r["key"]: (r["inside"], r["outside"]) for r in sums.collect()}


def extracted(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    weights: Weights | None = None,
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page row.

    A null or empty html, and one without words in its content, has an empty text. Pages cut short are read as
    far as they go. Without labelled pages general weights decide. Repeated rows give repeated results; an empty table
    gives an empty one. Ids may be of any type. One page is in memory at a time beyond the Arrow batch.
    """
    weights = learned(pages, id_column, html_column) if weights is None else weights
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in (small for whole in batches for small in small_batches(whole)):
            texts = [main_text(page, sent.value) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url"),
                          pages[html_column].alias("html"))
    kind = chosen.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
