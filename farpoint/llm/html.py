"""HTML extraction: the line-block distribution of the text that is left when markup is stripped."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import fresh, text_batches

# Element names of HTML.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul video".split()
)
#: Elements whose content is no markup; it goes whole.
RAW = frozenset("script style textarea noscript template iframe svg title canvas object noframes xmp".split())
CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
#: Elements that end an open one of their kind.
ENDING = frozenset("p li tr td th dt dd option".split())
#: Elements that go with all they hold.
OUT = frozenset("head nav footer aside form button select menu dialog input fieldset audio video map datalist noscript template iframe svg".split())
#: Words of class, id or role that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsored|sponsor|promo|promotion|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|sidebar|aside|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|header|masthead|topbar|toolbar|share|sharing|social|related|recommended|"
    r"recommendations|widget|skip|copyright|legal|disclaimer|contentinfo|complementary|search|form|toc|tags|alert)(?:$|[\s_-])",
    re.I,
)
#: Of these, the words of elements that go even if they hold an <article> or most of the text, and even if they are a heading's or section's id.
WHOLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsored|sponsor|promo|promotion|cookies?|consent|gdpr|popup|newsletter|comments?|commentlist|replies|reply|respond|disqus|discussion|related|recommended|recommendations)(?:$|[\s_-])",
    re.I,
)
#: Inside an article, where sections discuss, relate and reply: what goes whatever it holds if it is a whole class word, id or role, and the words that mark the rest.
INSIDE = re.compile(
    r"(?:^|\s)(?:ads?|ad-\S+|adverts?|advertisement|advertising|sponsored|promo|promotion|cookies?|consent|gdpr|popup|newsletter|comments?|commentlist|disqus|recommended|recommendations|"
    r"(?:comments?|reader|user)[-_](?:comments?|list|section|area|thread|form)|related[-_](?:posts?|articles?|links?|stories|content|news))(?=$|\s)",
    re.I,
)
INNER = re.compile(re.sub(r"\b(?:sponsored|sponsor|replies|reply|respond|discussion|related)\|", "", MARKS.pattern), re.I)
#: Class words that only say what a layout has or lacks.
HAS = re.compile(r"(?:^|(?<=\s))(?:no|non|not|has|have|with|without)[_-]\S*", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")
#: A tag and its attributes, without ways to go back.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: Characters up to which quotes in a tag are minded; in a longer one the first > ends it.
LONG = 4096
NAMED = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
#: Names that mark an <article> itself as a comment, an advert or a teaser, if a word of its class is just that.
CARDS = frozenset("comment comments reply replies respond ad ads advert advertisement sponsored promo related recommended teaser card".split())
#: Windows of so many lines are summed; a surge is a window above SURGE characters.
WINDOW, SURGE = 3, 86
#: On a page that names its article each line in it counts so many characters more, and a surge has to be above them.
HINT = 10_000


def marked(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the words of an element's class, id, role or label mark it as no article, and whether as one that goes whatever it holds.

    Ids of headings, and of sections inside the article, are names to link to and count in the second case only. Inside
    the article words such as discussion, related or reply prove nothing.
    """
    soft = False
    for kind, *values in NAMED.findall(attributes):
        value = HAS.sub(" ", CAMEL.sub(r"\1-\2", next((v for v in values if v), "")))
        if (INSIDE if inside else WHOLE).search(value):
            return True, True
        names = kind.lower() == "id" and (name in HEADINGS or name == "section" and inside)
        soft = soft or not names and bool((INNER if inside else MARKS).search(value))
    return soft, False


def tokens(page: str) -> Iterator[tuple[str, int, str, str, str]]:
    """(text before, place, slash, name, attributes) of each tag, then the rest with an empty name; comments and declarations part texts and have no name. Linear in the page's length."""
    pos = n = 0
    size, open_raw = len(page), {}
    while pos < size:
        at = page.find("<", n)
        if at < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[pos:at], at, "", "", ""
            pos = n = size if end < 0 else end + 3
            continue
        m = TAG.match(page, at, at + LONG)
        if m:
            end = m.end()
        elif page.startswith(("<!", "<?"), at) or NAME.match(page, at):
            end = page.find(">", at) + 1
            if not end:  # nothing closes any more
                break
            m = NAME.match(page, at)
        else:
            n = at + 1
            continue
        if not m:
            yield page[pos:at], at, "", "", ""
            pos = n = end
            continue
        slash, name, attributes = m[1], m[2].lower(), page[m.end(2) : end - 1]
        yield page[pos:at], at, slash, name, attributes
        pos = n = end
        if name in RAW and not slash and not attributes.endswith("/") and open_raw.get(name, True):
            close = CLOSE[name].search(page, pos)
            open_raw[name] = close is not None
            if close or name in ("script", "style"):
                pos = n = close.end() if close else size
    yield page[pos:], size, "", "", ""


def lines(page: str) -> list[tuple[str, bool, int]]:
    """The page's text lines, as ``walk`` has them; elements that words mark as no article stay if they hold an <article> or <main>, or over half of the text, unless WHOLE names them."""
    out, held, total = walk(page, frozenset())
    spared = frozenset(at for at, (article, size) in held.items() if article or size * 2 > total)
    return walk(page, spared)[0] if spared else out


def walk(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool, int]], dict[int, tuple[bool, int]], int]:
    """The lines; for each element that only words strip, by its place, whether it holds an article and its characters; and the characters of the text without the elements that go in any case.

    The page's text lines in order: the text, whether it stands in an <article> or <main>, and the characters of it in
    links. What is stripped leaves one empty line.

    Comments, scripts, styles, forms and what element names or class words mark as no article are stripped with all
    that they hold. Character references are decoded, white space inside a line becomes one space.
    """
    out: list[tuple[str, bool, int]] = []
    buf: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, strips its content, is the article
    count: Counter[str] = Counter()
    linked = links = gone = inside = total = 0
    held: dict[int, tuple[bool, int]] = {}
    open_: list[list] = []  # the elements that words strip: depth of the stack, place, whether with an article, characters

    def cut_to(at: int) -> None:
        """Close the stack's elements from ``at`` on."""
        nonlocal gone, inside, links
        for x, strips, article in stack[at:]:
            gone -= strips
            inside -= article
            links -= x == "a"
            count[x] -= 1
        del stack[at:]
        while open_ and open_[-1][0] >= at:
            _, place, article, size = open_.pop()
            held[place] = article, size
            if open_:
                open_[-1][2] |= article
                open_[-1][3] += size

    def end() -> None:
        nonlocal linked
        s = SPACE.sub(" ", entities.unescape("".join(buf))).strip()
        if s:
            out.append((s, inside > 0, linked))
        buf.clear()
        linked = 0

    for piece, place, slash, name, attributes in tokens(page):
        if piece and not gone:
            buf.append(piece)
            linked += len(piece) if links else 0
        if piece and gone == len(open_):  # stripped by words at most
            size = len(piece.strip())
            total += size
            if open_:
                open_[-1][3] += size
        if not name:
            continue
        if name in BLOCK and not gone:
            end()
        if slash:
            if count[name] > 0:
                cut_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in RAW or name in VOID or attributes.endswith("/"):
            continue
        hard = name in OUT or (name == "header" and not inside) or bool(attributes and HIDDEN.search(attributes))
        soft = False
        if attributes and not hard and name in ("article", "main"):
            hard = any(not CARDS.isdisjoint(v.lower().split()) for kind, *values in NAMED.findall(attributes) if kind.lower() == "class" for v in values)
        elif attributes and not hard and name not in ("html", "body"):
            soft, hard = marked(name, attributes, inside > 0)
            soft = soft and not hard and place not in spared
        strips = hard or soft
        article = name in ("article", "main") and not hard
        if name in ENDING:  # these end an open one of their kind
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), None)
            if at is not None and stack[at][0] == name:
                cut_to(at)
        if article and gone == len(open_) and open_:
            open_[-1][2] = True
        if strips and not gone:
            end()
            out.append(("", inside > 0, 0))
        if soft:
            open_.append([len(stack), place, False, 0])
        stack.append((name, strips, article))
        count[name] += 1
        gone += strips
        inside += article
        links += name == "a"
    if not gone:
        end()
    cut_to(0)
    return out, held, total


def distribution(sizes: list[int], window: int = WINDOW) -> list[int]:
    """For each line, the characters of it and the ``window - 1`` lines after it."""
    run = [0]
    for s in sizes:
        run.append(run[-1] + s)
    return [run[min(i + window, len(sizes))] - run[i] for i in range(len(sizes))]


def between(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines lie between a surge point and the dive point after it.

    A surge: a window sum above ``surge`` on a line with text; what rises to it from the last empty line on belongs to
    it. The dive: the first line from there whose window sum is 0, or the end.
    """
    sums, keep, i = distribution(sizes, window), [False] * len(sizes), 0
    while i < len(sizes):
        if sums[i] > surge and sizes[i]:
            k = i - 1
            while k >= 0 and sizes[k] and not keep[k]:
                keep[k] = True
                k -= 1
            while i < len(sizes) and sums[i]:
                keep[i] = True
                i += 1
        else:
            i += 1
    return keep


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's text: the lines between surges and dives of the line blocks' text lengths, joined by one space.

    Lines that are mostly links count as empty, outside of <article> and <main>. A page that names its article so is
    parted at its bounds by an empty window, and each line in it counts HINT characters more: short articles surge too,
    and what stands outside is no surge beside them unless it is longer than HINT. If no window surges, all lines that
    are not mostly links are the text.
    """
    found = lines(page or "")
    named = any(inside and s for s, inside, _ in found)
    sizes, texts, before = [], [], None
    for s, inside, linked in found:
        if before is not None and inside != before:
            sizes += [0] * window
            texts += [""] * window
        before = inside
        sizes.append(len(s) + HINT * bool(s) if inside else 0 if linked * 2 > len(s) else len(s))
        texts.append(s)
    keep = between(sizes, window, HINT if named else surge)
    if not any(keep):
        keep = [n > 0 for n in sizes]
    return " ".join(s for s, k, n in zip(texts, keep, sizes, strict=True) if k and n)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with text (the main text, empty if none) and n_chars (its code points).

    Each page is worked on by itself, without a shuffle, in time linear in its length, however broken its markup or long
    it is. Null or empty html gives an empty text. Columns that already
    are named text or n_chars are replaced; repeated rows stay repeated; an empty table gives an empty table.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    src = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias(*fresh([*keep, "text", "n_chars"], "html")))
    schema = src.select(*[f"`{c}`" for c in keep], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    return text_batches(src).mapInArrow(run, schema)
