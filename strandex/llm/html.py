"""Main text of web pages by tag-path ratios.

A page is cut into tags and text. Text below elements that are never content by their tag (scripts,
navigation, forms and the like) goes. What remains is summed by root-to-leaf tag path, without classes:
characters and punctuation marks per text node. Both ratios are smoothed over the paths in page order
and fused by their product; paths above a threshold hold content. The main element is the innermost
one that still holds most of the text on content paths; every block inside it is kept, so that short
paragraphs and headings of the article stay. A class or id of nothing but boilerplate words excludes,
as adverts, notices and reader comments may read like the article; one that holds such a word raises a
suspicion: a suspect node counts for nothing in the choice, and inside the main element it stays if its
path reads like content. The tags article and main break ties only: they are main elements at a smaller share.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

# Fixed values of HTML: void elements, raw text elements, inline elements, implied ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = RAW | set("head nav footer aside form button select option dialog menu canvas audio video map".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {k: (set(a.split()), set(b.split())) for k, (a, b) in _CLOSES.items()}
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Words of a class or id that mark what isn't article text.
_NAMES = set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion "
    "sidebar aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription "
    "signup signin login comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations pagination pager skip search searchbox form legal copyright disclaimer hidden".split()
)
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: A path holds content if its fused ratio is this part of the best path's; that of a suspect node must be greater.
THRESHOLD, CLEAR = 0.05, 0.25
#: Share of the text on content paths that the main element holds at least; that of an article or main element.
SHARE, NAMED_SHARE = 0.75, 0.5
_WRAPPERS = set("html body div section article main center table tbody tr td font span".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _never(tag: str, above: list[str]) -> bool:
    return tag in NEVER or tag == "header" and not ("article" in above or "main" in above)


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))


def _names(tag: str, a: dict[str, str], above: list[str]) -> tuple[bool, bool]:
    """Excluded, suspect: by role, class or id. An article in an article is a comment on it (as HTML defines), or a part of it."""
    if a.get("role", "").lower() in _ROLES:
        return True, False
    if tag in ("html", "body", "main", "article", "header"):
        return False, tag == "article" and "article" in above
    words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{a.get('class', '')} {a.get('id', '')}").lower()))
    return bool(words) and words <= _NAMES, bool(words & _NAMES)


def nodes(page: str) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], int, str, int]]:
    """Text nodes outside excluded elements: tag path, numbers of the open elements, block number, raw text,
    and the number of the outermost suspect element around (0: none)."""
    stack: list[str] = []
    numbers: list[int] = []
    off, block, count, at, end = 0, 0, 0, 0, len(page)  # off: depth at which an excluded element was opened, plus 1
    suspect = 0  # the same for a suspect one

    def pop(to: int) -> bool:
        nonlocal off, suspect
        inline = all(t in INLINE for t in stack[to:])
        del stack[to:], numbers[to:]
        off, suspect = off if off <= len(stack) else 0, suspect if suspect <= len(stack) else 0
        return not inline

    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not off:
            yield tuple(stack), tuple(numbers), block, text, suspect and numbers[suspect - 1]
        if not m:
            return
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in stack:
                k = len(stack) - 1 - stack[::-1].index(tag)
                block += pop(k)
            elif tag == "p":
                block += 1
            continue
        if tag == "br":
            if not off:
                yield tuple(stack), tuple(numbers), block, " ", suspect and numbers[suspect - 1]
            continue
        if tag in _ENDS_P and "p" in stack:
            k = len(stack) - 1 - stack[::-1].index("p")
            if not {"button", "table", "td"} & set(stack[k:]):
                pop(k)
        if tag in _CLOSES:
            ends, stop = _CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in stop:
                    break
                if stack[k] in ends:
                    pop(k)
                    break
        if tag not in INLINE:
            block += 1
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "body":  # ends a head that was left open
            while "head" in stack:
                pop(stack.index("head"))
        count += 1
        stack.append(tag)
        numbers.append(count)
        if not off:
            a = _attributes(m[3]) if "=" in m[3] or "hidden" in m[3].lower() else {}
            named, like = _names(tag, a, stack[:-1])
            if _never(tag, stack[:-1]) or a and _hidden(a) or named:
                off = len(stack)
            elif like and not suspect:
                suspect = len(stack)


def _smooth(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    y = np.pad(x, 1, mode="edge")
    return 0.25 * y[:-2] + 0.5 * y[1:-1] + 0.25 * y[2:]


def ratios(found: list) -> dict[tuple[str, ...], float]:
    """The fused ratio of each tag path, as a part of the best."""
    paths: dict[tuple[str, ...], list[int]] = {}
    for path, _, _, text, _ in found:
        if size := len(text.strip()):
            got = paths.setdefault(path, [0, 0, 0])
            got[0] += size
            got[1] += len(_PUNCTUATION.findall(text))
            got[2] += 1
    if not paths:
        return {}
    sums = np.array(list(paths.values()), float)
    length, marks = sums[:, 0] / sums[:, 2], (sums[:, 1] + 0.1) / sums[:, 2]
    # A path keeps its own ratio if that is above the smoothed one: a long path isn't drowned by short neighbours.
    fused = np.maximum(length, _smooth(length)) * np.maximum(marks, _smooth(marks))
    return dict(zip(paths, (fused / fused.max()).tolist()))


def _main_element(found: list, content: set[tuple[str, ...]]) -> tuple[int, ...]:
    """Numbers of the elements down to the main one; empty if nothing holds most of the content."""
    mass: dict[tuple[int, ...], float] = {}
    tags: dict[tuple[int, ...], str] = {}
    every, clear = ([x for x in found if x[0] in content and (not only or not x[4])] for only in (False, True))
    for path, numbers, _, text, _ in clear or every:
        for k in range(1, len(numbers) + 1):
            if path[k - 1] not in _WRAPPERS:
                break
            mass[numbers[:k]] = mass.get(numbers[:k], 0) + len(text.strip())
            tags[numbers[:k]] = path[k - 1]
            if path[k - 1] == "article":
                break  # what an article holds belongs together
    total = sum(len(x[3].strip()) for x in clear or every)
    enough = [n for n, x in mass.items() if x >= (NAMED_SHARE if tags[n] in ("article", "main") else SHARE) * total]
    return max(enough, key=lambda n: (len(n), mass[n]), default=())


def _parent(path: tuple[str, ...], numbers: tuple[int, ...]) -> tuple[int, ...]:
    """The element that holds a node's block and its siblings."""
    k = len(path)
    while k and path[k - 1] in INLINE:
        k -= 1
    if k and path[k - 1] not in ("body", "html", "div", "section", "article", "main"):
        k -= 1  # a paragraph's parent
    while k and path[k - 1] in ("ul", "ol", "dl", "table", "tbody", "tr", "blockquote", "figure", "li", "td"):
        k -= 1
    return numbers[:k]


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty for a page without text."""
    found = [(path, numbers, block, entities.unescape(text), suspect) for path, numbers, block, text, suspect in nodes(page or "")]
    score = ratios(found)
    if not score:
        return ""
    content = {p for p, x in score.items() if x >= THRESHOLD}
    main = _main_element(found, content)
    whole = not main or any(path[len(main) - 1] in ("html", "body") for path, numbers, *_ in found if numbers[: len(main)] == main)
    if whole:  # no element of its own: what lies beside text on content paths
        containers = {_parent(path, numbers) for path, numbers, _, text, suspect in found if path in content and text.strip() and not suspect}
    else:
        containers = {main}
    lengths = {len(c) for c in containers}
    # What the content and each suspect element hold: an inner article with more than the rest is a part, not a comment.
    inside: dict[int, int] = {}
    for path, _, _, text, suspect in found:
        if path in content:
            inside[suspect] = inside.get(suspect, 0) + len(text.strip())
    blocks: dict[int, list[str]] = {}
    for path, numbers, block, text, suspect in found:
        if suspect:
            comment = "article" in path and path[numbers.index(suspect)] == "article" and inside.get(suspect, 0) <= inside.get(0, 0)
            if comment or score.get(path, 0) < CLEAR or whole and inside.get(0):
                continue
        if any(numbers[:k] in containers for k in lengths if k <= len(numbers)):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: the id, the url, ``text`` and ``n_chars`` (its code points).

    A null or empty page, or one without text, gives the empty text. Rows are taken one by one:
    repeated rows and nulls in the id or url come out as they went in. Other columns are not carried.
    """
    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long")
