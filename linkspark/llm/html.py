"""Main text of web pages by two-pass block rules.

Pass one labels each block by its place, link density, length and stop-word density: good, bad, or undecided. Elements
such as nav, footer or form, and those named for what never is article text (comments, adverts, cookie notices,
sidebars), are bad whatever they hold. Other telling names (header, tags, related, notice) only mark a block: if it stands
within the article, is long and rich in stop words and has few links, it is good all the same. In languages whose stop words
aren't listed, length and punctuation stand for them. Pass two gives undecided blocks the label of their nearest decided
neighbours; between a good and a bad one the nearer wins, and a tie is good inside the article. Text outside <article>
and <main> counts only where these hold no good block.

Null and empty pages give an empty text. Repeated pages give the same text, empty tables empty results. Other columns
stay, but for those named text or n_chars.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("head title nav footer aside form menu dialog button select search".split())
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|canvas|audio|video|select"
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
MAYBE = re.compile(r"hidden|display", re.I)
# Whole names of parts that are never article text, and words that say so in any name they are part of.
NEVER = frozenset(
    "ad ads adv adbox adsbox ad-slot ad-unit ad-banner ad-container banner-ad comment comments commentlist comment-list comment-body comment-section comment-thread comment-form comments-area comments-list "
    "comments-section comments-wrapper comment-wrapper post-comments user-comments reader-comments article-comments replies reply-list respond responses discussion disqus disqus_thread sidebar side-bar "
    "aside nav navbar navigation menu main-menu nav-menu site-nav main-nav breadcrumb breadcrumbs pagination pager toolbar contentinfo complementary footer site-footer page-footer main-footer "
    "site-header page-header masthead top-bar topbar share sharing share-buttons social social-links social-share login signup sign-up subscribe popup modal overlay".split())
TELLING = re.compile(r"(?:^|[_-])(?:advert\w*|adsense|sponsor\w*|promo\w*|cookies?|gdpr|consent|newsletter|sidebar|disqus|navbar|breadcrumbs?|commentlist)(?=$|[_-])", re.I)
# Words that make an element doubtful.
ASIDE = re.compile(
    r"(?:^|[_-])(?:ads?|banner\w*|notices?|alerts?|popup|modal|subscri\w*|signup|sidebar\w*|aside|widget\w*|menu\w*|nav|navigation|toolbar|pagination|pager|"
    r"footer\w*|masthead|header|comments?|replies|related|recommend\w*|share|sharing|social|tags|login|search|copyright)(?=$|[_-])", re.I)
WORD = re.compile(r"[^\W\d_]+")
# Frequent function words of English, German, French and Spanish.
STOP = frozenset((
    "the of and to in is it that for was on are as with be at by this from or have an not but which you he she they his her we their has had were been will would there if more when who one all "
    "der die das und ist nicht ein eine einer zu den dem des mit sich auf für von im in auch es an werden aus er hat dass sie nach wird bei noch wie einem über so zum war haben nur oder aber vor zur bis "
    "le la les un une des du de et est que qui dans pour pas sur au aux avec ce se il elle plus par ne sont cette mais ou nous vous ses son sa leur être ont été "
    "el los las una y que en es por con para no se lo su al del como más o pero sus ya este entre cuando muy sin sobre también me hasta hay donde").split())
LONG, SHORT = 200, 70  # characters
DENSE, THIN = 0.30, 0.10  # share of stop words
MENU = 3  # blocks of links in a row that make a menu of them
LINKED, FEW = 0.4, 0.2  # share of characters in links: of menus, and of doubtful blocks that stay
LATIN = re.compile(r"[a-zA-ZÀ-ɏ]")
POINTS = re.compile(r"[.!?…。！？｡।॥؟۔።᙮,，、،;；:：]")  # of sentences and clauses, in any script


def hidden(attrs: str) -> bool:
    """Whether attributes take an element off the page: hidden itself (but "until-found"), aria-hidden, display: none."""
    if not MAYBE.search(attrs):
        return False
    seen = set()
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), entities.unescape((m[2] or "").strip("\"'")).strip().lower()
        if name in seen:
            continue  # the first of an attribute counts
        seen.add(name)
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and UNSEEN.search(value):
            return True
    return False


class Block:
    """bad: 0, 1 (doubtful) or 2 (never article text)."""

    __slots__ = ("parts", "linked", "bad", "inside", "heading")

    def __init__(self, bad: int, inside: bool, heading: bool):
        self.parts, self.linked, self.bad, self.inside, self.heading = [], 0, bad, inside, heading


def named(tags: str) -> int:
    """What the names of an element say of it, as Block.bad."""
    names = tags.lower().split()
    if any(n in NEVER or TELLING.search(n) for n in names):
        return 2
    return int(any(ASIDE.search(n) for n in names))


def blocks(page: str) -> list[tuple[str, Block]]:
    """The non-empty blocks of a page in order, with white space collapsed."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, what it is (as Block.bad), within the article
    links = at = 0
    now: Block | None = None

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            top = stack[-1] if stack else ("", 0, False)
            now = Block(top[1], top[2], any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:]))
            found.append(now)
        said = entities.unescape(raw)
        now.parts.append(said)
        now.linked += len(said) if links else 0

    for m in TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                text(" ")
            continue
        ends, attrs = m[2] or m[5], m[4] or m[7] or ""
        if name == "a":
            links = max(0, links - 1) if ends else 1
        elif name == "br":
            text(" ")
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS or name in AWAY:
            now = None
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            if name in BLOCKS:
                links = 0
            continue
        if name not in BLOCKS and name not in AWAY and not attrs:
            continue  # inline elements without attributes don't change the place
        if name == "p" or name in BLOCKS:
            while stack and stack[-1][0] == "p":
                stack.pop()
        if name in CLOSED_BY and stack and stack[-1][0] in CLOSED_BY[name]:
            stack.pop()
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCKS:
            continue
        bad, inside = stack[-1][1:] if stack else (0, False)
        tags = " ".join(x.strip("\"'") for x in NAMED.findall(attrs)) if attrs else ""
        if name in AWAY or name == "header" and not inside or attrs and hidden(attrs):
            bad = 2
        elif tags and name not in ("body", "html", "main"):
            bad = max(bad, named(tags))
        if name in ("fieldset", "header"):
            bad = max(bad, 1)
        stack.append((name, bad, inside or name in ("article", "main")))
    text(page[at:])
    return [(said, b) for b in found if (said := " ".join("".join(b.parts).split()))]


def reads_like_text(said: str) -> bool:
    """By stop words; by length and punctuation if they aren't those of a listed language."""
    words = WORD.findall(said.lower())
    share = sum(w in STOP for w in words) / max(1, len(words))
    if share >= DENSE or len(said) >= LONG and share >= THIN:
        return True
    latin = len(LATIN.findall(said))
    letters = sum(map(len, words))
    if 2 * latin < letters:  # a letter of other scripts says more: some have one a word
        return len(said) >= SHORT and len(POINTS.findall(said)) * 60 >= len(said)
    return len(said) >= LONG and share < THIN and len(POINTS.findall(said)) * 80 >= len(said) and said[-1:] in ".!?…:\"”»)"


def first_label(said: str, b: Block, has_article: bool) -> bool | None:
    if b.bad == 2 or has_article and not b.inside:
        return False
    if b.bad:
        return bool(b.inside and len(said) >= SHORT and b.linked <= FEW * len(said) and reads_like_text(said))
    if b.linked > LINKED * len(said):
        return False if len(said) >= SHORT or not b.inside else None
    if b.heading or len(said) < SHORT:
        return None
    return True if reads_like_text(said) else None


def main_text(page: str | None) -> str:
    got = blocks(page or "")
    has_article = any(b.inside for _, b in got)
    labels = [first_label(said, b, has_article) for said, b in got]
    if has_article and True not in labels:
        plain = [first_label(said, b, False) for said, b in got]
        labels = plain if True in plain or not any(b.inside and not b.bad for _, b in got) else labels
    run: list[int] = []
    for i, (said, b) in enumerate([*got, ("", None)]):
        if b and b.linked > LINKED * len(said):
            run.append(i)
            continue
        if len(run) >= MENU:
            for k in run:
                labels[k] = False
        run = []

    def nearest(order) -> list[int | None]:
        """For each block the last decided one before it in this order; within an article, of its own text only."""
        out: list[int | None] = [None] * len(got)
        last = {True: None, False: None}
        for i in order:
            b = got[i][1]
            out[i] = last[b.inside]
            if labels[i] is not None:
                last[False] = i
                if b.inside and not b.bad:
                    last[True] = i
        return out

    before, after = nearest(range(len(got))), nearest(range(len(got) - 1, -1, -1))
    keep = []
    for i, (said, _) in enumerate(got):
        chosen = labels[i]
        if chosen is None:
            near = [k for k in (before[i], after[i]) if k is not None]
            near.sort(key=lambda k: (abs(k - i), not labels[k]))
            chosen = labels[near[0]] if near else True
        if chosen:
            keep.append(said)
    return "\n\n".join(keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) for the html column, which goes; other columns stay."""
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*rest, html)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html) + ", text string, n_chars bigint"

    def run(batches):
        for big in batches:
            for b in slices(big, html):
                got = [main_text(p) for p in b.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=[*rest, "text", "n_chars"])

    return rows.mapInArrow(run, ddl.removeprefix(", "))
