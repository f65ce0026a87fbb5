"""Leaf blocks of raw HTML pages, with features of their ancestors and texts."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements that end a run of text. Inline elements do not.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page. Without an end tag, RAW ones reach to the
# end of the page, as in browsers; the others are then elements like any other.
RAW = frozenset("script style textarea".split())
SKIPPED = RAW | frozenset("noscript template iframe select title svg canvas".split())
# A start tag on the left ends an open element on the right, up to its list or table.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
# Words of class, id and role attributes, by what they speak for.
ROLES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager toolbar",
    "header": "header masthead topbar top hero branding logo",
    "footer": "footer bottom copyright colophon legal",
    "side": "sidebar side aside rail widget related recommended recommendations trending popular more tags",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall",
    "form": "form search login signup signin register contact",
    "comments": "comment comments commentlist reply replies respond responses disqus discussion",
    "share": "share sharing social follow",
    "content": "content article post entry story body main text prose page",
    "meta": "meta byline author date timestamp info",
}
ROLE_OF = {word: role for role, words in ROLES.items() for word in words.split()}
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|data-gold)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tag: str  # innermost block element
    inside: frozenset  # features of all ancestors
    linked: int = 0  # characters within links
    gold: str | None = None  # mark of a labelled page


@dataclass
class Open:
    tag: str
    inside: frozenset
    gold: str | None
    links: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[Open] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    linked: int = 0
    at: Open | None = None

    def text(self, data: str) -> None:
        if not self.held:
            self.at = self.stack[-1] if self.stack else Open("", frozenset(), None, False)
        # each run by itself: a reference never spans a tag
        self.held.append(html.unescape(data) if "&" in data else data)
        if self.stack and self.stack[-1].links:
            self.linked += len(data)

    def flush(self) -> None:
        if self.held:
            words = " ".join("".join(self.held).split())
            if words:
                block = next((o.tag for o in reversed(self.stack) if o.tag in BLOCKS), "")
                self.blocks.append(Block(words, block, self.at.inside, self.linked, self.at.gold))
            self.held.clear()
            self.linked = 0

    def close(self, k: int) -> None:
        del self.stack[k:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            ends, until = CLOSES.get(tag, ({"p"}, {"table", "button"}))
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in ends:
                    self.close(k)
                    break
                if self.stack[k].tag in until:
                    break
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        above = self.stack[-1] if self.stack else Open("", frozenset(), None, False)
        own, gold = set(), above.gold
        if tag in BLOCKS or tag == "a":
            own.add("in:" + tag)
        if attributes and "=" in attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                value = value.strip("\"'").lower()
                if name.lower() == "data-gold":
                    gold = value
                else:
                    own.update("role:" + ROLE_OF[w] for w in WORD.findall(value) if w in ROLE_OF)
        inside = above.inside if own <= above.inside else above.inside | own
        self.stack.append(Open(tag, inside, gold, above.links or tag == "a"))

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self.close(k)
                break


ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in SKIPPED}
# Start tags that end a drawing left open, unless they stand in a foreignObject.
LEAVES = re.compile(
    r"<(?=(?:foreignobject|blockquote|center|dd|div|dl|dt|h[1-6]|li|menu|ol|p|pre|table|ul)[\s/>])|</p(?=[\s/>])", re.I
)


def skip(tag: str, source: str, at: int, endless: set[str]) -> int | None:
    """Where a skipped element whose content starts at ``at`` ends; None if it does not.

    ``endless`` keeps the elements that have no end tag in the rest of the page.
    """
    over = None if tag in endless else ENDS[tag].search(source, at)
    if over is None:
        endless.add(tag)
        return len(source) if tag in RAW else None
    if tag == "svg":
        left = LEAVES.search(source, at, over.start())
        if left and source[left.end() : left.end() + 13].lower() != "foreignobject":
            return left.start()
    return over.end()


def blocks_of(source: str | None) -> list[Block]:
    """Blocks in page order; broken markup is read as far as it goes."""
    source = source or ""
    page, at, n = Page(), 0, len(source)
    endless: set[str] = set()
    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            page.text(source[at:])
            break
        if mark > at:
            page.text(source[at:mark])
        after = source[mark + 1 : mark + 2]
        if source.startswith("<!--", mark):
            close = source.find("-->", mark + 2)
            at = n if close < 0 else close + 3
        elif after in ("!", "?"):
            close = source.find(">", mark)
            at = n if close < 0 else close + 1
        elif found := TAG.match(source, mark):
            tag, at = found[1].lower(), found.end()
            if after == "/":
                page.end(tag)
            elif tag in SKIPPED and found[2].endswith("/"):
                pass
            elif tag in SKIPPED and (over := skip(tag, source, at, endless)) is not None:
                at = over
            else:
                page.start(tag, found[2])
        elif after == "/" or after.isalpha():  # a tag that never closes its quotes or itself
            close = source.find(">", mark)
            at = n if close < 0 else close + 1
        else:
            page.text("<")
            at = mark + 1
    page.flush()
    return page.blocks


def bucket(x: float, edges) -> int:
    return sum(x >= e for e in edges)


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block: ancestors, own element, text and place."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        own = [*b.inside, "tag:" + b.tag, "bias"]
        own.append(f"chars:{bucket(size, (15, 40, 80, 160, 400, 1000))}")
        own.append(f"words:{bucket(words, (3, 6, 12, 25, 60))}")
        own.append(f"links:{bucket(b.linked / size, (0.01, 0.3, 0.7, 0.95))}")
        own.append(f"stops:{min(3, b.text.count('. ') + b.text.endswith(('.', '!', '?', '…')))}")
        own.append("ends" if b.text[-1] in ".!?…:\"”»" else "open")
        if "©" in b.text:
            own.append("copyright")
        if i == 0:
            own.append("first")
        if i == n - 1:
            own.append("last")
        out.append(own)
    return out
