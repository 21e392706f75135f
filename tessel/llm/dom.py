"""A small forgiving HTML parser: elements with parents, and runs of text between block tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|!(?P<declaration>[^>]*)>|\?(?P<instruction>[^>]*)>|/(?P<close>[a-zA-Z][^\s>/]*)[^>]*>|(?P<open>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)", re.S)
SPACE = re.compile(r"\s+")

# Element names by their treatment in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNREAD = frozenset("template svg math object select datalist canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"optgroup"})}
BREAKS_OUT = CLOSES_P - {"hr"}  # starts that end an unclosed element of LEFT_BY_BLOCKS
LEFT_BY_BLOCKS = frozenset("svg math select datalist".split())
BARE = frozenset({"#root", "html", "body"})
SCOPES = frozenset("article aside body div footer form header main nav section table td th".split())


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    parent: int
    depth: int
    index: int
    children: list[int] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    blocks: int = 0


class Page:
    """Elements in page order (nodes[0] is the root), and text blocks as (node, text).

    A block that stands directly in the body (or outside of it) has a node "#text" of its own.
    Elements of RAW are passed over to their end tags, or to the end of the page as in browsers;
    those of UNREAD with all that is open in them, up to a tag that shows that they have ended.
    """

    def __init__(self, source: str | None):
        self.nodes = [Node("#root", "", -1, 0, 0)]
        self.blocks: list[tuple[int, str]] = []
        self._open = [0]
        self._names: Counter = Counter()  # of the open elements
        self._unread: list[str] = []  # open elements from one of UNREAD on
        self._unread_names: Counter = Counter()
        self._text: list[str] = []
        self._owner = 0
        self._links = 0
        self._parse(source or "")

    def _parse(self, s: str) -> None:
        at, n, lower = 0, len(s), None
        last = s.rfind(">")
        while at < n:
            if at > last:  # no tag ends any more; an open comment runs to the end
                comment = s.find("<!--", at)
                self._say(s[at:] if comment < 0 else s[at:comment])
                break
            m = TAG.search(s, at)
            if m is None:
                self._say(s[at:])
                break
            if m.start() > at:
                self._say(s[at : m.start()])
            at = m.end()
            if tag := m["open"]:
                tag = tag.lower()
                attrs = m["attrs"] or ""
                if tag in RAW:
                    lower = s.lower() if lower is None else lower
                    if len(lower) != n:  # a lower case of another length would shift the places
                        end = re.compile(f"</{tag}", re.I).search(s, at)
                        close = end.start() if end else -1
                    else:
                        close = lower.find(f"</{tag}", at)
                    at = n if close < 0 else s.find(">", close) + 1 or n
                    continue
                if not self._pass_start(tag, attrs):
                    self._start(tag, attrs)
            elif tag := m["close"]:
                if not self._pass_end(tag := tag.lower()):
                    self._end(tag)
        self._flush()

    def _pass_start(self, tag: str, attrs: str) -> bool:
        """Whether a start tag belongs to an element that isn't read."""
        if self._unread:
            if tag not in BREAKS_OUT or self._unread[0] not in LEFT_BY_BLOCKS or self._unread_names["foreignobject"]:
                self._enter(tag, attrs)
                return True
            self._leave(0)
        if tag in UNREAD:
            self._enter(tag, attrs)
            return True
        return False

    def _pass_end(self, tag: str) -> bool:
        """Whether an end tag belongs to an element that isn't read."""
        if not self._unread:
            return False
        if self._unread_names[tag]:
            at = len(self._unread) - 1
            while self._unread[at] != tag:
                at -= 1
            self._leave(at)
            return True
        if tag in INLINE or not self._names[tag]:
            return True
        self._leave(0)
        return False

    def _enter(self, tag: str, attrs: str) -> None:
        if tag not in VOID and not attrs.endswith("/"):
            self._unread.append(tag)
            self._unread_names[tag] += 1

    def _leave(self, depth: int) -> None:
        self._unread_names.subtract(self._unread[depth:])
        del self._unread[depth:]

    def _say(self, text: str) -> None:
        if self._unread or (not self._text and not text.strip()):
            return
        if not self._text:
            self._owner = self._block_owner()
        self._text.append(text)
        if any(self.nodes[k].tag == "a" for k in self._open[-3:]):
            self._links += len(text.strip())

    def _block_owner(self) -> int:
        for k in reversed(self._open):
            if self.nodes[k].tag not in INLINE:
                return k
        return 0

    def _flush(self) -> None:
        if self._text:
            text = SPACE.sub(" ", html.unescape("".join(self._text))).strip()
            if text:
                if self.nodes[self._owner].tag in BARE:
                    self._owner = self._add("#text", "", self._owner)
                self.blocks.append((self._owner, text))
                node = self.nodes[self._owner]
                node.chars += len(text)
                node.link_chars += self._links
                node.stops += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", "…"))
                node.blocks += 1
        self._text, self._links = [], 0

    def _start(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self._flush()
            if tag in CLOSES_P:
                self._pop_to({"p"}, SCOPES)
            if tag in CLOSES_SAME:
                self._pop_to(*CLOSES_SAME[tag])
        elif tag == "br" and self._text:
            self._text.append(" ")
        added = self._add(tag, attrs, self._open[-1])
        if tag not in VOID:
            self._open.append(added)
            self._names[tag] += 1

    def _add(self, tag: str, attrs: str, parent: int) -> int:
        node = Node(tag, attrs, parent, self.nodes[parent].depth + 1, len(self.nodes[parent].children))
        self.nodes[parent].children.append(len(self.nodes))
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _close(self, depth: int) -> None:
        for k in self._open[depth:]:
            self._names[self.nodes[k].tag] -= 1
        del self._open[depth:]

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if not self._names[tag]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.nodes[self._open[depth]].tag
            if name == tag:
                self._close(depth)
                return
            if tag in INLINE and name in SCOPES:
                return

    def _pop_to(self, tags: set[str], scopes) -> None:
        if not any(self._names[t] for t in tags):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.nodes[self._open[depth]].tag
            if name in tags:
                self._close(depth)
                return
            if name in scopes:
                return


def attributes(source: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(source)}
