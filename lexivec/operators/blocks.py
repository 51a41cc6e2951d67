"""Top-level blocks of a Markdown text, as half-open byte ranges.

A line scanner after the CommonMark block rules, with tables and footnote definitions. Only depth 0
matters: what a list or a quotation contains belongs to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_FENCE = re.compile(rb"^ {0,3}(`{3,}|~{3,})([^\r\n]*)")
_ATX = re.compile(rb"^ {0,3}#{1,6}(?:[ \t\r\n]|$)")
_SETEXT = re.compile(rb"^ {0,3}(?:=+|-+)[ \t]*\r?\n?$")
_BREAK = re.compile(rb"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\r?\n?$")
_ITEM = re.compile(rb"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|\r?\n?$)")
_QUOTE = re.compile(rb"^ {0,3}>")
_INDENTED = re.compile(rb"^(?: {4}| {0,3}\t)")
_FOOTNOTE = re.compile(rb"^ {0,3}\[\^[^\]\s]+\]:")
_REFERENCE = re.compile(rb"^ {0,3}\[(?!\^)[^\]]+\]:[ \t]*\S+")
_DELIMITER = re.compile(rb"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\r?\n?$")

# Elements that start an HTML block of the sixth kind.
_HTML_NAMES = (
    b"address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt"
    b" fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link"
    b" main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead"
    b" title tr track ul"
).split()
_HTML_NAMED = re.compile(rb"^ {0,3}</?(?:" + b"|".join(_HTML_NAMES) + rb")(?:[ \t\r\n>]|/>|$)", re.I)
_HTML_TAG = re.compile(rb"""^ {0,3}(?:<[a-zA-Z][a-zA-Z0-9-]*(?:\s+[a-zA-Z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[a-zA-Z][a-zA-Z0-9-]*\s*>)[ \t]*\r?\n?$""")
#: Start and end conditions of the kinds that end with a mark of their own.
_HTML_MARKED = (
    (re.compile(rb"^ {0,3}<(?:script|pre|style|textarea)(?:[ \t\r\n>]|$)", re.I), re.compile(rb"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(rb"^ {0,3}<!--"), re.compile(rb"-->")),
    (re.compile(rb"^ {0,3}<\?"), re.compile(rb"\?>")),
    (re.compile(rb"^ {0,3}<!\[CDATA\["), re.compile(rb"\]\]>")),
    (re.compile(rb"^ {0,3}<![a-zA-Z]"), re.compile(rb">")),
)


@dataclass(frozen=True)
class Block:
    kind: str
    start: int
    end: int


def frontmatter_end(source: bytes) -> int:
    """Where a leading ``---`` block ends, its closing line included; 0 without one."""
    head = re.match(rb"---\r?\n", source)
    if head is None:
        return 0
    close = re.compile(rb"^---(?:\r?\n|\r?\Z)", re.M).search(source, head.end())
    return close.end() if close else 0


class Scanner:
    def __init__(self, source: bytes, start: int):
        self.lines: list[tuple[int, bytes]] = []
        at = start
        for line in source[start:].splitlines(keepends=True) if b"\x0b" not in source and b"\x0c" not in source else re.findall(rb"[^\n]*\n|[^\n]+\Z", source[start:]):
            self.lines.append((at, line))
            at += len(line)
        self.end = len(source)

    def at(self, i: int) -> int:
        return self.lines[i][0] if i < len(self.lines) else self.end

    def blank(self, i: int) -> bool:
        return not self.lines[i][1].strip()

    def blocks(self) -> list[Block]:
        out, i = [], 0
        while i < len(self.lines):
            if self.blank(i):
                i += 1
                continue
            kind, stop = self.block(i)
            if kind:
                out.append(Block(kind, self.at(i), self.at(stop)))
            i = stop
        return out

    def block(self, i: int) -> tuple[str | None, int]:
        """Kind of the block that starts at line ``i`` (None: it makes none) and the line after it."""
        line = self.lines[i][1]
        if m := _FENCE.match(line):
            if m[1][:1] == b"~" or b"`" not in m[2]:
                return "code", self.fenced(i, m[1])
        if _INDENTED.match(line):
            return "code", self.indented(i)
        if _ATX.match(line):
            return "heading", i + 1
        for start, stop in _HTML_MARKED:
            if start.match(line):
                return "html", self.marked(i, stop)
        if _HTML_NAMED.match(line) or _HTML_TAG.match(line):
            return "html", self.until_blank(i)
        if _BREAK.match(line):
            return "rule", i + 1
        if _QUOTE.match(line):
            return "quote", self.container(i, quote=True)
        if _FOOTNOTE.match(line):
            return "footnote", self.container(i, indent=4)
        if m := _ITEM.match(line):
            return "list", self.list(i, m)
        if i + 1 < len(self.lines) and b"|" in line and _DELIMITER.match(self.lines[i + 1][1]) and b"-" in self.lines[i + 1][1]:
            if self.cells(line) == self.cells(self.lines[i + 1][1]):
                return "table", self.table(i)
        if _REFERENCE.match(line):
            return None, i + 1
        return self.paragraph(i)

    @staticmethod
    def cells(line: bytes) -> int:
        return len(re.split(rb"(?<!\\)\|", line.strip().strip(b"|")))

    def fenced(self, i: int, fence: bytes) -> int:
        close = re.compile(rb"^ {0,3}" + re.escape(fence[:1]) + b"{%d,}[ \t]*\r?\n?$" % len(fence))
        for j in range(i + 1, len(self.lines)):
            if close.match(self.lines[j][1]):
                return j + 1
        return len(self.lines)

    def indented(self, i: int) -> int:
        last = i
        for j in range(i, len(self.lines)):
            if self.blank(j):
                continue
            if not _INDENTED.match(self.lines[j][1]):
                break
            last = j
        return last + 1

    def marked(self, i: int, stop: re.Pattern) -> int:
        for j in range(i, len(self.lines)):
            if stop.search(self.lines[j][1]):
                return j + 1
        return len(self.lines)

    def until_blank(self, i: int) -> int:
        while i < len(self.lines) and not self.blank(i):
            i += 1
        return i

    def table(self, i: int) -> int:
        j = i + 2
        while j < len(self.lines) and not self.blank(j) and not self.interrupts(j):
            j += 1
        return j

    def interrupts(self, i: int) -> bool:
        """Whether a line ends a paragraph before it."""
        line = self.lines[i][1]
        if _INDENTED.match(line):
            return False
        if m := _ITEM.match(line):
            return bool(line[m.end() :].strip()) and (not m[2][:1].isdigit() or m[2][:-1] == b"1")
        fence = _FENCE.match(line)
        return bool(
            _ATX.match(line)
            or _BREAK.match(line)
            or _QUOTE.match(line)
            or _FOOTNOTE.match(line)
            or _HTML_NAMED.match(line)
            or any(start.match(line) for start, _ in _HTML_MARKED)
            or (fence and (fence[1][:1] == b"~" or b"`" not in fence[2]))
        )

    def paragraph(self, i: int) -> tuple[str, int]:
        j = i + 1
        while j < len(self.lines) and not self.blank(j):
            if _SETEXT.match(self.lines[j][1]):
                return "heading", j + 1
            if self.interrupts(j):
                break
            j += 1
        return "paragraph", j

    def container(self, i: int, quote: bool = False, indent: int = 0) -> int:
        """The line after a quotation or footnote: its marked or indented lines and lazy ones."""
        last, lazy = i, True
        for j in range(i + 1, len(self.lines)):
            line = self.lines[j][1]
            if self.blank(j):
                lazy = False
                if quote:
                    break
                continue
            inside = _QUOTE.match(line) if quote else len(line) - len(line.lstrip(b" ")) >= indent
            if not inside and (not lazy or self.interrupts(j)):
                break
            last, lazy = j, True
        return last + 1

    def list(self, i: int, m: re.Match) -> int:
        """The line after a list: items of its kind, what is indented under them, lazy lines."""
        kind = m[2][-1:]
        width = m.end() if m[3].strip(b"\r\n") else m.end(2) + 1
        last, lazy, fence = i, True, None
        if f := _FENCE.match(self.lines[i][1][m.end() :]):
            fence = f[1]
        for j in range(i + 1, len(self.lines)):
            line = self.lines[j][1]
            if self.blank(j):
                lazy = False
                continue
            depth = len(line) - len(line.lstrip(b" "))
            body = line[min(depth, width) :]
            if fence:
                if depth < width and not lazy:
                    break
                if re.match(rb" {0,3}" + re.escape(fence[:1]) + b"{%d,}[ \t]*\r?\n?$" % len(fence), body):
                    fence = None
                last, lazy = j, True
                continue
            item = _ITEM.match(line)
            if depth >= width:
                if f := _FENCE.match(body):
                    fence = f[1]
            elif item and item[2][-1:] == kind and not _BREAK.match(line):
                width = item.end() if item[3].strip(b"\r\n") else item.end(2) + 1
                if f := _FENCE.match(line[item.end() :]):
                    fence = f[1]
            elif not lazy or self.interrupts(j):
                break
            last, lazy = j, True
        return last + 1


def segment(source: bytes) -> list[Block]:
    """Blocks in order without overlap; frontmatter is not one."""
    return Scanner(source, frontmatter_end(source)).blocks()
