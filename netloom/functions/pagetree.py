"""Element tree of one page, for use inside an Arrow map.

``read_page`` turns the HTML of one page into its elements and its text
blocks.  It is the only place that needs a parser; everything above it is
Spark work on the rows it yields.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "head", "header", "hr", "html", "li", "main", "nav", "noscript", "ol", "option", "p", "pre",
         "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title",
         "tr", "ul"}
# A start tag on the left ends an open element on the right.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
INLINE_MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}
LIST_TAGS = {"ul", "ol"}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.blocks = [], []
        self.stack = []  # (tag, node position)
        self.text, self.marked = [], []
        self.marks = []  # (tag, index into self.marked, attrs)
        self.cells, self.row_open, self.rows_in_table = None, False, 0
        self.counters = []

    # Text is gathered until a block boundary, then becomes one block.
    def flush(self):
        for i in range(len(self.marks) - 1, -1, -1):
            self.close_mark(i)
        plain = " ".join("".join(self.text).split())
        marked = "".join(self.marked).strip()
        self.text, self.marked = [], []
        self.marks = [(t, 0, a) for t, _, a in self.marks]
        if not plain:
            if not (marked and "![" in marked):
                return
        if self.cells is not None and self.row_open:
            self.cells.append((plain, marked))
            return
        self.emit(plain, marked)

    def emit(self, plain, marked):
        tags = [t for t, _ in self.stack]
        tag = next((t for t in reversed(tags) if t in BLOCK), "")
        level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
        if level:
            marked = "#" * level + " " + marked
        elif tag == "li":
            depth = sum(t in LIST_TAGS for t in tags) - 1
            parent = next((t for t in reversed(tags) if t in LIST_TAGS), "ul")
            if parent == "ol" and self.counters:
                bullet = f"{self.counters[-1]}. "
            else:
                bullet = "- "
            marked = "    " * max(depth, 0) + bullet + marked
        elif tag == "pre":
            marked = "```\n" + "".join(marked) + "\n```"
        if "blockquote" in tags:
            marked = "\n".join("> " + line for line in marked.split("\n"))
        self.blocks.append({
            "pos": len(self.blocks), "ancestors": [p for _, p in self.stack], "tag": tag,
            "level": level, "text": plain, "markdown": marked})

    def close_mark(self, i):
        tag, start, attrs = self.marks[i]
        inner = "".join(self.marked[start:])
        body = inner.strip()
        if not body:
            return
        lead = inner[: len(inner) - len(inner.lstrip())]
        trail = inner[len(inner.rstrip()):]
        if tag == "a":
            title = f' "{attrs["title"]}"' if attrs.get("title") else ""
            body = f"[{body}]({attrs['href'].strip()}{title})"
        else:
            body = INLINE_MARKS[tag] + body + INLINE_MARKS[tag]
        self.marked[start:] = [lead + body + trail]

    def pop_to(self, depth):
        while len(self.stack) > depth:
            tag, _ = self.stack[-1]
            if tag in BLOCK:
                self.flush()
                self.marks = []
            elif self.marks and self.marks[-1][0] == tag:
                self.close_mark(len(self.marks) - 1)
                self.marks.pop()
            if tag == "tr" and self.cells is not None:
                self.end_row()
            if tag == "table":
                self.cells = None
            if tag in LIST_TAGS and self.counters:
                self.counters.pop()
            self.stack.pop()

    def end_row(self):
        self.row_open = False
        if self.cells:
            line = "| " + " | ".join(m.replace("\n", " ") for _, m in self.cells) + " |"
            if self.rows_in_table == 0:
                line += "\n| " + " | ".join("---" for _ in self.cells) + " |"
            self.rows_in_table += 1
            self.emit(" ".join(p for p, _ in self.cells), line)
        self.cells = []

    def handle_starttag(self, tag, attrs):
        attrs = {k: v if v is not None else "" for k, v in attrs}
        if tag in BLOCK:
            self.flush()
            # An open paragraph ends where any other block starts.
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self.pop_to(i)
                    break
                if self.stack[i][0] in BLOCK:
                    break
            ends = ENDS.get(tag, ())
            for i in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[i][0]
                if open_tag in ends:
                    self.pop_to(i)
                elif open_tag in BLOCK:
                    break
        pos = len(self.nodes)
        self.nodes.append({
            "pos": pos, "tag": tag, "id": attrs.get("id"),
            "classes": attrs.get("class", "").split(), "attrs": list(attrs.items()),
            "ancestors": [p for _, p in self.stack]})
        if tag == "br":
            self.text.append("\n")
            self.marked.append("  \n")
        elif tag == "img":
            self.marked.append(f"![{attrs.get('alt', '')}]({attrs.get('src', '')})")
        if tag in VOID:
            return
        if tag == "table":
            self.cells, self.rows_in_table = [], 0
        if tag == "tr" and self.cells is not None:
            self.row_open = True
        if tag in LIST_TAGS:
            self.counters.append(0)
        if tag == "li" and self.counters:
            self.counters[-1] += 1
        self.stack.append((tag, pos))
        if tag in INLINE_MARKS or (tag == "a" and attrs.get("href")):
            self.marks.append((tag, len(self.marked), attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        in_pre = any(t == "pre" for t, _ in self.stack)
        if in_pre:
            self.marked.append(data)
        else:
            squashed = " ".join(data.split())
            if data[:1].isspace():
                squashed = " " + squashed
            if data[-1:].isspace() and squashed.strip():
                squashed += " "
            if self.marked and self.marked[-1][-1:].isspace():
                squashed = squashed.lstrip()
            self.marked.append(squashed)


def read_page(html: str) -> tuple[list[dict], list[dict]]:
    """Elements and text blocks of one page, both in document order."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.pop_to(0)
    builder.flush()
    return builder.nodes, builder.blocks
