"""A small DOM on the standard library, to check extraction in another way.

Only what the tests need: open elements, implied ends of ``p`` and ``li``, and
selection by tag, class, id or attribute below an ancestor.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set((
    "p div ul ol li dl table h1 h2 h3 h4 h5 h6 section article aside main nav header footer form figure "
    "blockquote pre hr").split())
PART = re.compile(r"""([a-z][a-z0-9]*)?(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(\*?)=['"]([^\]]*)['"]\])?$""")


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def text(self):
        return "".join(c if isinstance(c, str) else ("" if c.tag in ("script", "style") else c.text())
                       for c in self.children)

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", [], None)
        self.at = self.root

    def close_upto(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def open_p(self):
        node = self.at
        while node is not self.root:
            if node.tag == "p":
                return True
            if node.tag in BLOCKS:
                return False
            node = node.parent
        return False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.open_p():
            self.close_upto("p")
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.close_upto(tag)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html):
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def matches(node, part):
    tag, cls, id_, attr, has, value = PART.match(part).groups()
    if tag and node.tag != tag:
        return False
    if cls:
        return cls in (node.attrs.get("class") or "").split()
    if id_:
        return node.attrs.get("id") == id_
    if attr:
        got = node.attrs.get(attr)
        return got is not None and (value in got if has else got == value)
    return True


def select(root, selector):
    parts = re.findall(r"""[^\s\[]*(?:\[[^\]]*\])?""", selector)
    parts = [p for p in parts if p]
    found = []
    for node in root.walk():
        if not matches(node, parts[-1]):
            continue
        want = list(parts[:-1])
        for up in node.ancestors():
            if up is root and not root.tag.startswith("#"):
                break
            if want and up.tag != "#root" and matches(up, want[-1]):
                want.pop()
        if not want:
            found.append(node)
    return found


def first(root, selector):
    found = select(root, selector)
    return found[0] if found else None


def drop(root, selector):
    for node in select(root, selector):
        node.parent.children = [c for c in node.parent.children if c is not node]
