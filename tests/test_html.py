"""HTML to AsciiDoc against a plain version that builds the tree and walks it."""

import random
from html.parser import HTMLParser

import pytest

from strataloom.operators import html


class Tree(HTMLParser):
    """Nested lists [tag, attrs, children]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closed = html._CLOSES.get(tag, {"p"} if tag in html._BLOCK else set())
        while len(self.open) > 1 and self.open[-1][0] in closed:
            self.open.pop()
        self.handle_startendtag(tag, attrs)
        if tag not in html._VOID:
            self.open.append(self.open[-1][2][-1])

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        if tag in [x[0] for x in self.open[1:]]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.open[-1][2].append(data)


def text_of(x):
    return x if isinstance(x, str) else "".join(map(text_of, x[2]))


def body_of(x):
    if isinstance(x, str):
        return None
    return x if x[0] == "body" else next((b for b in map(body_of, x[2]) if b), None)


def level_of(tag):
    return int(tag[1]) if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0


def inline(x):
    out = ""
    for c in x[2]:
        t = text_of(c)
        tag = "" if isinstance(c, str) else c[0]
        out += {"em": f"_{t}_", "i": f"_{t}_", "strong": f"*{t}*", "b": f"*{t}*", "code": f"``{t}``", "br": " +\n"}.get(tag) or (f"{t}[{c[1].get('href', '')}]" if tag == "a" else t)
    return out.strip()


def full(x, out):
    tag, _, children = x
    tags = [c for c in children if not isinstance(c, str)]
    if level_of(tag):
        out.append("=" * level_of(tag) + " " + text_of(x).strip())
    elif tag == "p":
        out += [inline(x)] if inline(x) else []
    elif tag == "pre":
        out += ["[source,text]", "----", text_of(x).strip(), "----"] if text_of(x).strip() else []
    elif tag in ("ul", "ol"):
        out += ["", *("* " + inline(c) for c in tags if c[0] == "li"), ""]
    elif tag == "blockquote":
        for c in tags:
            out += ["[NOTE]", "==== " + inline(c), ""] if c[0] == "p" else []
    else:
        for c in tags:
            full(c, out)


def short(x, out):
    for c in x[2]:
        if isinstance(c, str):
            out += [c.strip()] if c.strip() else []
        elif level_of(c[0]):
            out += ["", "=" * level_of(c[0]) + " " + text_of(c).strip(), ""]
        elif c[0] == "pre":
            out += ["[source,text]", "----", *text_of(c).rstrip().splitlines(), "----", ""] if text_of(c).rstrip() else []
        elif c[0] in ("p", "div"):
            out.append(text_of(c).strip())
        else:
            short(c, out)


def plain_version(markup, plain, head=()):
    tree = Tree()
    tree.feed(markup)
    tree.close()
    body, out = body_of(tree.root), list(head)
    if plain and body is None:
        return "= [EPUB vide]\n\n"
    (short if plain else full)(body or tree.root, out)
    text = "\n".join(out).rstrip()
    return text + "\n" if plain or text.strip() else "= [EPUB vide]\n\n"


TAGS = ["h1", "h3", "p", "pre", "ul", "ol", "li", "blockquote", "div", "section", "em", "b", "code", "a", "br", "span", "script", "table", "tr", "td", "body", "head", "article", "img", "i", "strong"]


@pytest.mark.parametrize("seed", range(40))
def test_random_markup(seed):
    rng = random.Random(seed)
    for _ in range(60):
        parts = ["<body>"] if rng.random() < 0.5 else []
        for _ in range(rng.randint(0, 40)):
            tag = rng.choice(TAGS)
            parts.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", f"</{tag}>", f"<{tag} href='u'/>", " one ", "t&amp;w\n o", "\n", "<!-- c -->", "<", "<a href=x>", "</body>" if rng.random() < 0.2 else "x"]))
        markup = "".join(parts)
        for plain in (False, True):
            for head in ((), ("= T", "")):
                assert html.asciidoc(markup, plain, head) == plain_version(markup, plain, head), markup


def test_depth():
    n = 100_000
    page = "<body>" + "<div><span>" * n + "<p>deep</p>" + "</span></div>" * n + "<h2>after</h2></body>"
    assert html.asciidoc(page) == "deep\n== after\n"
    assert html.asciidoc("<body>" + "<section>" * n + "deep" + "</section>" * n + "</b>" * n + "</body>", True) == "deep\n"
    assert html.asciidoc("<body><p>" + "<b>" * n + "deep") == "*deep*\n"
