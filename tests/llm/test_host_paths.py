"""What lies beside the body text stays, and marked wrappers don't take the article with them."""

from __future__ import annotations

import collections
import random
import re
from html.parser import HTMLParser

import pytest

from parley.llm import host_paths

BODY = "<p>" + "words " * 60 + "</p>"
TEXT = ("words " * 60).strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div class=content><h1>Title</h1><div class=text>{BODY}</div></div>", f"Title\n{TEXT}"),
        (f"<div><div>{'intro ' * 20}</div><div>{BODY}</div></div>", f"{('intro ' * 20).strip()}\n{TEXT}"),
        (f"<div><div><a href=1>many links</a></div><div>{BODY}</div></div>", TEXT),
        (f"<div class='layout with-sidebar'><h1>Title</h1>{BODY}<div class=sidebar>no</div></div>", f"Title\n{TEXT}"),
        (f"<article class='post has-comments'>{BODY}<div class=comments>no</div></article>", TEXT),
        (f"<div class=has-sidebar><main><p>short</p></main><div class=related>{BODY}</div></div>", "short"),
        (f"<article><p>short</p></article><div class=comments><article class=comment>{BODY}</article></div>", "short"),
    ],
)
def test_nothing_else_is_dropped(html, text):
    assert host_paths.main_text(html) == text


STORY = "<p>" + "The story goes on about many things that people did. " * 6 + "</p>"
NAV = "<nav><ul><li><a href='/'>Home page</a></li><li><a href='/n'>All the news</a></li></ul></nav>"
KEPT = {
    "a form around the page": (f"<form id='aspnetForm'><div class='nav'><a href='x'>Home</a> <a href='y'>News</a></div><div class='content'><h1>Head</h1>{STORY}</div></form>", "Head"),
    "a table that is called a widget": (f"{NAV}<table class='widget'><tr><td>{STORY}</td></tr></table>", None),
    "a dialog": (f"<div role='dialog'>{STORY}</div>{NAV}", None),
    "an aside": (f"{NAV}<aside>{STORY}</aside>", None),
    "a quotation": (f"{NAV}<blockquote class='social'>{STORY}</blockquote>", None),
    "a paragraph on shares": (f"{NAV}<article>{STORY}<p class='share-price'>The price rose by ten</p></article>", "The price rose by ten"),
    "a heading": (f"{NAV}<article><h2 id='social'>Social life</h2>{STORY}</article>", "Social life"),
    "a list": (f"{NAV}<article>{STORY}<ul class='menu'><li>Soup of the day</li><li>Bread</li></ul></article>", "Soup of the day\nBread"),
    "a header of the post": (f"{NAV}<div class='post'><div class='post-header'><h1>Headline</h1></div>{STORY}</div>", "Headline"),
}
GONE = {
    "an advert": f"<article>{STORY}<p class='advert'>Buy this now</p></article>",
    "a notice": f"<article>{STORY}</article><div class='cookie-notice'>We use cookies of all kinds</div>",
    "comments, longer than the article": f"<div class='post'>{STORY}</div><div class='comments'>{STORY.replace('story', 'reader')}{STORY.replace('story', 'reader')}</div>",
    "a list of links": f"<ul class='menu'><li><a href='x'>First</a></li><li><a href='y'>Second</a></li></ul><div>{STORY}</div>",
    "a footer and a button": f"<div>{STORY}</div><footer>All rights reserved</footer><button>Press here</button>",
    "something hidden": f"<div>{STORY}<div hidden>{STORY.replace('story', 'secret')}</div></div>",
}


def plain_story() -> str:
    return " ".join(STORY[3:-4].split())


@pytest.mark.parametrize("case", KEPT)
def test_no_article_is_lost(case):
    html, more = KEPT[case]
    text = host_paths.main_text(f"<html><body>{html}</body></html>")
    assert plain_story() in text.split("\n") and (more is None or more in text) and "Home" not in text


@pytest.mark.parametrize("case", GONE)
def test_what_is_no_article_goes(case):
    assert host_paths.main_text(f"<html><body>{GONE[case]}</body></html>") == plain_story()


def test_a_teaser_at_the_hosts_path_is_no_article(spark):
    rows = [(k, f"http://h.org/{k}", f"<body>{NAV}<div class='content'>{STORY}</div></body>") for k in range(5)]
    rows.append((9, "http://h.org/9", f"<body>{NAV}<div class='story'>{STORY}</div><div class='content'>Read more</div></body>"))
    found = {r.page_id: r.text for r in host_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(plain_story() in text for text in found.values()) and len(found) == 6


class Tree(HTMLParser):
    """Pages as trees by the standard library's parser; for pages whose tags are all closed."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.root = self.now = ("", {}, [], None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [], self.now)
        self.now[2].append(node)
        self.now = node

    def handle_endtag(self, tag):
        self.now = self.now[3]

    def handle_data(self, data):
        self.now[2].append(data)


def slow_lines(node, seen=lambda _: True) -> list[str]:
    """Texts of paragraphs and headings below a node, one a line; what ``seen`` refuses is left out."""
    if isinstance(node, str):
        return []
    if not seen(node):
        return []
    if node[0] in ("p", "h1", "h2", "li"):
        words: list[str] = []

        def walk(x):
            for child in x[2]:
                words.extend([child] if isinstance(child, str) else [])
                if not isinstance(child, str):
                    walk(child)

        walk(node)
        text = " ".join("".join(words).split())
        return [text] if text else []
    return [line for child in node[2] for line in slow_lines(child, seen)]


def slow_article(root):
    """Its own way to the article: the innermost div that holds nearly all the paragraph text outside of named parts."""
    named = lambda n: n[0] in ("nav", "footer", "aside") or n[1].get("class", "").split("-")[0] in ("comments", "sidebar", "ad", "cookie")
    size = lambda n: sum(map(len, slow_lines(n, lambda x: not named(x))))
    at = next(c for c in root[2][0][2] if not isinstance(c, str) and c[0] == "body")
    while True:
        inner = [c for c in at[2] if not isinstance(c, str) and c[0] in ("div", "section") and not named(c)]
        ahead = max(inner, key=size, default=None)
        if ahead is None or size(ahead) < size(at):
            return at, named
        at = ahead


def slow_path(node) -> str:
    out = []
    while node is not None and node[0]:
        out.append(".".join([node[0], *sorted({re.sub(r"\d+", "#", c) for c in node[1].get("class", "").split()})]))
        node = node[3]
    return "/".join(reversed(out))


def slow_extract(rows: list[tuple]) -> dict[int, str]:
    """Trees, scores, votes and re-extraction without anything of the library."""
    trees = {i: Tree(html).root for i, _, html in rows}
    host = {i: url.split("/")[2] for i, url, _ in rows}
    votes = collections.defaultdict(collections.Counter)
    for i, root in trees.items():
        votes[host[i]][slow_path(slow_article(root)[0])] += 1
    out = {}
    for i, root in trees.items():
        own, named = slow_article(root)
        path = votes[host[i]].most_common(1)[0][0]
        stack, hits = [root], []
        while stack:
            n = stack.pop()
            if slow_path(n) == path and n[0]:
                hits.append(n)
            stack.extend(c for c in n[2] if not isinstance(c, str))
        mine = "\n".join(slow_lines(own, lambda x: not named(x)))
        theirs = "\n".join(line for n in hits for line in slow_lines(n, lambda x: not named(x)))
        out[i] = theirs if theirs and 10 * len(theirs) >= len(mine) else mine
    return out


def test_equal_to_an_independent_extractor(spark):
    rng = random.Random(12)
    say = lambda a, b: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(a, b)))
    links = lambda: "<ul>" + "".join(f"<li><a href='/{k}'>{say(1, 3)}</a></li>" for k in range(rng.randint(2, 5))) + "</ul>"
    rows = []
    for i in range(150):
        host = rng.randint(0, 5)
        body = f"<h1>{say(2, 5)}</h1>" + "".join(f"<p>{say(15, 40)}</p>" for _ in range(rng.randint(2, 5)))
        inner = f"<div class='box{rng.randint(1, 9)} text-{host}'>{body}</div>"
        if rng.random() < 0.1:
            inner = f"<section class='other'>{body}</section>"
        for _ in range(host % 3):
            inner = f"<div class='wrap'>{inner}</div>"
        parts = [f"<nav>{links()}</nav>", inner, f"<aside><p>{say(2, 6)}</p></aside>", f"<div class='comments'><p>{say(3, 12)}</p></div>", f"<footer><p>{say(2, 5)}</p></footer>", f"<div class='sidebar-{i}'>{links()}</div>", f"<div class='ad'><p>{say(2, 5)}</p></div>", f"<div class='cookie-box'><p>{say(3, 6)}</p></div>"]
        kept = [p for p in parts if p is inner or rng.random() < 0.7]
        rows.append((i, f"http://h{host}.org/{i}", f"<html><head></head><body>{''.join(kept)}</body></html>".replace("<head></head>", "")))
    found = {r.page_id: r.text for r in host_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == slow_extract(rows)
