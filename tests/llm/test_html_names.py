import time
import tracemalloc

import pytest

from supportlens.llm import html_text

TEXT = ("The article says what it has to say. " * 9).strip()
OTHER = ("Somebody else wrote this much longer piece of text. " * 12).strip()


def own_text(page):
    page = html_text.Page(page)
    return page.text(page.best())


OUTERS = ["main", "article", "main><article", "body><main", "div class=content><article"]
BLOCKS = [
    "div class='user-comments'", "div class='post-comments'", "div class='js-comments'", "section id='post-comments'", "ol class=commentlist",
    "div class=replies", "section id=responses", "div id=disqus_thread", "div class=sidebar", "div class=menu", "div class=footer", "div class=notice",
    "div class=advert", "div class=newsletter", "div class=related-posts", "div class='newsletter-signup-box'", "div class=cookie-message",
    "div id=cookie-banner", "div class='left-sidebar dark'", "ul class=breadcrumbs", "div class=share-buttons", "section class='sponsored-content'",
]


@pytest.mark.parametrize("outer", OUTERS)
@pytest.mark.parametrize("block", BLOCKS)
def test_furniture_goes_at_every_length(outer, block):
    ends = "".join(f"</{tag.split()[0]}>" for tag in reversed(outer.split("><")))
    for words in ("Short.", TEXT[:240], OTHER):
        part = f"<{block}><li><p>{words}</p></{block.split()[0]}>"
        assert own_text(f"<body><{outer}><h1>Title</h1><p>{TEXT}</p>{part}{ends}</body>") == f"Title\n\n{TEXT}"


@pytest.mark.parametrize("block", ["div class=blog-comments", "section id=responses", "section id=comments", "div class=comment-thread"])
def test_comments_beside_the_text(block):
    part = f"<{block}><p>{OTHER}</p></{block.split()[0]}>"
    assert own_text(f"<body><div class=content><p>{TEXT}</p></div>{part}</body>") == TEXT
    assert own_text(f"<body><article><p>{TEXT}</p></article>{part}</body>") == TEXT


@pytest.mark.parametrize("kind", ["reply", "comment", "comment user-7"])
def test_articles_of_readers_do_not_win(kind):
    replies = "".join(f"<article class='{kind}'><p>{OTHER}</p></article>" for _ in range(3))
    assert own_text(f"<body><article><p>{TEXT}</p></article>{replies}</body>") == TEXT
    assert own_text(f"<body><article><p>{TEXT}</p>{replies}</article></body>") == TEXT


def test_the_only_article_stays_whatever_its_name():
    assert own_text(f"<body><nav>Menu</nav><article class='comment'><p>{TEXT}</p></article></body>") == TEXT


def test_many_short_articles_do_not_win_over_a_long_one():
    teasers = "".join(f"<article class=teaser><p>{TEXT[:150]}</p></article>" for _ in range(20))
    assert own_text(f"<body><article class=story><p>{OTHER} {OTHER}</p></article>{teasers}</body>") == f"{OTHER} {OTHER}"


@pytest.mark.parametrize(
    "block",
    [
        "section id=related-work", "div class=related-work", "section class='search-algorithms'", "div id=social-history", "div class=notice-period",
        "section id=menu-planning", "div id=advertising-costs", "section id=survey-responses", "div class='has-sidebar'", "div class='text no-comments'",
        "div class='body with-menu'", "section class=commentary", "div class=shared-values",
    ],
)
def test_topics_stay(block):
    part = f"<{block}><p>{TEXT}</p></{block.split()[0]}>"
    assert own_text(f"<body><article><h1>Title</h1><p>{TEXT}</p>{part}</article></body>") == f"Title\n\n{TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("tag", ["h2", "p", "li"])
def test_anchors_of_the_text_stay(tag):
    assert own_text(f"<body><article><p>{TEXT}</p><{tag} id='search-comments'>Anchor text</{tag}></article></body>") == f"{TEXT}\n\nAnchor text"


def test_wrappers_that_hold_the_text_stay():
    for name in ("sidebar-layout", "page-with-menu", "navigation-page"):
        assert own_text(f"<body><main><div class='{name}'><p>{TEXT}</p></div></main></body>") == TEXT
        assert own_text(f"<body><div class='{name}'><p>{TEXT}</p></div><p>x</p></body>").startswith(TEXT)


N = 100_000
DEEP = {
    "divs": "<div>" * N + "deep",
    "divs with classes": "".join(f"<div class='c{i % 7}'>" for i in range(N // 2)) + "deep",
    "inline and rules": "<b>" * (N // 2) + "<hr>" * (N // 2) + "deep",
    "unmatched ends": "<b>" * (N // 2) + "</i>" * (N // 2) + "deep",
    "items": "<ul>" + "<b>" * (N // 4) + "<li>x" * (N // 4) + "deep",
    "options": "<option><select>" + "<b>" * (N // 4) + "<option>" * (N // 4) + "</select>deep",
    "lists in lists": "<ul><li>" * (N // 4) + "deep",
    "tables": "<table><tr><td>" * (N // 6) + "deep",
    "svg": "<svg>" + "<g>" * (N // 4) + "</g>" * (N // 4) + "</svg>deep",
    "foreign blocks": "<svg><foreignObject>" + "<div>" * (N // 4) + "</svg>deep",
    "named in main": "<main>" + "<div class=notice-x>" * (N // 4) + "deep",
    "siblings of one path": "<div>" * (N // 4) + "<section>deep</section>" * (N // 4),
}


@pytest.mark.parametrize("name", DEEP)
def test_time_and_memory_are_linear(name):
    own_text("<p>warm</p>")
    start = time.process_time()
    assert own_text(DEEP[name]).endswith("deep")
    # Quadratic work would take minutes.
    assert time.process_time() - start < 12
    tracemalloc.start()
    own_text(DEEP[name])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
