"""What names of classes and ids hide, and what they do not."""

import pytest

LONG = "A long paragraph of the article, with words and more words. " * 3
ARTICLE = f"<article><h1>T</h1><p>{LONG}</p></article>"


@pytest.mark.parametrize("names", ['class="site-content has-sidebar"', 'id="page" class="no-sidebar"', 'class="entry share-enabled"', 'class="has-header"', 'class="comments-open nav-open"', 'class="menu-closed"', 'class="td-footer-wrapper"', 'class="search-page"', 'class="content-sidebar"', 'id="modal"'])
def test_names_around_the_article_hide_nothing(names):
    from sightline.llm.html_text import main_text

    want = f"T\n{LONG.strip()}"
    assert main_text(f"<body><div class=menu>M</div><div {names}><div {names}>{ARTICLE}</div></div></body>") == want
    assert main_text(f"<body {names}>{ARTICLE}</body>") == want


@pytest.mark.parametrize("names", ['id="review"', 'class="related-work"', 'class="review-body"', 'class="section-header"', 'class="no-comments"', 'class="show-ads"'])
def test_names_that_say_something_else_keep_text(names):
    from sightline.llm.html_text import main_text

    assert main_text(f"<article><p>{LONG}</p><section {names}><p>Inside.</p></section></article>") == f"{LONG.strip()}\nInside."


@pytest.mark.parametrize("names", ["comments", "x comment-list", "post-comments", "cookie-banner", "site-footer", "site-header", "sidebar", "share-buttons", "related-posts", "ad", "ad-slot-2", "breadcrumbs", "wp-block-comments"])
def test_names_of_what_is_no_article_hide_it(names):
    from sightline.llm.html_text import main_text

    assert main_text(f'<article><p>{LONG}</p><div class="{names}"><p>Inside.</p></div></article>') == LONG.strip()


def test_captions_stay_and_readers_comments_go():
    from sightline.llm.html_text import main_text

    assert main_text(f"<article><p>{LONG}</p><figure><img><figcaption>Caption</figcaption></figure></article>") == f"{LONG.strip()}\nCaption"
    comment = f'<article class="comment"><p>{LONG}</p></article>'
    assert main_text(f'<div class="wrap">{ARTICLE}</div><div id="comments">{comment}{comment}</div>') == f"T\n{LONG.strip()}"


def test_names_are_read_in_time_proportional_to_them():
    import time

    from sightline.llm.html_text import main_text

    began = time.time()
    main_text(f'<div class="{"ad-" * 40_000}">{"a-" * 1000}</div><article class="{"x-" * 20_000}ad-">{LONG}</article>')
    assert time.time() - began < 5
