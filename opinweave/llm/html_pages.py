"""Labelled pages on which the extraction model is trained.

Every page is written for this purpose. ``y`` on an element marks it and what it holds as
content, ``n`` as something else; unmarked elements are structure and count as not content.
"""

_WORDS = (
    "the river runs past old mills and quiet towns where people still mend their boats by hand "
    "and talk about the weather, the harvest and the price of wood before they go home to eat"
).split()


_OTHER = (
    "several engineers measured voltage across copper plates during a long experiment whose results "
    "surprised the committee because earlier models predicted smaller losses at higher temperatures"
).split()


def _prose(start: int, n: int) -> str:
    known = (_WORDS, _OTHER, _WORDS + _OTHER)[start % 3]
    words = [known[(start * 7 + i * 5) % len(known)] for i in range(n)]
    sentences = [" ".join(words[i : i + 11]).capitalize() + "." for i in range(0, n, 11)]
    return " ".join(sentences)


def _links(k: int, label: str) -> str:
    return "".join(f'<li><a href="/{label}{i}">{label} {i}</a></li>' for i in range(k))


def _body(i: int) -> str:
    """Paragraphs of several lengths, some with inline markup, a list, a quote, a table."""
    parts = [f"<p>{_prose(i, 60)}</p>", f"<p>{_prose(i + 1, 12)}</p>", f"<p>{_prose(i + 2, 3)}</p>"]
    parts.append(f'<p>{_prose(i + 3, 25)} <a href="/see">{_prose(i, 2)}</a> <b>{_prose(i + 4, 8)}</b></p>')
    extra = [
        f"<h2>{_prose(i, 4)}</h2><p>{_prose(i + 5, 90)}</p>",
        f"<ul><li>{_prose(i, 9)}</li><li>{_prose(i + 1, 7)}</li></ul><p>{_prose(i + 6, 40)}</p>",
        f"<blockquote><p>{_prose(i + 2, 18)}</p></blockquote><p>{_prose(i, 33)}</p>",
        f"<table><tr><td>{_prose(i, 2)}</td><td>{_prose(i + 1, 3)}</td></tr></table>",
        f"<pre>{_prose(i, 12)}</pre><div>{_prose(i + 2, 21)}</div>",
    ]
    return "".join(parts) + extra[i % len(extra)]


def _linked(i: int, links: int, n: int = 9) -> str:
    """A paragraph with links in its running text."""
    parts = "".join(f' <a href="/ref/{k}">{_prose(i + k, 2 + k % 3)}</a> {_prose(i + 2 * k, n)}' for k in range(links))
    return f"<p>{_prose(i, n)}{parts}</p>"


def _inner(i: int) -> list[str]:
    """What stands inside articles and is no part of them, under names and tags of many kinds."""
    kinds = [
        f'<aside n class="related"><p>{_prose(i, 14)}</p></aside>',
        f"<aside n><p>{_prose(i + 1, 22)}</p></aside>",
        f'<aside n class="pullout"><h4>{_prose(i, 3)}</h4><p>{_prose(i + 2, 30)}</p></aside>',
        f'<div n class="comments"><p>{_prose(i + 3, 19)}</p></div>',
        f'<div n id="comments"><div><p>{_prose(i, 24)}</p></div><div><p>{_prose(i + 1, 9)}</p></div></div>',
        f'<ol n class="commentlist"><li>{_prose(i, 16)}</li><li><p>{_prose(i + 4, 26)}</p></li></ol>',
        f'<div n class="ad-slot"><p>{_prose(i + 4, 17)}</p></div>',
        f'<section n class="advertisement"><div><p>{_prose(i, 33)}</p></div></section>',
        f'<div n class="newsletter-signup"><p>{_prose(i + 5, 20)}</p></div>',
        f'<div n class="subscribe box"><h3>{_prose(i, 4)}</h3><p>{_prose(i + 1, 12)}</p><form><input><button>Ok</button></form></div>',
        f'<nav n class="toc"><ol>{_links(3, "Part")}</ol></nav>',
        f'<div n class="social-share"><ul>{_links(2, "Send")}</ul></div>',
        f'<footer n><p>{_prose(i + 2, 11)}</p></footer>',
        f'<form n action="/poll"><p>{_prose(i, 13)}</p><label>{_prose(i, 3)}</label></form>',
        f'<div n class="related-stories"><h3>{_prose(i, 2)}</h3><ul><li><a href="/x">{_prose(i, 8)}</a></li></ul><p>{_prose(i, 10)}</p></div>',
        f'<div n class="cookie-bar"><p>{_prose(i + 3, 21)}</p></div>',
    ]
    return [kinds[(i * 3 + k * 5) % len(kinds)] for k in range(3)]


def _varied(i: int, head: str, nav: str, foot: str, side: str) -> list[str]:
    """Articles with links, unwanted parts inside, trees of plain divs, text without paragraphs."""
    a, b, c = _inner(i)
    title = f"<h1>{_prose(i, 5)}</h1>"
    return [
        f"<html><body>{head}{nav}<main><article y>{title}{_linked(i, 1)}<p>{_prose(i + 1, 30)}</p></article></main>{foot}</body></html>",
        f"<html><body>{head}<main><article y>{title}{''.join(_linked(i + k, 2, 4) for k in range(4))}</article></main>{side}{foot}</body></html>",
        f"<html><body>{head}<main><article y><p>{_prose(i, 45)}</p>{a}{_linked(i + 2, 3, 5)}{b}<p>{_prose(i + 3, 12)}</p></article></main>{foot}</body></html>",
        f"<html><body>{nav}<article y>{title}<p>{_prose(i, 28)}</p><p>{_prose(i + 5, 51)}</p>{c}</article>{b}{foot}</body></html>",
        f'<html><body><div><div y><p>{_prose(i, 37)}</p><p>{_prose(i + 2, 20)}</p>{_linked(i, 2)}</div>{a}{c}</div></body></html>',
        f'<html><body><div class="wrap"><div y class="text"><div>{_prose(i, 40)}</div><div>{_prose(i + 1, 25)}</div></div><div n class="comments"><div><p>{_prose(i, 18)}</p></div></div></div></body></html>',
        f"<html><body y>{_prose(i, 60)}</body></html>",
        f"<html><body y>{_prose(i, 4 + 2 * i)}</body></html>",
        f"<body y>{_prose(i + 1, 12)}<br>{_prose(i, 8)}</body>",
        f"<html><body y><p>{_prose(i, 18)}</p><p>{_prose(i + 2, 9)}</p></body></html>",
        f"<html><body y>{_prose(i, 12 + i)}<br><br>{_prose(i + 1, 22)}<br>{_prose(i + 2, 9)}</body></html>",
        f"<body y>{_prose(i, 35)} <a href='/z'>{_prose(i, 2)}</a> {_prose(i + 2, 14)}{foot}</body>",
        f"<html><body>{nav}<div y>{_prose(i, 44)}<br>{_prose(i + 4, 18)}</div>{foot}</body></html>",
        f'<html><body><div><div y><p>{_prose(i, 16)}</p><p>{_prose(i + 2, 17)}</p></div><div n class="comments"><div><p>{_prose(i + 1, 9)}</p></div></div></div></body></html>',
        f'<html><body><div><div><div y><p>{_prose(i, 22)}</p><p>{_prose(i + 3, 35)}</p></div></div>{b}</div></body></html>',
        f"<html><body><div y><p>{_prose(i, 50)}</p><p>{_prose(i + 3, 15)}</p></div></body></html>",
        _prose(i + 2, 1 + i % 3),
        f"<html><body y>{_prose(i, 25)}<br>{_prose(i + 1, 30)}{c}</body></html>",
        _prose(i, 30 + i),
        _prose(i + 1, 3 + i % 5),
        f"<p y>{_prose(i, 20)}</p><p y>{_prose(i + 3, 6)}</p>",
        f"{head}<main y><p>{_prose(i, 33)}</p><ul><li>{_prose(i, 5)}</li><li><a href='/k'>{_prose(i + 1, 4)}</a> {_prose(i, 6)}</li></ul></main>{a}{foot}",
        f"<html><body>{head}<main y>{title}{_linked(i, 4, 3)}<section>{_linked(i + 1, 2)}<h2>{_prose(i, 3)}</h2><p>{_prose(i, 19)}</p></section>{b}</main>{side}{foot}</body></html>",
    ]


def labelled_pages() -> list[str]:
    pages = []
    for i in range(12):
        title = f"<h1>{_prose(i, 6)}</h1>"
        nav = f'<nav n><ul>{_links(3 + i % 5, "Topic")}</ul></nav>'
        menu = f'<div n class="menu nav-{i}"><a href="/">Home</a> <a href="/a">About us</a> <a href="/b">Contact</a></div>'
        head = f'<header n><div class="logo">Daily {i}</div><p>{_prose(i, 8)}</p>{nav}</header>'
        foot = f"<footer n><p>&copy; {2000 + i} example.org. {_prose(i + 3, 20)}</p><p>All rights reserved.</p></footer>"
        div_foot = f'<div n id="footer" class="site-footer">&copy; example.net {_prose(i, 14)} <a href="/p">Privacy</a></div>'
        side = f'<aside n class="sidebar"><h3>Related</h3><ul>{_links(4, "Story")}</ul><p>{_prose(i, 12)}</p></aside>'
        div_side = f'<div n class="side sidebar widget"><h4>Most read</h4><p>{_prose(i + 1, 15)}</p></div>'
        advert = f'<div n class="ad">{_prose(i + 2, 9)}</div>'
        sponsor = f'<div n class="advert sponsored" id="ad-{i}"><p>{_prose(i, 24)}</p><a href="/buy">Buy now</a></div>'
        cookie = f'<div n class="cookie-notice notice banner"><p>We use cookies. {_prose(i, 10)}</p><button>Accept</button></div>'
        form = f'<form n action="/s"><label>Search {_prose(i, 5)}</label><input name="q"><button>Go</button></form>'
        signup = f'<form n class="newsletter"><p>Subscribe to our letter. {_prose(i + 1, 12)}</p><input></form>'
        comments = (
            f'<section n class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>{_prose(i, 20)}</p></div>'
            f'<div class="comment"><p>{_prose(i + 1, 30)}</p></div></section>'
        )
        discussion = f'<div n class="user-comments discussion"><ol><li class="reply"><p>{_prose(i, 28)}</p></li></ol></div>'
        inside_share = f'<div n class="share social"><a href="/t">Share</a> <a href="/m">Mail</a></div>'
        body = _body(i)
        pages += [
            f"<html><head><title n>{_prose(i, 5)}</title></head><body>{nav}{advert}<article y>{title}{body}</article>{foot}</body></html>",
            f"<html><body>{head}<main><article y>{title}{body}</article>{comments}</main>{side}{foot}</body></html>",
            f'<html><body>{menu}<div class="page"><div y class="content post-body">{title}{body}</div>{div_side}</div>{discussion}{div_foot}</body></html>',
            f'<html><body>{head}{cookie}<div id="main"><div y class="entry article-text">{title}{body}</div>{sponsor}</div>{form}{foot}</body></html>',
            f"<html><body>{nav}<main y>{title}{body}</main>{signup}{side}{div_foot}</body></html>",
            f"<html><body>{head}<article y>{title}{sponsor}{body}{inside_share}{_body(i + 1)}{comments}</article>{foot}</body></html>",
            f"<html><body>{menu}{cookie}<section y><h1>{_prose(i, 5)}</h1>{body}</section>{discussion}{form}{div_foot}</body></html>",
            f'<html><body y><p>{_prose(i, 30)}</p><p>{_prose(i + 1, 4)}</p><div>{_prose(i + 2, 16)}</div>{foot}</body></html>',
        ]
        pages += _varied(i, head, nav, foot, side)
    return pages
