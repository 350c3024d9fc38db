"""Labelled pages for main-text extraction: a small table of pieces, put together to pages by rule.

In a piece of markup {keep} stands at the start of each block that belongs to the article; {short}, {line},
{long} stand for invented words, {link} for a linked word or two. Articles and furniture are dealt to layouts so that every
kind of furniture stands before, after and inside of every kind of article.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Ways to write an article. {inner} is where furniture may stand inside of it.
ARTICLES = [
    "<article><h1>{keep}{line}</h1><p>{keep}{long}</p>{inner}<p>{keep}{long}</p><p>{keep}{short}</p></article>",
    "<article><header><h1>{keep}{line}</h1><p>{keep}{line}</p></header><p>{keep}{long}</p>{inner}<h2>{keep}{short}</h2><p>{keep}{long}</p></article>",
    "<main><h1>{keep}{line}</h1><p>{keep}{line}</p>{inner}<p>{keep}{long}</p></main>",
    '<div class="content"><h1>{keep}{line}</h1><p>{keep}{long}</p>{inner}<ul><li>{keep}{line}</li><li>{keep}{short}</li></ul><p>{keep}{long}</p></div>',
    '<div id="main-content"><h2>{keep}{line}</h2><div>{keep}{long}</div>{inner}<div>{keep}{line}</div><blockquote>{keep}{line}</blockquote></div>',
    '<div class="post-body entry">{keep}{long}<p>{keep}{long} {link} {line}</p>{inner}<p>{keep}{short}</p></div>',
    '<section role="main"><h1>{keep}{short}</h1><p>{keep}{short}</p><p>{keep}{long}</p>{inner}<figure><figcaption>{keep}{line}</figcaption></figure></section>',
    "<article><p>{keep}{short}</p></article>",
    "<article><h1>{keep}{short}</h1>{inner}<p>{keep}{line} {link}</p></article>",
    "<article><h1>{keep}{line}</h1><p>{keep}{long}</p><ul><li>{keep}{link} {line}</li><li>{keep}{long}</li></ul><p>{keep}{link}</p></article>",
    "<div><h1>{keep}{line}</h1><p>{keep}{long}</p><p>{keep}{short}</p><p>{keep}{long}</p>{inner}<p>{keep}{line}</p></div>",
    "<table><tr><td><h1>{keep}{line}</h1><p>{keep}{long}</p>{inner}<p>{keep}{long}</p><p>{keep}{short}</p><p>{keep}{long}</p></td></tr></table>",
    "<h1>{keep}{line}</h1><p>{keep}{long}</p>{inner}<p>{keep}{line} {link} {line}</p><p>{keep}{long}</p>",
    "<div><div>{keep}{long}</div><div>{keep}{short}</div><div>{keep}{long}</div>{inner}<div>{keep}{long}</div></div>",
    "<h1>{keep}{short}</h1><p>{keep}{long}</p>",
    "<div><p>{keep}{long}</p><p>{keep}{long}</p></div>",
    "",
]
#: Furniture that says what it is.
NAMED = [
    "<nav><ul><li>{link}</li><li>{link}</li><li>{link}</li></ul></nav>",
    '<div class="menu"><a href="/">{short}</a> {link} {link}</div>',
    '<ul id="main-nav"><li>{link}</li><li>{short}</li></ul>',
    '<div role="navigation"><p>{line}</p>{link}</div>',
    "<header><h1>{short}</h1><p>{line}</p></header>",
    '<div class="site-header"><a href="/">{short}</a><p>{long}</p></div>',
    "<footer>&copy; {short} {line}</footer>",
    "<footer><p>{long}</p><p>{link} {link}</p></footer>",
    '<div id="footer"><p>{line}</p><p>{long}</p></div>',
    "<aside><h3>{short}</h3><p>{long}</p><ul><li>{link}</li></ul></aside>",
    '<div class="sidebar"><h3>{line}</h3><p>{long}</p><p>{long}</p></div>',
    '<div class="related-posts"><h2>{short}</h2><ul><li>{link}</li><li>{link}</li></ul></div>',
    '<div class="ad">{line}</div>',
    '<section class="sponsored"><p>{long}</p></section>',
    '<div id="ad-banner"><p>{short}</p><p>{line}</p></div>',
    '<p class="promo">{long}</p>',
    '<div class="cookie-notice"><p>{long}</p><button>{short}</button></div>',
    '<div role="alert">{line}</div>',
    '<div class="modal" hidden><p>{long}</p></div>',
    "<form><label>{short}</label><p>{line}</p><input name=q><button>{short}</button></form>",
    '<div class="newsletter-signup"><h3>{line}</h3><p>{long}</p></div>',
]
#: Readers' comments.
COMMENTS = [
    '<section id="comments"><h2>{short}</h2><article><p>{long}</p></article><article><p>{line}</p></article></section>',
    '<div class="comments"><p>{long}</p><p>{long}</p><p>{short}</p></div>',
    '<ol class="comment-list"><li class="comment"><b>{short}</b><p>{long}</p></li><li class="comment"><p>{line}</p></li></ol>',
    '<div id="disqus"><p>{long}</p><p>{long}</p><p>{short}</p><p>{long}</p><p>{long}</p><p>{long}</p></div>',
    '<div class="comment-thread"><div><h4>{short}</h4><div>{long}</div></div></div>',
]
#: Furniture that only its words, links and neighbours give away.
PLAIN = [
    "<div>{link} {link} {link}</div>",
    "<ul><li>{link}</li><li>{link}</li><li>{link}</li><li>{link}</li></ul>",
    "<p>{link}</p>",
    "<div>{short}</div>",
    "<table><tr><td>{link}</td><td>{link}</td><td>{short}</td></tr></table>",
    "<p>{short} {link} {link}</p>",
    "<center>{short}</center>",
]
#: Pages that the pieces are put together to.
PAGES, SEED = 640, 11


def pages() -> Iterator[str]:
    """PAGES labelled pages, the same ones each time."""
    rng = random.Random(SEED)

    def words(least: int, most: int) -> str:
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(least, most)))

    def filled(piece: str) -> str:
        out = []
        for k, part in enumerate(piece.split("{")):
            name, _, rest = part.partition("}") if k else ("", "", part)
            if name == "keep":
                out.append("{keep}")
            elif name == "link":
                out.append(f'<a href="/{k}">{words(1, 4)}</a>')
            elif name:
                out.append(words(*{"short": (1, 5), "line": (6, 14), "long": (20, 90)}[name]))
            out.append(rest)
        return "".join(out)

    for k in range(PAGES):
        article = ARTICLES[k % len(ARTICLES)]
        named = 'class="' in article or any(t in article for t in ("<article", "<main", 'id="', "role="))
        inner = rng.choice(NAMED[9:]) if rng.random() < 0.3 else ""
        before = rng.sample(NAMED, rng.randint(0, 3)) + (rng.sample(PLAIN, rng.randint(0, 2)) if named or rng.random() < 0.5 else [])
        after = rng.sample(NAMED, rng.randint(0, 3)) + (rng.sample(PLAIN, rng.randint(0, 2)) if named or rng.random() < 0.5 else [])
        if rng.random() < 0.5:
            after.insert(rng.randint(0, len(after)), rng.choice(COMMENTS))
        rng.shuffle(before)
        yield "<html><body>" + "".join(filled(p) for p in [*before, article.replace("{inner}", inner), *after]) + "</body></html>"
