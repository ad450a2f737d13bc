"""A small labelled table for the block classifier: invented pages whose main text is marked.

Fixed values, written for this library. In each page, blocks that start with ``+`` belong to the main
text, all others do not; the mark is not part of the block.
"""

from __future__ import annotations

LONG = (
    "The council met on Tuesday to discuss the new bridge over the river, which has been closed since the storm of last winter.",
    "Engineers told the meeting that the second pillar had moved by four centimetres, and that repairs would take until the end of the year at least.",
    "Residents of the eastern bank now drive eleven kilometres to reach the school, and several of them asked for a ferry in the meantime.",
    "In the first part of this guide we looked at soil and light, and in this part we turn to water, which most beginners use too much of.",
    "A pot that feels heavy needs no water. A pot that feels light does, and the difference is easy to learn within a week or two.",
    "She wrote the first of the letters in the autumn of that year, and the last of them only days before the ship left the harbour.",
)
SHORT = ("What now?", "No.", "Updated at noon.", "He agreed.", "It rained.")
TITLE = ("Bridge stays closed", "How to water plants", "Letters from the harbour", "A short note")
OFFER = "Buy three pairs of warm winter socks today and get a fourth pair for free, delivered to your door within two working days."
TERMS = "We and our partners store information on your device to show you pages that you may like; read how in our policy before you agree."
REPLY = "I was there on Tuesday and this is not at all what the engineers said, the pillar has been moving for years and everyone knows it."
FOOT = "Copyright of the Harbour Gazette, all rights reserved, printed and published at the old mill by the river since the year 1901."


def _menu(n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(n)) + "</ul>"


def _text(start: int, n: int, mark: str = "+") -> str:
    return "".join(f"<p>{mark}{LONG[(start + i) % len(LONG)]}</p><p>{mark}{SHORT[(start + i) % len(SHORT)]}</p>" for i in range(n))


PAGES = (
    f"<body><nav>{_menu(4)}</nav><div class='ad'>{OFFER}</div><article><h1>+{TITLE[0]}</h1>{_text(0, 3)}</article><footer>{FOOT}</footer></body>",
    f"<body><header><h2>Harbour Gazette</h2>{_menu(5)}</header><main><h1>+{TITLE[1]}</h1>{_text(3, 2)}<p>+<a href='/x'>Part one of this guide</a></p></main>"
    f"<aside><p>{LONG[5]}</p>{_menu(3)}</aside><div class='comments'><p>{REPLY}</p><p>Well said.</p></div><footer><p>{FOOT}</p></footer></body>",
    f"<body><div class='cookie-notice'><p>{TERMS}</p></div><article><h1>+{TITLE[2]}</h1>{_text(5, 2)}<div class='related'>{_menu(3)}</div>"
    f"<form><p>Your name</p><p>{TERMS}</p></form>{_text(1, 1)}<div class='advert'><p>{OFFER}</p></div><p>+{SHORT[1]}</p></article>"
    f"<section class='comments'><div><p>{REPLY}</p></div></section></body>",
    f"<body><p>{OFFER}</p><p>Share</p><article><h1>+{TITLE[3]}</h1><p>+{SHORT[0]}</p><ul><li>+{SHORT[2]}</li><li>+{SHORT[3]}</li></ul>"
    f"<blockquote>+{LONG[5]}</blockquote></article><p>{FOOT}</p><p>{SHORT[4]}</p></body>",
    f"<body><div><a href='/'>Home</a> <a href='/n'>News</a></div><div><h1>+{TITLE[0]}</h1>{_text(2, 3)}</div><div><a href='/a'>About us</a> <a href='/c'>Contact</a></div></body>",
    f"<body><div class='menu'>{_menu(6)}</div><div><p>+{LONG[1]}</p><p>+{LONG[2]}</p><p>+{SHORT[0]}</p><p>+{LONG[3]}</p></div><div class='footer'>{FOOT}</div></body>",
    f"<body>{_menu(5)}<p>+{LONG[4]}</p><p>+{LONG[5]}</p>{_menu(7)}<div class='sidebar'><p>{OFFER}</p><p>{LONG[0]}</p></div></body>",
    f"<body><main><p>+{LONG[0]}</p><p>+{SHORT[3]}</p><p>+{SHORT[1]}</p></main><div><p>{TERMS}</p><p>{OFFER}</p></div></body>",
    f"<body><article><ul><li>+<a href='/q'>{LONG[2]}</a></li><li>+<a href='/r'>Second source</a></li></ul><p>+{LONG[3]}</p></article><div><p>{REPLY}</p></div></body>",
    f"<body><nav>{_menu(3)}</nav><article class='post category-privacy tag-cookies'><h1>+{TITLE[0]}</h1>{_text(4, 2)}</article>"
    f"<article class='teaser'><p>{LONG[0]}</p></article><div><p>{TERMS}</p></div></body>",
    f"<body><main class='with-sidebar'><h1>+{TITLE[1]}</h1>{_text(2, 2)}<div class='sidebar'><p>{OFFER}</p></div></main><footer><p>{FOOT}</p></footer></body>",
    f"<body><div id='story' class='no-comments'><h1>+{TITLE[2]}</h1>{_text(1, 2)}<div class='story-footer'><p>{OFFER}</p></div></div>"
    f"<section class='article-comments'><p>{REPLY}</p></section></body>",
)

LETTER = "Subscribe to our weekly letter and never miss a story from the harbour."
THANKS = "Thank you for reading the Gazette."


def _links(n: int, words: str = "More about topic") -> str:
    return "".join(f'<div><a href="/{i}">{words} {i}</a></div>' for i in range(n))


def _see(i: int) -> str:
    return f"<p>+See <a href='/s{i}'>this other page about it</a></p>"


# Pages without an article element and without names that tell: only words, links and neighbours tell their blocks apart.
BARE = (
    f"<body>{_links(4)}<div><h1>+{TITLE[0]}</h1><p>+{LONG[0]}</p>{_see(1)}<p>+{LONG[1]}</p><p>+{SHORT[1]}</p><p>+{LONG[2]}</p></div><p>{LETTER}</p>{_links(3)}</body>",
    f"<body>{_links(6, 'Go to')}<h2>+{TITLE[1]}</h2><p>+{LONG[3]}</p><p>+{LONG[4]}</p>{_see(2)}<p>+{LONG[5]}</p><p>{THANKS}</p>{_links(2)}<p>{LETTER}</p>{_links(2, 'On')}</body>",
    f"<body><p>{LETTER}</p>{_links(3)}<div><p>+{LONG[5]}</p><p>+{SHORT[3]}</p><p>+{LONG[0]}</p>{_see(3)}<p>+{LONG[3]}</p></div>{_links(5)}<p>{THANKS}</p></body>",
    f"<body>{_links(2)}<p>{THANKS}</p>{_links(2)}<div><h1>+{TITLE[2]}</h1><p>+{LONG[1]}</p><p>+{LONG[2]}</p></div>{_links(4, 'Next:')}</body>",
    f"<body><div><h1>+{TITLE[3]}</h1><p>+{LONG[2]}</p>{_see(4)}<p>+{LONG[4]}</p><p>+{SHORT[0]}</p><p>+{LONG[1]}</p></div><p>{LETTER}</p>{_links(3, 'To')}<p>{THANKS}</p>{_links(1)}</body>",
    f"<body>{_links(3, 'All of')}<p>+{LONG[4]}</p><p>+{LONG[0]}</p>{_links(2)}<p>{LETTER}</p></body>",
)
# Articles whose blocks look like those of menus and notices elsewhere, and plain pages that just end.
ENDS = (
    f"<body><nav>{_menu(3)}</nav><article><h1>+{TITLE[0]}</h1><p>+{LONG[0]}</p><p>+{SHORT[1]}</p></article></body>",
    f"<body>{_links(3)}<article><p>+{LONG[1]}</p><p>+{SHORT[4]}</p></article>{_links(4)}</body>",
    f"<body><article><p>+<a href='/1'>{TITLE[1]}</a></p><p>+Our weekly letter comes out every Friday now.</p><p>+<a href='/2'>{TITLE[2]}</a></p></article>{_links(2)}</body>",
    f"<body><p>{LETTER}</p>{_links(2)}<main><p>+{SHORT[2]}</p></main></body>",
    f"<body>{_links(3)}<article><h2>+{TITLE[3]}</h2><p>+He went back to the harbour once more before winter came.</p></article></body>",
    f"<body><article><p>+{SHORT[0]}</p><p>+He went back to the harbour.</p></article><p>{LETTER}</p>{_links(2)}</body>",
    f"<body><article><p>+{LONG[0]}</p>{_see(5)}<p>+He went back to the harbour.</p></article></body>",
    f"<body><main><p>+{LONG[2]}</p><p>+<a href='/3'>{TITLE[2]}</a></p><p>+{LONG[4]}</p></main></body>",
    f"<body><p>+{LONG[0]}</p><p>+{SHORT[1]}</p></body>",
    f"<body><p>+{SHORT[2]}</p></body>",
    f"<body>+{LONG[2]}</body>",
    f"<body><h1>+{TITLE[0]}</h1><p>+{LONG[3]}</p><p>+He went back to the harbour once more before winter came.</p></body>",
    f"<body>{_links(2)}<h1>+{TITLE[1]}</h1><p>+{LONG[5]}</p><p>+{LONG[1]}</p></body>",
)
PAGES = PAGES + BARE + ENDS
