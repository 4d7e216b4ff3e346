"""Pages labelled by hand, from which the extraction model learns.

``data-y`` marks an element and all below it: 1 is article text, 0 is not. Nothing
marked with 1 may stand below a 0. The texts are fillers; structure, element names
and class names carry the lesson.
"""

LONG = "The survey followed the river for nine days and noted every change of its banks, its depth and the birds that nest there."
LONG2 = "Most of what was found agrees with older maps; where it does not, the new course is drawn with a broken line."
SHORT = "A short remark closes the day."

#: Whole pages; {L}, {M} and {S} stand for long and short sentences.
PAGES = [
    '<html><head><title>T</title></head><body><nav data-y=0><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></nav><div class="ad" data-y=0>{S}</div><article data-y=1><h1>River survey</h1><p>{L}<p>{M}</p><p>{S}</p></article><footer data-y=0>&copy; example.com &middot; {S}</footer></body></html>',
    '<body><header data-y=0><a href="/">Logo</a><p>Your daily paper</p></header><div id="content"><div class="post" data-y=1><h2>River</h2><p>{L}</p><p>{M}</p><ul><li>{S}</li><li>Nine days</li></ul></div><div class="comments" data-y=0><h3>3 comments</h3><p>{S}</p><p>{L}</p></div></div><aside data-y=0><h4>Related</h4><p><a href="/x">{S}</a></p></aside><footer data-y=0><p>All rights reserved.</p></footer></body>',
    '<body><div class="header" data-y=0><ul class="menu"><li><a href=1>Start</a><li><a href=2>Contact</a></ul></div><div class="cookie-notice" data-y=0><p>We use cookies to improve this site. {S}</p><button>Accept</button></div><main data-y=1><h1>Notes</h1><p>{L}</p><blockquote>{M}</blockquote><p>{S}</p></main><div class="sidebar" data-y=0><h3>Popular</h3><ul><li><a href=3>{S}</a></li></ul><p>{M}</p></div><div class="footer" data-y=0><p>Imprint</p></div></body>',
    '<body><div id="nav" data-y=0><a href=1>News</a> <a href=2>Shop</a></div><div id="main"><h1 data-y=1>Banks</h1><p data-y=1>{L}</p><div class="advertisement" data-y=0><p>Buy now. {S}</p></div><p data-y=1>{M}</p><p data-y=1>{L}</p></div><div id="respond" data-y=0><form><label>Name</label><input><textarea></textarea><p>{S}</p></form></div></body>',
    '<body><div class="topbar" data-y=0>Sign in</div><article data-y=1><header><h1>Depth</h1></header><section><h2>First day</h2><p>{L}</p></section><section><h2>Second day</h2><p>{M}</p><table><tr><td>Depth</td><td>Nine metres</td></tr></table></section></article><section class="comments" id="comments" data-y=0><article class="comment"><p>{L}</p></article><article class="comment"><p>{S}</p></article></section></body>',
    '<body><article><h1 data-y=1>Birds</h1><p data-y=1>{L}</p><div class="share" data-y=0><a href=1>Share</a> <a href=2>Mail</a></div><p data-y=1>{M}</p><aside class="promo" data-y=0><p>{S}</p></aside><p data-y=1>{S}</p><div class="newsletter" data-y=0><form><p>Subscribe to our letter. {S}</p></form></div><section class="comments" data-y=0><p>{M}</p></section><footer data-y=0><p>Filed under birds</p></footer></article></body>',
    '<body><div role="navigation" data-y=0><a href=1>A</a><a href=2>B</a></div><div role="main" data-y=1><h1>Course</h1><pre>{S}</pre><p>{L}</p><ol><li>{M}</li><li>{L}</li></ol></div><div role="complementary" data-y=0><p>{L}</p></div><div role="contentinfo" data-y=0><p>&copy; 2020</p></div></body>',
    '<body><form class="search" data-y=0><p>Search the site</p></form><div class="breadcrumb" data-y=0><a href=1>Home</a> / <a href=2>Rivers</a></div><div class="entry-content" data-y=1><p>{L}</p><p>{M}</p><h3>After</h3><p>{S}</p><figure><figcaption>{S}</figcaption></figure></div><div class="related-posts" data-y=0><ul><li><a href=1>{S}</a></li><li><a href=2>{S}</a></li></ul></div><div class="alert" data-y=0>{M}</div></body>',
    '<body><div><div><p data-y=1>{L}</p><p data-y=1>{M}</p><p data-y=1>{L}</p></div><div data-y=0><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div></div><div class="banner" data-y=0><p>{S}</p></div><div class="legal" data-y=0><p>All rights reserved. {S}</p></div></body>',
    '<body><table><tr><td data-y=0><ul><li><a href=1>Left</a></li><li><a href=2>Menu</a></li></ul></td><td data-y=1><h1>Old page</h1><p>{L}</p><p>{M}</p></td></tr></table><p data-y=0><a href=9>Back</a> | <a href=8>Top</a></p></body>',
    '<body><div class="modal popup" data-y=0><p>{M}</p></div><div class="article-body" data-y=1><p>{M}</p><p>{S}</p><dl><dt>Bank</dt><dd>{L}</dd></dl></div><div class="sponsored" data-y=0><h3>Offer</h3><p>{L}</p></div><ul class="comment-list" data-y=0><li><p>{L}</p></li><li>{S}</li></ul><div class="disclaimer notice" data-y=0>{L}</div></body>',
    '<body><nav data-y=0><ul><li><a href="/x">{S}</a></li><li><a href="/y">Last</a></li></ul></nav><div class="ad" data-y=0>{L}</div><article data-y=1><h1>Second survey</h1><p><b>{M}<br><p>{L}</p></article><footer data-y=0>&copy; blog.example &middot; {L}\n{S}</footer></body>',
]


def labelled_pages() -> list[str]:
    """The labelled pages as HTML."""
    return [p.replace("{L}", LONG).replace("{M}", LONG2).replace("{S}", SHORT) for p in PAGES]
