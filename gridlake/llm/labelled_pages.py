"""Pages labelled by hand: blocks that begin with MAIN are main text."""

from __future__ import annotations

MAIN = "*"

_LONG = "the committee met again on tuesday to discuss the plan for the old harbour and after two hours of talk it came to no result that all of its members could accept"
_MORE = "several of those who live close by said that they had asked for nothing more than a quiet road and a place where children may play without fear"
_LAST = "work is to begin next spring if the money is found in time"

PAGES = (
    # a news page with marks
    f"""<html><body><header><a href=/>The Paper</a></header><nav><ul><li><a href=/a>World</a><li><a href=/b>Sport</a></ul></nav>
    <main><h1>*No plan for the harbour</h1><p class=byline>*By a reporter</p><p>*{_LONG}</p><p>*{_MORE}</p><ul><li>*first point<li>*second point</ul><p>*{_LAST}</p></main>
    <aside><h2>Most read</h2><ol><li><a href=/1>{_LAST}</a></ol></aside><footer>All rights reserved <a href=/c>Contact</a></footer></body></html>""",
    # an old page of tables without marks
    f"""<body><table><tr><td><a href=/>Home</a><td><a href=/n>News</a><td><a href=/l>Links</a></tr></table><table><tr><td>*{_LONG}</td></tr><tr><td>*{_MORE}</td></tr>
    <tr><td>*In short</td></tr><tr><td>*{_LONG} {_MORE}</td></tr></table><table><tr><td><a href=/m>Mail</a></td><td><a href=/s>Site map</a></td></tr></table></body>""",
    # a blog post with comments that are articles, and teasers of other posts
    f"""<body class="single comments-open"><div id=page><div class=masthead><a href=/>My blog</a></div><article class="post hentry"><h1>*A walk</h1><p>*{_MORE}</p><p>*{_LAST}</p></article>
    <section class=comments><h3>Two comments</h3><article class=comment-body><p>{_LONG}</p></article><article><p>{_MORE}</p></article></section>
    <div class=related><article><h4><a href=/x>Another walk</a></h4><p>{_LONG}</p></article></div></div></body>""",
    # a page in divisions with hints
    f"""<body><div class="top navbar"><a href=/>Home</a> <a href=/a>About</a></div><div class="layout with-sidebar"><div class=content><h2>*Opening hours</h2><p>*{_LAST}</p>
    <p>*{_LONG} {_MORE}</p><p><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></p></div><div class=sidebar><p>{_LONG}</p></div></div><div class=cookie-notice>{_LAST}</div></body>""",
    # short pages without marks
    "<html><body><p>*Closed until further notice.</p></body></html>",
    "<body><h1>*Hello</h1><p>*This is my first page.</p><a href=/next>Next page</a></body>",
    f"<body><div><a href=/>Start</a></div><p>*{_LAST}</p><div><a href=/a>Old pages</a> <a href=/b>New pages</a></div></body>",
    "<pre>*just a line of text</pre>",
    # a forum page whose only text is below a hint that holds it all
    f"""<body><form id=page><div><a href=/>Board</a></div><div class=discussion><p>*{_LONG}</p><p>*{_MORE}</p><p>*{_LONG} {_MORE}</p></div></form></body>""",
    # a page of links only
    f"""<body><ul><li><a href=/1>{_LAST}</a><li><a href=/2>One more</a><li><a href=/3>And one</a></ul><div><a href=/t>Top</a></div></body>""",
    # a document with words that name hidden things, and some that are hidden
    f"""<body><nav><a href=/>Home</a></nav><article title="a hidden gem" data-id=menu><h1>*The hidden garden</h1><p data-note="not hidden ">*{_LONG}</p><p hidden>{_MORE}</p>
    <p style="color:red;display: none">{_MORE}</p><p>*{_LAST}</p></article></body>""",
    # an encyclopaedia page: long paragraphs with links, a contents list, notes
    f"""<body><div id=header><a href=/>Main page</a></div><div id=content><h1>*Harbour</h1><p>*{_LONG} <a href=/q>quay</a> {_MORE}</p><div class=toc><ul><li><a href=#a>History</a><li>
    <a href=#b>Trade</a></ul></div><h2>*History</h2><p>*{_MORE} <a href=/r>road</a> {_LONG}</p></div><div id=footer>{_LAST}</div></body>""",
)
