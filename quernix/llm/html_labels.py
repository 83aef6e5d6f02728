"""The labelled table of the block classifier: small pages whose blocks begin with + (main text) or - (not)."""

#: Running text of the page's length (@), of a third of it (%) and a few words (~) stand in the templates.
LENGTHS = (4, 9, 14, 22, 45, 120)
#: Boilerplate with telling containers or names around and inside an article.
NAMED = [
    "<nav><ul><li><a href=x>- home</a></li><li><a href=x>- the news</a></li></ul></nav><div class=ad>- buy @</div><article><h1>+ a title of six words here</h1><p>+ @</p><p>+ short one</p><p>+ @ @</p></article><footer>- site @</footer>",
    "<header>- site name</header><main><h1>+ heading</h1><p>+ @</p><ul><li>+ an item of the list</li><li>+ x</li></ul><p>+ <a href=x>linked all through</a></p></main><aside>- about us @</aside><footer><p>- terms @</p></footer>",
    "<div class=cookie-notice><p>- we use cookies @</p><a href=x>- accept</a></div><article><p>+ @</p><p>+ one</p><h2>+ part two</h2><p>+ @ @</p><div class=advert>- sponsored @</div><p>+ end</p></article><section class=comments><h3>- comments</h3><p>- I think @</p><p>- ~</p></section>",
    "<article><header><h1>+ title</h1></header><p>+ @</p><aside>- related @</aside><form>- subscribe @<button>- send</button></form><section id=comments>- first @</section><nav>- <a href=x>next</a></nav><footer>- written by @</footer><div class=notice>- sign in @</div></article>",
    "<main><table><tr><td>+ cell</td><td>+ @</td></tr></table><blockquote>+ @</blockquote><pre>+ code</pre><div class=comment-list><div>- reply @</div><p>- @</p></div></main><p>- legal @</p>",
    "<div class=post><h1>+ t</h1><p>+ @</p><p>+ ok</p><div>+ @</div></div><div class=share>- share this</div><div class=related><p>- @</p></div><div role=dialog class=modal><p>- @</p></div>",
    "<div id=menu><a href=x>- one</a></div><div class=content><p>+ @</p><p>+ two words</p></div><div class=sidebar><p>- popular @</p></div><div id=footer>- copyright @</div>",
    "<div class=sidebar><p>- @ @</p><h3>- ~</h3></div><p>+ @ @ of some more running words of the text itself</p><p>+ @ @ of some more running words of the text itself</p><div class=ad><p>- @ @</p></div><form><p>- @ @</p></form><div class=comments><p>- @ @</p><p>- @</p></div><footer><p>- @ @</p></footer>",
]
#: An article without any name beside it: what stands outside is not main text, whatever its length.
BARE = [
    "<div><a href=x>- home</a></div><div>- ~</div><p>- @</p><article><h1>+ ~</h1><p>+ @</p><p>+ <a href=x>a source</a></p><ul><li>+ <a href=x>one source</a></li></ul><div>- <a href=x>share</a> <a href=x>this page</a></div><div>+ @</div><p>+ x</p></article><div>- stray @</div><p>- outside @ @</p>",
    "<p>- @ @</p><main><p>+ a</p><p>+ b c</p><p>+ @ with <a href=x>one link</a></p><div>+ ~</div><div>- <a href=x>%</a></div></main><h3>- ~</h3><p>- @</p>",
]
#: Articles written in plain blocks, with every kind of named boilerplate (?) inside.
INSIDE = [
    "<article><div>+ @</div><div>+ @ @</div><div class=?>- @</div><div>+ ~</div><section>+ @</section><div class=?><p>- ~</p></div><div>+ one</div><div>+ @</div></article><div>- ~</div>",
    "<div>- ~</div><main><h2>+ ~</h2><div>+ ~</div><p>+ @</p><p class=?>- @</p><div>+ @ has <a href=x>a link</a></div><div>+ @</div><div class=?><h3>- ~</h3><ul><li>- @</li></ul></div><ul><li>+ ~</li><li>+ @</li></ul><div class=?>- ~</div><p>+ ~</p></main>",
    "<article><p>+ @ <a href=x>link</a></p><div>+ @</div><h2>+ ~</h2><div>+ ~</div><div>- <a href=x>share</a> <a href=x>this</a></div><div>+ @</div><p>+ <a href=x>%</a></p><section>+ @</section></article>",
]
BOILERPLATE = ("menu", "footer", "sidebar", "notice", "ad", "form", "comment")
#: No article and no names: counts and link density of a block and of its neighbours decide.
PLAIN = [
    "<div><a href=x>- home</a></div><div><a href=x>- about us</a></div><h1>+ a title of some words</h1><p>+ @ and then some more of it to fill a line of ten</p><p>+ @ and so on to the end of the line with words</p><p>+ ~</p><p>+ @ and so on to the end of the line with words</p><div>- <a href=x>next page</a></div><div>- ~</div>",
    "<ul><li><a href=x>- ~</a></li><li><a href=x>- % %</a></li><li><a href=x>- one</a></li></ul><p>+ @ which has a <a href=x>link</a> in it and words around that link too</p><p>+ ~</p><p>+ @ and a second line of words that ends the text of this page</p><ul><li><a href=x>- %</a></li><li><a href=x>- two</a></li></ul><div>- ~</div>",
    "<div>- ~</div><div>- <a href=x>top stories of the day for you and all</a></div><p>+ @ is the first of the lines of text and it goes on for a while</p><h2>+ ~</h2><p>+ @ is the next of the lines of text and it goes on for a while</p><ul><li>+ ~</li><li>+ @ in a list of the text</li></ul><p>+ @ is the last of the lines of text and it goes on for a while</p><div>- <a href=x>more</a> <a href=x>and more of it</a></div><div>- ~</div>",
    "<h1>+ title here</h1><p>+ @ with enough words about it to be the text of a page</p><p>+ @ with enough words about it to be the text of a page</p>",
    "<table><tr><td><a href=x>- ~</a></td><td>- ~ <a href=x>% ~</a></td></tr></table><h3>- <a href=x>% %</a></h3><div>+ @ with enough words about it to be the text of a page</div><div>+ @ with enough words about it to be the text of a page</div><h3>- <a href=x>%</a></h3><h3>- <a href=x>% ~</a></h3>",
    "<div>- ~</div><div>- one</div><h1>+ ~</h1><p>+ ~</p><p>+ @ with enough words about it to be the text of a page</p><p>+ ~</p><p>+ % %</p><p>+ @ with enough words about it to be the text of a page</p><div>- ~</div><div>- ~ ~</div>",
    "<h2>+ ~</h2><p>+ @ with enough words about it to be the text of a page</p><h2>+ ~</h2><p>+ @ with enough words about it to be the text of a page</p><ul><li>+ ~</li><li>+ %</li><li>+ ~</li></ul><p>+ @ with enough words about it to be the text of a page</p><div>- ~</div><div><a href=x>- ~</a></div><div>- one</div>",
    "<p><a href=x>- home</a> <a href=x>%</a> <a href=x>~</a></p><h1>+ ~</h1><h2>+ ~ ~</h2><div>+ @ with enough words about it and <a href=x>a link</a> to be the text of a page</div><div>+ @ with enough words about it to be the text of a page</div><div>- <a href=x>one</a> and <a href=x>two of them</a></div><div>- ~ one</div>",
    "<div>- <a href=x>% one</a></div><div>+ @ with enough words about it to be the text of a page</div><div>- ~</div><ul><li>- <a href=x>one</a></li></ul><div>- ~ ~</div>",
    "<p>+ @ with enough words about it to be the text of a page</p>",
    "<h1>+ one</h1><p>+ @ with enough words about it to be the text of a page</p><h3>+ one</h3><p>+ @ with enough words about it to be the text of a page</p><h3>+ one</h3><p>+ one</p><p>+ @ with enough words about it to be the text of a page</p>",
    "<p>+ one short text alone</p>",
    "+ one short text",
    "<div>+ ~</div>",
    "<body>+ @ with <b>words</b></body>",
    "<h1>+ ~</h1><p>+ ~</p><p>+ @ with enough words about it to be the text of a page</p><p>+ ~</p>",
    "<p>+ ~</p>",
]


def pages() -> list[str]:
    """Every template with running text of every length."""
    templates = NAMED + BARE + PLAIN + [t.replace("?", k) for t in INSIDE for k in BOILERPLATE]
    return [t.replace("@", "word " * n).replace("%", "word " * max(1, n // 3)).replace("~", "two words" if n % 2 else "four words of text") for n in LENGTHS for t in templates]
