"""HTML to Markdown."""

import pytest

from lodestone.sources.html import to_markdown


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # links, with what they go to
        ('<p>see <a href="/x">the  page</a>, or<a href="u v(1)"> that </a>now; <a>no</a> <a href="/e"></a></p>', "see [the page](/x), or [that](<u v(1)>) now; no"),
        ('<a href="/1">one<a href="/2">two</a> [<a href="/3">a]</a>', "[one](/1)[two](/2) [[a\\]](/3)"),
        ('<h1><a href="/h">T<br>U</a></h1><a href="/b"><h3>W</h3>tail</a>', "# [T U](/h)\n\n### [W](/b)\n\n[tail](/b)"),
        # code within lines and in blocks
        ("<p>use <code>a b</code> and <kbd>x`y</kbd> or <tt>`</tt></p>", "use `a b` and ``x`y`` or `` ` ``"),
        ('<code>f<a href="/g">g</a>()</code><p><code>x</p><p>y</code></p>', "`f`[`g`](/g)`()`\n\n`x`\n\n`y`"),
        ('<a href="/p"><pre><code>l1\n  l2 <a href="q">k</a></code></pre></a><pre>```<br>x<div>y</div></pre>', "```\nl1\n  l2 k\n```\n\n````\n```\nx\ny\n````"),
        # lists: numbers, depth, several blocks of an item, items that nothing ends
        ('<ul><li>a<li>b<ol start=3><li>c<li><p>d</p><p>e</p></ol></li><li>f</ul><p>z</p>', "- a\n\n- b\n\n  3. c\n\n  4. d\n\n     e\n\n- f\n\nz"),
        ("<ol><li value=7>a</li><li><pre>b\nc</pre></li></ol><li>lone</li>x", "7. a\n\n8. ```\n   b\n   c\n   ```\n\n- lone\n\nx"),
        # tables: cells, rows and tables that nothing ends, blocks in cells, captions, spans
        ('<table><caption>cap</caption><tr><th>h<th>i<tr><td><p>1</p><p>2</p><td><a href="/t">x|y</table>after', "cap\n\n| h | i |\n| --- | --- |\n| 1 2 | [x\\|y](/t) |\n\nafter"),
        ("<table><tr><td colspan=2>w<td rowspan=2>r<tr><td>1<td>2<tr><td>3<table><tr><td>in</table><td colspan=900>4", "| w |  | r |\n| --- | --- | --- |\n| 1 | 2 |  |\n| 3 in | 4 |  |"),
        ("<table><tr><td>a<td>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f<td>g</table>", "| a | b | c |\n| --- | --- | --- |\n| d |  |  |\n| e | f | g |"),
        # headings that hold blocks or that nothing ends, a head that nothing ends
        ("<html><head><title>t</title><body><h1>A<p>b<h2><div>V</div></h2>", "# A\n\nb\n\n## V"),
        ("</table></td></a></li></ul></pre></code></h1><p>q", "q"),
    ],
)
def test_steps_of_the_conversion(page, want):
    assert to_markdown(page) == want + "\n"


def test_text_stays_once():
    words = [f"w{i}" for i in range(9)]
    page = "<div>{}<ul>{}<li>{}</ul><table>{}<tr>{}<td>{}</td>{}</tr>{}</table>{}</div>".format(*words)
    got = to_markdown(page)
    assert all(got.count(w) == 1 for w in words)
