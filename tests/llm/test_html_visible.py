"""What op6_html shows and hides: attribute names and style values count, words inside other values do not."""

import pytest

from ledgerloom.llm.html_text import page_text

SHOWN = ['class="nav hidden lg:block"', 'title="the hidden cost"', 'data-x="display: none"', "alt='a hidden b'", 'aria-hidden="true"', "title= hidden", 'style="display:block"', 'style="display:none; display:block"', 'style="overflow:hidden"', "style=\"background:url('a;display:none')\"", 'class="visibility:hidden"', "data-hidden"]
HIDDEN = ["hidden", 'hidden=""', "HIDDEN", 'hidden="until-found"', 'class="a"hidden', 'style="color:red; Display : None"', "style='visibility:hidden'", "style=display:none", 'style="display:none !important; display:block"', 'style="display&#58;none"']


@pytest.mark.parametrize("attrs", SHOWN)
def test_values_do_not_hide(attrs):
    assert page_text(f"<p>a</p><div {attrs}>seen <b>too</b></div>")[1] == "a\n\nseen too"
    assert page_text(f"<table {attrs}><tr {attrs}><td {attrs}>seen</td></tr></table>")[1] == "seen"


@pytest.mark.parametrize("attrs", HIDDEN)
def test_hidden_elements_give_nothing(attrs):
    assert page_text(f"<p>a</p><div {attrs}>gone <b>too</b></div>")[1] == "a"
    assert page_text(f"<table><tr {attrs}><td>gone</td></tr><tr><td {attrs}>gone</td><td>b</td></tr></table>")[1] == "b"


def test_formulas_drawings_and_noscript_are_text():
    assert page_text("<p>x <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> y</p>")[1] == "x a=1 y"
    assert page_text("<svg><title>t</title><style>s{}</style><defs><text>d</text></defs><text>label</text></svg> z")[1] == "label z"
    assert page_text("<noscript><p>plain page</p></noscript><desc>kept</desc>")[1] == "plain page\n\nkept"


def test_spans_keep_columns_aligned():
    assert page_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>")[1] == "a  b\n   c\nd  e"
    assert page_text("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</table>")[1] == "a  b\n   c\nd  e"
    assert page_text("<table><tr><td rowspan=3 colspan=2>a<td>b<tr><td>c<tr><td rowspan=x>d<tr><td>1<td>2<td>3</table>")[1] == "a     b\n      c\n      d\n1  2  3"
    assert page_text("<table><tr><td colspan=5000>wide<td>x<tr><td>1</table>")[1] == "wide  x\n1"
    assert page_text("<table><tr><td>a<td><td>b<tr><td>c<td> <td>d</table>")[1] == "a  b\nc  d"


def test_lists_count_from_any_number():
    assert page_text("<ol start=1234><li>a<li>b</ol>")[1] == "1234. a\n1235. b"
    assert page_text("<ol start=-1><li>a<li>b<li value=10>c<li>d</ol><ol start=x><li>e</ol>")[1] == "-1. a\n0. b\n10. c\n11. d\n\n1. e"
    assert page_text('<ol data-start="7" start="3"><li>a</ol>')[1] == "3. a"


def test_deep_nesting_keeps_blocks_and_text():
    deep = "".join(f"<div>t{i}" for i in range(400))
    assert page_text(deep)[1].split("\n") == [f"t{i}" for i in range(400)]
    assert page_text("<div>" * 5000 + "x<p>y")[1].split() == ["x", "y"]
    assert page_text("<table><tr><td>" * 300 + "z")[1] == "z"
