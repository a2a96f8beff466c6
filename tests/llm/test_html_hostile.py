"""op6 on broken and hostile pages: time and text linear in the page; and the layout of cells with several lines."""

import time

import pytest

from ledgerloom.llm.html_text import page_text

MB = 1 << 20


def timed(page):
    began = time.process_time()
    title, text = page_text(page)
    return title, text, time.process_time() - began


HOSTILE = {
    "open tags": "<a " * (MB // 3),
    "open tags and a quote": '<a "' * (MB // 4),
    "names without end": "<a" * (MB // 2) + ' "',
    "open titles": "<title>" * (MB // 7),
    "titles without bracket": "<title" * (MB // 6),
    "declarations": "<!" * (MB // 2),
    "comments": "<!--" * (MB // 4),
    "quotes in turn": "<a \"'" * (MB // 5),
    "brackets in a style": '<p style="' + "(" * MB + '">x</p>',
    "comments in a style": '<p style="' + "/*" * (MB // 2) + '">x</p>',
    "blanks in attributes": "<p a" + " " * MB + ">x</p>",
    "end tags": "</b>" * (MB // 4),
    "deep lists": "<ul><li>" * 250 + "x<br>" * (MB // 5),
    "scripts": "<script>" * (MB // 8),
    "wide spans": "<table>" + "<tr><td colspan=1000 rowspan=2>a<td>b" * (MB // 40),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_and_text_are_linear(name):
    _, text, took = timed(HOSTILE[name])
    assert took < (8 if name in ("deep lists", "wide spans") else 2)
    assert len(text) <= 64 * len(HOSTILE[name])


def test_one_wide_cell_does_not_widen_all_rows():
    page = "<table>" + "<tr><td>a<td>b" * 2000 + f"<tr><td>{'w' * 20000}<td>c</table>"
    text = page_text(page)[1]
    assert len(text) < 4 * len(page)
    lines = text.split("\n")
    assert lines[0] == "a  b" and lines[-1] == "w" * 20000 + "  c"
    page = "<table><tr>" + f"<td>{'x' * 70}" * 900 + "<tr><td colspan=899>a<td>b" * 20000 + "</table>"
    assert len(page_text(page)[1]) < 12 * len(page)
    nested = "<table><tr><td>" + "y" * 50 + "<td>"
    page = nested * 60 + "<table>" + "<tr><td>1<td>2" * 5000
    assert len(page_text(page)[1]) < 12 * len(page)


def test_cells_keep_their_lines():
    assert page_text("<table><tr><td><h1>Head</h1><p>one</p><ul><li>a</li><li>b</li></ul></td></table>")[1] == "Head\n\none\n\n- a\n- b"
    got = page_text("<table><tr><td>left<br>side<td><ol><li>x<li>y</ol><p>end<tr><td>z<td>1</table>")[1]
    assert got == "left  1. x\nside  2. y\n\n      end\nz     1"
    inner = "<table><tr><td>aa<td>b<tr><td>c<td>d</table>"
    assert page_text(f"<table><tr><td>out<td>{inner}<td>r<tr><td>k<td>l</table>")[1] == "out  aa  b  r\n     c   d\nk    l"
    assert page_text("<table><tr><td><pre>a  b\n\n c</pre><td>x</table>")[1].split("\n") == ["a  b  x", "", " c"]


def test_broken_tags_are_text_and_what_follows_is_read():
    assert page_text('<a href="x>one</a> <b>two</b>')[1] == '<a href="x>one two'
    assert page_text("1 < 2 <i>and</i> 3 > 2 <")[1] == "1 < 2 and 3 > 2 <"
    assert page_text("a <!-- b > c <p>d")[1] == "a"
    assert page_text("a < b <!-- c")[1] == "a < b"
    assert page_text("<p>x<!doctype q>y<?php z ?>w")[1] == "xyw"
    assert page_text("<a b='>'>c</a><a b='")[1] == "c<a b='"


def test_titles():
    assert page_text("<title> a\n b </title><title>c</title>x") == ("a b", "x")
    assert page_text("<svg><title>s</title></svg><head><title class=x>t &amp; u</TITLE></head>x") == ("t & u", "x")
    assert page_text("<!-- <title>no</title> --><title>open") == ("", "")
    assert page_text(None) == page_text("") == ("", "")
