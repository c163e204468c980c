"""Elements that a page hides are no text; those that only have such a word in other attributes are."""

import pytest

from gaugemark.llm import html_extract as h


@pytest.mark.parametrize("mark", ["hidden", "HIDDEN", "hidden=hidden", 'hidden=""', 'class=a hidden id="b"', 'style="display:none"', "style='color:red; DISPLAY : none'", "style=display:none", 'style="visibility:hidden"', 'hidden="until-found"', "id=x hidden /x"])
def test_hidden_elements_are_not_read(mark):
    assert [b.text for b in h.leaves(f"<body><p>One</p><div {mark}><p>Not <b>this</b></p>nor this</div><p>Two <span {mark}>not</span>three</p></body>")] == ["One", "Two three"]


@pytest.mark.parametrize("mark", ['class="hidden"', "class='a hidden b'", 'aria-hidden="true"', "data-hidden", 'style="overflow:hidden"', 'title="display:none"', 'style="text-decoration:none"', "data-style='display:none'", 'id=hidden', "unhidden", 'style="--display:none"'])
def test_other_uses_of_the_words_hide_nothing(mark):
    assert [b.text for b in h.leaves(f"<body><p>One</p><div {mark}>Two</div></body>")] == ["One", "Two"]


def test_ends_of_hidden_elements():
    """A hidden paragraph ends with the next one, an open container with its parent; the page's own elements never hide it."""
    assert [b.text for b in h.leaves("<html hidden><body style='display:none'><p hidden>No<p>One<section><div hidden>No</section>Two<br hidden>three")] == ["One", "Two three"]


@pytest.mark.parametrize("tag", ["<p " + "hidden= " * 140_000, "<p " + 'style="none' * 90_000 + ">x", "<p " + "= 'none\" " * 110_000 + ">x", ("<p hidden>a" * 90_000)])
def test_hostile_attributes_take_linear_time(tag):
    import time

    begin = time.process_time()
    h.leaves(tag)
    assert time.process_time() - begin < 2
