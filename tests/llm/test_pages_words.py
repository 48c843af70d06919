"""Names as evidence in page extraction, and the shortcut of the word-level encoder."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import mincut_html
from corpusflow.llm.word_ids import ChunkEncoder

TOWN = "A long paragraph, which tells of a town by the sea, has several commas, and it ends as sentences should."
STORY = f"<p>{TOWN}</p>" * 3
WHOLE = "\n".join([TOWN] * 3)


@pytest.mark.parametrize("page", [
    f'<nav><a href="/">Home</a></nav><div class="post-content no-sidebar">{STORY}</div><footer>us</footer>',
    f'<div id="content" class="side-by-side">{STORY}</div>',
    f'<div class="story-share-wrap"><div class="body">{STORY}</div></div>',
    f'<body><form id="aspnetForm"><input type="hidden" name="v"><div class="article">{STORY}</div></form></body>',
    f'<form><div class="main">{STORY}<form><input name="q"><button>Search</button></form></div></form>',
    f'<article><p class="legal">{TOWN}</p><p>{TOWN}</p><p>{TOWN}</p></article>',
    f'<article><div class="search-results-study">{STORY}</div></article>',
    f'<div class="has-comments with-ads">{STORY}</div><div class="comments"><p>{TOWN}</p></div>',
])
def test_articles_in_elements_named_like_boilerplate_stay(page):
    assert mincut_html.main_text(page) == WHOLE


@pytest.mark.parametrize("part", [
    '<div class="user-comments"><p>{}</p></div>', '<section id="comments"><article class="comment"><p>{}</p></article></section>',
    '<div class="ad-slot"><p>{}</p></div>', '<div class="left-sidebar"><div class="text"><p>{}</p></div></div>',
    '<div class="cookie-notice"><p>{}</p></div>', '<form><p>{}</p><input><input></form>', '<aside><p>{}</p></aside>',
    '<div class="related-posts"><p>{}</p></div>', '<div class="post-comments"><div class="comment-body"><p>{}</p></div></div>'])
@pytest.mark.parametrize("around", ["<article>{}</article>{}", "<div>{}</div>{}", '<div class="post no-sidebar">{}</div>{}'])
def test_named_boilerplate_goes(part, around):
    assert mincut_html.main_text(around.format(STORY, part.format(TOWN))) == WHOLE


def test_the_cut_overrules_a_name():
    short = "All of this is by law."
    alone = mincut_html.blocks(f'<div><p class="legal">{short}</p></div>')
    assert mincut_html.look(alone)[0] @ mincut_html.PRIOR < 0 and mincut_html.label(alone, mincut_html.PRIOR) == [False]
    page = f'<div><p>{TOWN}</p><p class="legal">{short}</p><p>{TOWN}</p></div>'
    assert mincut_html.main_text(page).split("\n") == [TOWN, short, TOWN]


def test_nested_forms_take_linear_time():
    found = mincut_html.blocks("<fieldset>a" * 50_000)
    assert len(found) == 50_000 and {b.stated for b in found} == {-1}
    assert np.isfinite(mincut_html.look(found)).all()


def test_word_encoder_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine, rng = Tokenizer.from_file(path), ChunkEncoder(path), random.Random(7)
    letters = [chr(c) for c in range(0x21, 0x300)]
    texts = ["".join(w) for c in letters for w in (c, c + "ab", "Ab" + c, "a" + c + "b", c * 3, "it'" + c)]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(4000)]
    texts += ["".join(rng.choices("abcdeéèßñstz", k=rng.randint(1, 40))) + rng.choice(["", ".", ",)", "'s"]) for _ in range(4000)]
    for text in texts + [" ".join(texts[:500])]:
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        assert mine.encode(text) == want.tobytes(), text
