"""Work that is done once: labels of elements, and words with marks behind them."""

import random

import pytest

from relforge.llm import html_template, token_files


def test_labels_of_equal_elements_are_read_once():
    read = html_template._read_label
    read.cache_clear()
    item = '<div class="card wide"><a href="/{}" title="x">one</a></div><p>two</p>'
    page = "<html><body>" + "".join(item.format(k) for k in range(50)) + "</body></html>"
    list(html_template.walk(page))
    assert read.cache_info().misses == 5  # html, body, div with its class, and a and p without what they don't need
    long = f'class="sidebar" data-x="{"y" * 300}"'
    for name, attributes in [("div", long), ("div", 'CLASS="site-footer"'), ("div", 'claſs="ad"'), ("div", 'title="é" role=main'), ("td", "width=1"), ("main", "")]:
        assert html_template._label(name, attributes) == read.__wrapped__(name, attributes)
    assert read.cache_info().currsize == 10  # not the long one


def test_a_word_is_encoded_once_whatever_marks_follow_it(monkeypatch):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    cache = token_files._tokenizer(path)[0]
    cache.clear()
    asked, encode = [], cache.encode
    monkeypatch.setattr(cache, "encode", lambda units, kind: asked.extend((u, kind) for u in units) or encode(units, kind))
    library = Tokenizer.from_file(path)
    text = "a wordlike wordlike, wordlike. other!? wordlike, don't other's x́, öl; _a_ ×."
    (got,) = token_files._ids([text], path, True)
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert [u for u, kind in asked if u.startswith("wordlike")] == ["wordlike"]
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab'sé.,;!-_ \n×٣中’ʰ́") for _ in range(rng.randint(0, 30))) for _ in range(2_000)]
    assert [x.tolist() for x in token_files._ids(texts, path, True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    cache.clear()


def test_words_are_encoded_once_wherever_they_stand(monkeypatch):
    """Before, a word was encoded again with whatever stood between it and the next blank: lines, addresses, digits."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    cache = token_files._tokenizer(path)[0]
    cache.clear()
    asked, encode = [], cache.encode
    monkeypatch.setattr(cache, "encode", lambda pieces, kind: asked.extend((p, kind) for p in pieces) or encode(pieces, kind))
    library = Tokenizer.from_file(path)
    text = "wordlike.\nwordlike, one wordlike\nwordlike\n\nnext wordlike-wordlike@wordlike.wordlike 12wordlike34 wordlike.\nwordlike"
    assert token_files._ids([text, "wordlike", "", text], path, True)[3].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted((p, kind) for p, kind in asked if p == "wordlike") == [("wordlike", "bare"), ("wordlike", "blank")]
    assert [p for p, _ in asked if "wordlike" in p and p != "wordlike"] == []
    assert len(asked) == len(set(asked))
    rng = random.Random(6)
    end = library.get_added_tokens_decoder()[50256].content
    alphabet = [*"aB'éĀɏɐ×÷µª½1٣.-_жあ日€\U0001f600\U00020000́\0", "'s", "'ll", *" \n" * 3, *"\t\r\x1c\x85\xa0 ᠎     　​", end]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    assert [x.tolist() for x in token_files._ids(texts, path, True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    cache.clear()
