from crosswind.llm.html_text import main_text

A, B = "Some words that make up the text of this page. " * 17, "Other words that close the text of this page. " * 3


def paragraphs(text):
    return "".join(f"<p>{s}.</p>" for s in text.strip().split(".") if s)


def test_lesser_sections_stay():
    page = f"<nav><a href=x>Menu</a></nav><div id=content><div>{paragraphs(A)}</div><div>{paragraphs(B)}</div></div><footer>me</footer>"
    got = main_text(page)
    assert got.count("Some words") == 17 and got.count("Other words") == 3 and "Menu" not in got and "me" not in got.split("\n")


def test_all_articles_stay():
    got = main_text(f"<main><article>{paragraphs(A)}</article><article>{paragraphs(B)}</article></main>")
    assert got.count("Some words") == 17 and got.count("Other words") == 3
    got = main_text(f"<main><article>{paragraphs(B)}</article><div>{paragraphs(A)}</div></main>")
    assert got.count("Some words") == 17 and got.count("Other words") == 3
    assert main_text(f"<main><p>x</p><article><h1>T</h1>{paragraphs(B)}</article></main><div>{paragraphs(A)}</div>").count("Some words") == 0


def test_clusters_choose_the_region_and_no_text_is_lost():
    both = main_text(f"<article>{paragraphs(B)}</article><div>Advert of the day</div><article>{paragraphs(A)}</article>")
    assert both.count("Some words") == 17 and both.count("Other words") == 3 and "Advert" not in both
    assert main_text("<article><p>Let <math><mi>x</mi></math> be <button>pressed</button> here, with more words.</p></article>") == "Let x be pressed here, with more words."
    kept = '<article><div class="book-reviews"><p>Reviews of books that we like to read.</p></div><section class="related-work"><p>Related work is plenty.</p></section></article>'
    assert main_text(kept) == "Reviews of books that we like to read.\nRelated work is plenty."
    assert main_text('<article><p>Text of some words.</p><div class="related-posts"><p>More for you to read</p></div><div id="comments-area"><p>I liked it</p></div></article>') == "Text of some words."
    assert main_text("<article><p>A text of several words.</p><!-- x <p>mid</p>") == "A text of several words."
    assert main_text("<p>x <!-- c --> y</p><script><!-- foo </script><p>After the script there is more.") == "x y\nAfter the script there is more."


def test_long_and_deep_pages():
    assert main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert main_text("<article>" + "<p>words of a paragraph</p>" * 20_000 + "</article>").count("\n") == 19_999
