"""Cases that once lost text or ended a task: names inside articles, forms around pages, white space without end."""

import pytest
import tokenizers

from siltstone.llm import html_main, packing

BODY = "Long text of the article, as it was written. " * 5


def text(source):
    page = html_main.Page(source)
    page.measure()
    page.weigh({})
    return page.text()


@pytest.mark.parametrize("name", ["navigation", "discussion", "search", "comments", "related", "menu", "header"])
@pytest.mark.parametrize("tag", ["h2", "p", "li"])
def test_names_on_running_text_of_articles(name, tag):
    for kind in ("id", "class"):
        assert text(f"<body><nav>n</nav><article><{tag} {kind}='{name}'>Kept</{tag}><p>{BODY}</p></article>").split("\n")[0] == "Kept"


@pytest.mark.parametrize("part", ["<section id='discussion'><h2>D</h2></section>", "<div class='alert alert-info'>D</div>", "<div class='notice'>D</div>", "<section id='search'>D</section>", "<div id='related'>D</div>"])
def test_parts_of_articles_that_stay(part):
    assert "D" in text(f"<body><article><p>{BODY}</p>{part}</article>").split("\n")


@pytest.mark.parametrize(
    "part", ["<div class='ad'>D</div>", "<section id='comments'>D</section>", "<div class='comment-list'>D</div>", "<ul class='share-links'><li>D</ul>", "<nav>D</nav>", "<aside>D</aside>", "<footer>D</footer>", "<form>D<input></form>", "<div class='cookie-banner'>D</div>"]
)
def test_parts_of_articles_that_go(part):
    assert "D" not in text(f"<body><article><p>{BODY}</p>{part}<p>{BODY}</p></article>").split("\n")


def test_forms_around_pages_and_main_around_articles():
    clean = " ".join(BODY.split())
    assert text(f"<body><form id='aspnetForm'><div><p>{BODY}</p><input></div></form>") == clean
    assert text(f"<body><form>search</form><div role='search'>find</div><p>{BODY}</p>") == clean
    assert text(f"<body><main><p>INTRO</p><article><p>{BODY}</p></article><p>END</p></main>") == f"INTRO\n{clean}\nEND"
    assert text(f"<body><p>x</p><main><article><p>{BODY}</p></article></main><article>MORE</article>") == f"{clean}\nMORE"


def test_long_white_space_is_packed(spark):
    own = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 50_000, " \t" * 200_000 + "y", " " * (packing.LONG_BLANK - 1) + "z", "x  " * 50_000]
    encode = packing.encoder(packing.default_tokenizer())
    for t in texts[1:]:
        assert encode(t) == own.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    lengths = {r.doc_id: r.n for r in packing.pack_documents(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert lengths == {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}
