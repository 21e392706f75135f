"""Language ID, page text and chat formatting."""

import itertools
import random

import numpy as np
import pytest

from tessel.llm import chat, language, pages, pages_train, trees

SAMPLES = {"aa": "ka lo ti mu ra", "ab": "ka lo ti me re", "ba": "ßchö grüm strä pfül", "bb": "ßchö grüm strä kröt"}


def docs(spark, n=400):
    r = random.Random(2)
    rows = []
    for k in range(n):
        lang = r.choice(list(SAMPLES))
        rows.append((k, " ".join(r.choices(SAMPLES[lang].split(), k=r.randint(8, 60))), lang, "clash", 1.0))
    rows += [(n, None, "aa", None, None), (n + 1, "", None, None, None), (n + 2, "123 !? ½ _", "aa", None, None), (n + 3, "ka " * 50_000, None, None, None), (None, "ka lo", None, None, None), (1, "ka lo ti", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_languages_are_told_apart(spark):
    df = docs(spark)
    model = language.learn(df, sample=300)
    assert sorted(sorted(v.classes) for v in model.languages) == [["aa", "ab"], ["ba", "bb"]]
    found = language.identify(df, model).collect()
    assert len(found) == df.count()
    truth = {r["doc_id"]: r["lang"] for r in df.collect() if r["doc_id"] is not None and r["doc_id"] < 400 and r["lang"]}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 1]
    assert len(held) > 50
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["lang_pred"] for r in found}
    assert (by[400], by[401], by[402]) == ("und",) * 3
    assert by[403] in SAMPLES


def test_nothing_to_learn_from(spark):
    df = docs(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")
    model = language.learn(df)
    assert model is None
    assert {r["lang_pred"] for r in language.identify(df, model).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_one_language_is_always_predicted(spark):
    df = docs(spark).where("lang = 'aa' and text is not null")
    assert {r["lang_pred"] for r in language.identify(df, language.learn(df)).collect()} - {"und"} == {"aa"}


def test_prediction_reads_only_the_text(spark):
    df = docs(spark)
    model = language.learn(df, sample=300)
    a = language.identify(df.where("doc_id = 7"), model).first()["lang_pred"]
    b = language.identify(df.where("doc_id = 7").selectExpr("doc_id + 9000 as doc_id", "text", "'zz' as lang"), model).first()["lang_pred"]
    assert a == b


def test_pages_of_the_grammar():
    sources = [pages_train.Writer(5_000_000 + k).page() for k in range(200)]
    same = [a == pages_train.gold(s) for a, s in zip(pages.texts(sources), sources)]
    assert np.mean(same) > 0.97


PAGE = """<html><head><title>t</title><script>var x = "<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy this now, it is cheap.</div>
<article><h1>A &amp; B</h1><p><b>First   line,<br>still first.<p>Second &#8212; one.</p><noscript>no</noscript></article>
<section class="comments"><p>I like it.</p></section><footer>&copy; us</footer></body></html>"""


def test_a_page_with_everything():
    assert pages.texts([PAGE]) == ["A & B\nFirst line, still first.\nSecond — one."]


#: Pages written by hand, with their texts.
GOLD = [
    (
        "<body><nav><a href=/>Home</a> <a href=/n>News</a></nav>This is the main article text, and it goes on for a while. It has more than one sentence."
        "<p>Second paragraph of the same article, with words.</p></body>",
        "This is the main article text, and it goes on for a while. It has more than one sentence.\nSecond paragraph of the same article, with words.",
    ),
    (
        "<nav><ul><li><a href=/>Home</a></ul></nav><datalist><option value=a></datalist><article><h1>Title here</h1><p>The article is long enough, with two sentences. Here is the other.</p></article>",
        "Title here\nThe article is long enough, with two sentences. Here is the other.",
    ),
    (
        "<article><p>Icons <svg><path d=M0/><text>no</text></svg> inside a line stay out of it. So do they here.</p><canvas>no<p>none</p></canvas><p>The end of the article, finally.</p></article>",
        "Icons inside a line stay out of it. So do they here.\nThe end of the article, finally.",
    ),
    (
        "<article><p>Before the drawing that was never closed, there are words.</p><svg><g><path><p>After it, there are more words. They count.</p></article>",
        "Before the drawing that was never closed, there are words.\nAfter it, there are more words. They count.",
    ),
    (
        "<article><p>Choose one of these, please. They are all good.</p><select><option>One<option>Two</select><p>You have chosen well, have you not?</p></article>",
        "Choose one of these, please. They are all good.\nYou have chosen well, have you not?",
    ),
    ("<body>Only bare text here.<br>And more of it.</body>", "Only bare text here. And more of it."),
    (
        "<body><header><h1>Site name</h1></header><main><h2>Heading</h2><p>First paragraph, of some length. It ends.</p><template><p>never</p></template>"
        "<p>Second paragraph, of some length too.</p></main><footer>&copy; 2020 Someone</footer></body>",
        "Heading\nFirst paragraph, of some length. It ends.\nSecond paragraph, of some length too.",
    ),
]


@pytest.mark.parametrize("html, text", GOLD)
def test_pages_written_by_hand(html, text):
    assert pages.texts([html]) == [text]


def test_bare_text_of_the_grammar():
    sources = [s for k in range(600) if pages_train.BARE_MARK in (s := pages_train.Writer(6_000_000 + k).page())]
    same = [a == pages_train.gold(s) for a, s in zip(pages.texts(sources), sources)]
    assert len(same) > 40 and np.mean(same) > 0.85


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<script>x", "<!-- never closed", "<p", "<>", "</p></p>"])
def test_pages_without_text(html):
    assert pages.texts([html])[0] in ("", "<p", "<>")


def test_pages_as_a_table(spark):
    rows = [(1, "u", PAGE, "clash"), (None, None, None, None), (1, "u", PAGE, None), (2, "v", "<p>" + "word " * 100_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = pages.extract_text(df).collect()
    assert len(found) == 4
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert pages.extract_text(df.limit(0)).count() == 0


def test_no_child_without_its_parent():
    source = pages_train.Writer(77).page()
    page = pages.Page(source)
    judged, x = pages.node_features(page)
    kept = pages.decode(page, judged, np.random.default_rng(1).standard_normal(len(judged)))
    assert all(page.nodes[k].parent in kept for k in kept if k)


def test_decoding_is_the_likeliest_choice():
    page = pages.Page("<div><p>a</p><ul><li>b</li></ul></div><p>c</p>")
    judged, _ = pages.node_features(page)
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = rng.standard_normal(len(judged)) * 2
        worth = lambda kept: sum(-np.logaddexp(0, -v) if k in kept else -np.logaddexp(0, v) for k, v in zip(judged, m))
        best = max(
            (worth(set(c)) for n in range(len(judged) + 1) for c in itertools.combinations(judged, n) if all(page.nodes[k].parent in c or page.nodes[k].parent not in judged for k in c))
        )
        assert abs(worth(pages.decode(page, judged, m)) - best) < 1e-9


def test_trees_fit_and_reload(tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    fitted = trees.fit(x, y, trees=20, depth=3)
    assert (((fitted.margin(x) > 0) == y).mean()) > 0.97
    fitted.save(tmp_path / "t.json")
    again = trees.BoostedTrees.load((tmp_path / "t.json").read_text())
    assert np.abs(again.margin(x) - fitted.margin(x)).max() < 1e-2


def legal(roles):
    if roles[:1] == ["system"]:
        roles = roles[1:]
        if not roles:
            return False
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


def brute_cost(roles, most=3):
    """Least cost over all sequences of decisions, tried one by one."""
    best = {}

    def step(k, state, cost):
        if best.get((k, state), 1e9) <= cost:
            return
        best[k, state] = cost
        if k == len(roles):
            return
        for c, before, after, _ in chat.options(roles[k]):
            if before == state:
                step(k + 1, after, cost + c)

    step(0, chat.START, 0)
    return min(cost + chat.closing_cost()[s] for (k, s), cost in best.items() if k == len(roles))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repair_has_least_cost_and_is_legal(n):
    for roles in itertools.product([*chat.ROLES, None], repeat=n):
        roles = list(roles)
        states = chat.borders([chat.matrix(roles)])
        steps = chat.repair(roles, states[0], states[1])
        text = "".join(chat.render(*s, "x", k == n - 1) for k, s in enumerate(steps))
        shown = [p.split("\n")[0] for p in text.split(chat.OPEN)[1:]]
        assert legal(shown), (roles, shown)
        assert text.count(chat.OPEN) == text.count(chat.CLOSE)
        assert chat.matrix(roles)[chat.START].__add__(chat.closing_cost()).min() == brute_cost(roles)
        half = chat.borders([chat.matrix(roles[: n // 2]), chat.matrix(roles[n // 2 :])])
        assert len(half) == 3


def test_conversations_as_a_table(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "ho", None), (2, 0, "assistant", "first", None), (2, 1, "assistant", None, None), (3, 5, "bot", "odd", None), (3, 5, None, "odd", None), (3, None, "system", "s", None), (None, 1, "user", "lost", None), (1, 2, "user", "bye", None)]
    rows += [(9, k, ["user", "assistant"][k % 2 if k < 500 else (k + 1) % 2], f"t{k}", None) for k in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, enter string").repartition(4)

    def whole(stretch=chat.STRETCH):
        out = {}
        for r in sorted(chat.format_conversations(df, stretch).collect(), key=lambda r: (r["conv_id"] or 0, r["nth"])):
            out[r["conv_id"]] = out.get(r["conv_id"], "") + r["rendered"]
        return out

    found = whole()
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert found[1] == turn("user", "hi") + turn("assistant", "ho") + turn("user", "bye") + turn("assistant", "")
    assert found[2] == turn("user", "") + turn("assistant", "first\n")
    assert found[None] == turn("user", "lost") + turn("assistant", "")
    assert all(legal([p.split("\n")[0] for p in t.split(chat.OPEN)[1:]]) for t in found.values())
    assert whole(64) == found
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<p>some words here, and more.</p>" * 30_000, "<p>text</p>" + '<a href="' * 100_000, "<div>" * 500 + "x" + "</span></p></section>" * 30_000, "<b>" * 300 + "<p>word</p></i>" * 20_000, "<svg>" + "<g>" * 50_000 + "</p></i>" * 50_000, "bare words<br>" * 50_000, "<select><p>x" * 50_000],
    ids=["flat", "unterminated", "unmatched", "nested", "unread", "bare", "broken out"],
)
def test_long_pages_take_seconds(page):
    import time

    from tessel.llm import pages

    begin = time.process_time()
    pages.texts([page])
    assert time.process_time() - begin < 20
