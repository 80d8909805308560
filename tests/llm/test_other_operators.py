"""HTML, chat, toxicity, quality classifier and pipeline."""

import numpy as np

from tests.llm.conftest import ORDINARY, PASSAGE, edge_rows
from tickerlens.llm import chat_prefs, cotrain, toxicity
from tickerlens.llm import html_wrapper as H

PAGE = ("<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header>"
        "<nav><a href='/x'>menu {0}</a></nav><div id='cookie-bar'>We use cookies</div>"
        "<div class='body'><div>Read our rules first</div><h1>Title {0} &amp; more</h1>"
        "<p>First&nbsp;{0}   <b>bold</b><br>line<p>Second {0} <a href='a>b'>link</a></p>"
        "<ul><li>one {0}<li>two</ul></div><form><input><button>Go</button></form>"
        "<section class='comments'><p>nice {0}</p></section><script>if (a<b) x('</p>')</script>"
        "<aside>side</aside><footer>end</footer></body></html>")


def test_wrapper_drops_template_and_roles(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i), "x") for i in range(30)]
    rows += [(100, None, "<p>alone</p>", "x"), (101, "http://h.example/q", None, "x"),
             (102, "http://k.example/", "", "x"), (103, "http://k.example/", "<p>a < b &lt;c&gt; <i>d", "x"),
             rows[0]]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, __host string")
    got = {r["page_id"]: r for r in H.extract(df).collect()}
    assert got[7]["text"] == "Title 7 & more\nFirst 7 bold line\nSecond 7 link\none 7"
    assert got[7]["__host"] == "x"
    assert [got[i]["text"] for i in (100, 101, 102, 103)] == ["alone", "", "", "a < b <c> d"]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert H.extract(empty).count() == 0


def test_article_without_a_wrapper():
    page = ("<body><div>top</div><article><header><h1>Head</h1></header><p>One</p><p>Two</p>"
            "<div class='share-buttons'>share</div></article><div>bottom</div>")
    assert H.main_text(page, None) == "Head\nOne\nTwo"
    assert H.main_text("<p>" * 5000 + "deep", None) == "deep"


def test_case_of_raw_end_tags_keeps_offsets():
    grows = "\u0130" * 12          # one character that becomes two in lower case
    page = (f"<p>{grows}</p><SCRIPT>x</Script ><p>Hello world</p><TITLE>t</tItLe><p>Second</p>"
            "<style>s</ſtyle><p>style text</p></style><p>Third</p>")
    assert H.main_text(page, None) == f"{grows}\nHello world\nSecond\nThird"


def test_spellings_of_marks():
    page = "".join(f"<div class='{c}'>out</div>" for c in (
        "COMMENTS", "side-bar", "sideBar", "SIDE_BAR", "siteNav", "post-Comments2", "x__nav-bar", "NAVBar"))
    assert H.main_text(page + "<div class='entry-Body loading adverb'>in</div>", None) == "in"


def test_deep_nesting(spark):
    for tags in (["div"], ["div", "p", "ul", "li"], ["span", "b"]):
        deep = "".join(f"<{tags[k % len(tags)]}>" for k in range(10_000))
        assert H.main_text(f"<p>top</p>{deep}bottom", None) == "top\nbottom"
        root, _ = H.parse(deep + "bottom")
        assert len(H.preorder(H.unpack(H.pack(root)))) == len(H.preorder(root))
    rows = [(i, "http://deep.example/", "<div>menu</div>" + "<div>" * 10_000 + f"text {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(df).collect()} == {i: f"text {i}" for i in range(12)}


def _random_tree(rng, depth):
    x = H.Node(str(rng.choice(["a", "b", "c"])))
    for _ in range(int(rng.integers(0, 4)) if depth else 0):
        x.kids.append(_random_tree(rng, depth - 1))
    return x


def _plain_matching(a, b):
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j],
                                     best[i][j] + (_plain_matching(x, y) if x.sig == y.sig else 0))
    return best[-1][-1] + 1


def test_tree_matching_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(400):
        a, b = _random_tree(rng, 3), _random_tree(rng, 3)
        b.sig = a.sig
        size, pairs = H.matching(a, b, {})
        assert size == _plain_matching(a, b)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert size == 1 + sum(_plain_matching(a.kids[i], b.kids[j]) for i, j in pairs)
        assert len(H.preorder(H.merge(a, b))) == H.measure(a).size + H.measure(b).size - size


def test_wrapper_alone_finds_the_template(spark, monkeypatch):
    """No element name and no class tells: aligned slots decide."""
    page = ("<div class=a><div class=b>Home</div><div class=b2>News</div></div>{2}<div class=c>Read our "
            "terms</div><div class=d><h1>Title {0}</h1><p>Body {0}</p>{1}<p>Same words</p></div>"
            "<div class=e>Reader votes</div><div class=f>All rights</div>")
    rows = [(i, "http://h.example/", page.format(i, "<p>more</p>" * (i % 3), "<hr><p>promo</p>" * (i % 2)))
            for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for name in ("MARKS", "LEFT_OUT"):
        monkeypatch.setattr(H, name, frozenset())
    pages = df.selectExpr("'h' AS host", "html")
    wrapper = H.unpack(H.induce(pages).first()["wrapper"])
    for i, _, html in rows:
        got = H.main_text(html, wrapper).split("\n")
        assert [f"Title {i}", f"Body {i}"] == [x for x in got if x.endswith(f" {i}")]
        assert not {"Home", "News", "Read our terms", "Reader votes", "All rights", "Same words"} & set(got)
        assert H.main_text(html, None).startswith("Home\nNews")


def test_a_hot_host_is_spread_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(H, "SALT_PAGES", 5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        trees = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("h"), F.col("id") % 20)).alias("host"), F.xxhash64("id").alias("digest"),
            F.lit(H.pack(H.Node("#"))).alias("tree"))
        dealt = H._dealt(trees)
        plan = dealt.groupBy("host", "salt").count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(host#") >= 2 and "salt#" in plan
        tasks = dealt.withColumn("task", F.spark_partition_id()).filter("host = 'hot'")
        assert tasks.select("task").distinct().count() >= 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_left_out_inline_elements_stay_out_of_their_block():
    page = ("<article><p>A <span class='ad'>Buy <b>now</b></span> B</p>"
            "<p>C<button>Copy</button>D <a class='share-link' href='x'>Share</a>.</p>"
            "<p>E <label>Mail <select><option>x<option>y</select></label>F <span class='promo'/>G</p>"
            "<p>in<span class='ad'></span>side <span class='ad'>open</p><p>H <i>i</i></p>"
            "<div>J <a class='promo'><div>card</div>more</a> K</div></article><button>last")
    assert H.main_text(page, None) == "A B\nC D .\nE F G\ninside\nH i\nJ K"
    root, _ = H.parse("<p>A <span class='ad'>Buy</span> B</p>")
    p, = root.kids
    assert len(p.texts) == 1 and [k.sig for k in p.kids] == ["span.ad"] and len(p.kids[0].texts) == 1


def test_simple_tree_matching():
    a, _ = H.parse("<div><h1>x</h1><p>1</p><ul><li>2</ul></div>")
    b, _ = H.parse("<div><p>1</p><table><tr><td>z</table><ul><li>3</ul></div>")
    size, pairs = H.matching(a.kids[0], b.kids[0], {})
    assert size == 4 and pairs == [(1, 0), (2, 2)]
    w = H.merge(a, b)
    assert w.n == 2 and [k.sig for k in w.kids[0].kids] == ["h1", "p", "table", "ul"]


def test_preferences(spark):
    t = "array<struct<role:string,text:string>>"
    a = [("user", "hi"), ("assistant", "A<|im_end|>"), ("user", "more"), ("assistant", "yes")]
    rows = [(1, a, [*a[:3], ("assistant", "no"), ("user", "x")], "e"), (2, a, a, "e"), (3, None, a, "e"),
            (4, [], [], "e")]
    df = spark.createDataFrame(rows, f"pair bigint, chosen {t}, rejected {t}, __n string")
    got = {r["pair"]: r for r in chat_prefs.format_preferences(df).collect()}
    r = got[1]
    assert r["n_prompt_turns"] == 3 and r["prompt"].count(chat_prefs.CLOSE) == 3
    assert "A< |im_end|>" in r["prompt"] and r["__n"] == "e"
    for side, want in (("chosen", ["yes<|im_end|>"]), ("rejected", ["no<|im_end|>"])):
        assert [r[side][s["start"]:s["end"]] for s in r[f"{side}_mask"]] == want
    assert got[2]["n_prompt_turns"] == 4 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["n_prompt_turns"] == 0 and got[3]["chosen"] == "" and len(got[3]["rejected_mask"]) == 2
    assert got[4]["prompt"] == ""


def test_conversations_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "b"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_prefs.conversations(df).collect()
    assert [(r["conv_id"], [tuple(t) for t in r["turns"]]) for r in got] == [
        (1, [("", ""), ("assistant", "b")])]
    assert chat_prefs.format_preferences(chat_prefs.borrowed_pairs(
        chat_prefs.conversations(df.limit(0)))).count() == 0


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def labelled(spark, n=1200):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}" for a in ("river", "town", "boat", "field", "wind") for b in range(60)]
    bad = ["vileword", "nastyterm", "grimslur"]
    rows, labels = [], []
    for i in range(n):
        ws = list(rng.choice(vocab, int(rng.integers(20, 80))))
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            ws[int(rng.integers(len(ws)))] = str(rng.choice(bad))
        low = i % 4 == 1
        text = " ".join(w + "%%%" for w in ws) if low else " ".join(ws)
        rows.append((i, text, "en", "spam" if low and i % 3 else f"s{i % 3}"))
        if i % 3:
            labels.append((i, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return docs, lab


def test_toxicity_held_out_accuracy_and_edges(spark, edges, empty):
    docs, lab = labelled(spark)
    model = toxicity.train(docs, lab)
    got = toxicity.score(docs, model).join(lab, "doc_id").filter(toxicity.held_out("doc_id")).toPandas()
    assert _auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.95
    rows = {r["doc_id"]: r for r in toxicity.score(edges, model).collect()}
    assert all(0 <= rows[i]["score"] <= 1 and rows[i]["__words"] for i, *_ in edge_rows())
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"]
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, lab.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(edges, none).collect()} == {0.0}
    assert toxicity.train(docs, lab.limit(0)).weights == ()


def test_cotraining_held_out_accuracy_and_edges(spark, edges, empty):
    docs, lab = labelled(spark)
    got = cotrain.quality_scores(docs, lab).filter("held_out").join(lab, "doc_id").toPandas()
    assert _auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.95
    assert _auc(got["meta_score"].to_numpy(), got["quality"].to_numpy()) > 0.6
    rows = cotrain.quality_scores(edges, lab).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert cotrain.quality_scores(empty, lab).count() == 0
    one = cotrain.quality_scores(edges, lab.filter("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0}


def test_pipeline_stages(spark, edges, tmp_path):
    import corpus_pipeline as C
    d = str(tmp_path)
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = edges.drop("__words")
    cols = docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, d)
        if k < 4:
            assert docs.columns == cols
    got = {r["doc_id"]: r for r in docs.collect()}
    # blank, short and repeating texts, copies and near copies, and the passage go
    assert set(got) == {4, 6, 7}        # one word of 36 is Jaccard 0.73
    assert got[4]["text"] == ORDINARY and all(r["round_trip"] for r in got.values())
    empty = edges.drop("__words").limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, d)
    assert empty.count() == 0
