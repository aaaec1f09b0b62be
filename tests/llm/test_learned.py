"""Learned operators: held-out accuracy, exact searches, recall."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwarden.llm import calibrate, html_text, langid, nn_descent, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    got = queries.QUERIES[name](spark, SF).filter("held_out")
    rows = got.join(queries.table(spark, SF, "labels"), "doc_id").select("predicted", label, "score").collect()
    return np.array([tuple(r) for r in rows], float)


def test_quality_held_out(spark):
    rows = held_out(spark, "op2_quality", "quality")
    assert (rows[:, 0] == rows[:, 1]).mean() >= 0.95


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op6_toxicity", "toxic")
    assert (rows[:, 0] == rows[:, 1]).mean() >= 0.9 and rows[rows[:, 1] == 0, 0].mean() <= 0.02


def test_language_held_out(spark):
    got = queries.op4_langid(spark, SF).filter("held_out").join(queries.table(spark, SF, "documents"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n >= 0.97


def test_a_rare_language_is_learned_from_all_its_rows(spark):
    common = [(i, f"the committee will decide on the matter number {i} and the others after that", "en") for i in range(0, 8000, 2)]
    rare = [(100_001 + i, f"qwx zzyq vvok plurx number {i} qwxa zzyqa vvoka", "xx") for i in range(12)]
    table = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    got = langid.identify(table, bound=60).filter("doc_id > 100000")
    assert {r["lang_pred"] for r in got.collect()} == {"xx"}


@pytest.mark.parametrize("seed", range(5))
def test_block_max_search_is_exact(seed):
    draw = np.random.default_rng(seed)
    n, terms = 700, 30
    counts = draw.poisson(0.15, (n, terms))
    row, term = np.nonzero(counts)
    idf = draw.uniform(1, 4, terms)
    ids, toxic = draw.permutation(10_000)[:n], draw.integers(0, 2, n)
    index = toxicity.BlockMaxIndex(ids, toxic, row, term, counts[row, term], idf)
    weight = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    unit = weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)
    for _ in range(40):
        query = draw.poisson(0.15, terms)
        held = np.flatnonzero(query)
        if not len(held):
            continue
        q = np.where(query > 0, 1 + np.log(np.maximum(query, 1)), 0) * idf
        score = np.round(unit @ (q / np.linalg.norm(q)), 9)
        want = sorted((-s, i) for s, i in zip(score, ids, strict=True) if s > 0)[: toxicity.NEIGHBOURS]
        got = index.nearest(held, query[held])
        assert [i for _, i, _ in got] == [i for _, i in want]
        assert np.allclose([s for s, _, _ in got], [-s for s, _ in want])


def test_isotonic_levels_rise():
    draw = np.random.default_rng(1)
    rows = draw.integers(0, 5, calibrate.BINS)
    ones = draw.binomial(rows, np.linspace(0, 1, calibrate.BINS))
    levels = calibrate.isotonic(rows, ones)
    assert (np.diff(levels) >= -1e-12).all() and 0 <= levels.min() and levels.max() <= 1


def test_normal_equations_are_summed(spark):
    draw = np.random.default_rng(3)
    stats, label = draw.normal(size=(90, quality.STATISTICS)).astype(np.float32), draw.integers(0, 2, 90)
    rows = [(float(y), [float(v) for v in s]) for y, s in zip(label, stats, strict=True)]
    frame = spark.createDataFrame(rows, "label double, stats array<float>").repartition(5)
    features = quality.FourierMap(stats.mean(0), stats.std(0))
    square, product = quality._normal_equations(frame, features)
    x = features(stats.astype(float))
    assert np.allclose(square, x.T @ x) and np.allclose(product, x.T @ label)


def test_search_recall(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(1500, 24)) * draw.uniform(0.5, 2, (1500, 1))
    x[100:600] = x[100]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = nn_descent.neighbours(table, table.filter("vec_id % 20 = 0").select("vec_id")).collect()
    exact = np.float32(x).astype(float)
    found = total = 0
    for q in range(0, 1500, 20):
        score = exact @ exact[q]
        want = sorted((-score[i], i) for i in range(1500) if i != q)[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in mine)
        found += len({i for _, i, _ in mine} & {i for _, i in want})
        total += 20
    assert found / total >= 0.9


def recall(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = nn_descent.neighbours(table, table.filter("vec_id % 20 = 0").select("vec_id")).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    asked = range(0, len(x), 20)
    return np.mean([(q, int(i)) in found for q in asked for i in [j for j in np.argsort(-(x @ x[q]), kind="stable")[:21] if j != q][:20]])


def unit_vectors(seed, n=2000, width=24):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("times", [50, 1000, 1e6])
def test_search_recall_beside_one_long_vector(spark, times):
    x = unit_vectors(5)
    x[77] *= times
    assert recall(spark, x) >= 0.95


@pytest.mark.parametrize("noise", [1e-4, 1e-9])
def test_search_recall_with_near_copies(spark, noise):
    x = unit_vectors(6)
    copies = np.random.default_rng(7).permutation(2000)[:667]
    x[copies] = x[copies[0]] + noise * np.random.default_rng(9).normal(size=(667, 24))
    assert recall(spark, x) >= 0.9


def test_crowded_leaves_are_dealt_by_pivots(spark):
    x = unit_vectors(11, 4000, 8)
    form = nn_descent.Codes(8, 1.0, False)
    codes = spark.createDataFrame([(i, bytearray(c), 1, 4001) for i, c in enumerate(form.pack(x).to_pylist())], "node long, code binary, leaf long, was long")
    got = nn_descent._fitting(codes, form).select("group", "node").toPandas()
    assert sorted(got["node"]) == list(range(4000))
    assert got.groupby("group").size().max() <= 2 * nn_descent.LEAF
    group = got.sort_values("node")["group"].to_numpy()
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:6]
    assert (group[near] == group[:, None]).mean() >= 0.4  # at random: about the share of a group


def test_the_graph_travels_as_one_row_per_node(spark, monkeypatch):
    kept = []
    plain = nn_descent.stored
    monkeypatch.setattr(nn_descent, "stored", lambda df, name: kept.append((name, plain(df, name))) or kept[-1][1])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(unit_vectors(12, 300, 8))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nn_descent.neighbours(table, table.filter("vec_id % 20 = 0").select("vec_id")).count() == 15 * 20
    counts = {name: df.count() for name, df in kept}
    assert counts["graph"] == counts["steps"] == 300 and counts["pool"] == 15


def test_a_vector_goes_to_a_bounded_number_of_blocks(spark):
    form = nn_descent.Codes(64, 1.0, True)
    count = lambda total: nn_descent._block_count(total, form, total * (2 * nn_descent.DEGREE + 1))
    assert count(500) == count(10_256) == count(51_282) == nn_descent.BLOCKS
    # node 0 points to 1, 2, 3, of which 3 is new; 5 and 6 point to each other, neither is new
    edges = [(0, [1, 2, 3], [0.3, 0.2, 0.1], [0, 0, 1]), (4, [0], [0.5], [0]), (5, [6], [0.1], [0]), (6, [5], [0.1], [0])]
    lists = spark.createDataFrame(edges, "node long, members array<long>, sims array<double>, flags array<tinyint>").repartition(3)
    got = nn_descent._around(lists, 2).collect()
    compared = {r["node"]: dict(zip(r["members"], r["flags"], strict=True)) for r in got if r["kind"] == 1}
    assert compared == {0: {0: 0, 1: 0, 2: 0, 3: 1, 4: 0}, 3: {0: 1, 3: 0}}
    named = [(r["block"], m) for r in got if r["kind"] == 0 for m in r["members"]]
    assert len(named) == len(set(named))
    assert {m for _, m in named} == {0, 1, 2, 3, 4}


def test_search_runs_until_nothing_better_is_found(spark):
    # a ring: neighbours of neighbours lead on only step by step
    n = 1200
    turn = 2 * np.pi * np.arange(n) / n
    ring = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turn)]
    form = nn_descent.Codes(2, 1.0, False)
    vectors = np.array([v for _, v in ring])
    codes = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(form.pack(vectors).to_pylist())], "node long, code binary")
    steps = [(i, (i + d) % n, 0.0) for i in range(n) for d in (1, 2, 3, -1, -2, -3)]
    graph = spark.createDataFrame(steps, "u long, w long, sim double")
    asked = spark.createDataFrame([(0,), (600,)], "node long")
    got = nn_descent._search(graph, codes, asked, [300], form).toPandas()
    for q in (0, 600):
        # the 40 nearest on each side are the 80 best of the whole ring
        assert {(q + d) % n for d in range(-40, 41) if d} <= set(got[got["q"] == q]["node"])


PAGE = (
    "<html><head><title>no</title><style>p{}</style><script>var a='</p>';</script></head><body>"
    "<header class='site-header'>Site name <a href=/>Home</a></header><div id='cookie-notice'>We use cookies.</div>"
    "<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>"
    "<{tag}><h1>Head&nbsp;line &amp; more</h1><p>First  paragraph,\n with <b>bold</b>text, long enough to be read.</p>"
    "<div class='ad'>Buy now</div><p>Second one has &lt;angle&gt; marks, and some more words.<form><input>Mail<button>Go</button></form>"
    "<ul><li>Item one of the list, a sentence.<li>Item two of the list, a sentence.</ul></{tag}>"
    "<aside>Read also <a href=3>this</a></aside><div class='comments'><p>Nice post, thank you so much for it, friend.</p></div>"
    "<footer>&copy; someone</footer></body></html>"
)
TEXT = (
    "Head line & more\nFirst paragraph, with boldtext, long enough to be read.\n"
    "Second one has <angle> marks, and some more words.\nItem one of the list, a sentence.\nItem two of the list, a sentence."
)


def test_main_text_of_planted_pages(spark):
    pages = [(i, f"u{i}", PAGE.replace("{tag}", "article" if i % 2 else "main")) for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.main_text(frame).collect()} == {TEXT}


@pytest.mark.parametrize("tag", ["svg", "noscript", "template", "iframe", "textarea", "title"])
def test_an_unclosed_element_does_not_take_the_page(tag):
    page = html_text.Page(f"<div class='icon'><{tag}></div><article><p>Words of the article stay.</p></article><{tag}>")
    assert "Words of the article stay." in [text for _, text, _ in page.segments]
    assert not [s for s in html_text.Page("<p>a</p><script>var x = '<p>b</p>'").segments if "b" in s[1]]


def test_stray_quotes_and_unended_tags():
    read = lambda source: [text for _, text, _ in html_text.Page(source).segments]
    assert read('<div title="it"s"><p>one</p></div><p>two</p>') == ["one", "two"]
    assert read("<p class='a>b' id=\"c>d\">one</p>") == ["one"]
    assert read("<p>one</p><a href=") == ["one"]
    assert read("<p>one</p><!-- two <p>three</p>") == ["one"]
    assert read("<p>1 < 2 and 3</p>tail") == ["1 < 2 and 3", "tail"]


@pytest.mark.parametrize("part", ["<a ", "<svg>", "<a href=\"x", "<!--", "<p>x", "<b", "< ", "</", "<a =\"x\">", "&amp;"])
def test_very_long_broken_pages_are_read_in_one_pass(part):
    begun = time.perf_counter()
    html_text.Page("<p>one</p>" + part * (2_000_000 // len(part)))
    assert time.perf_counter() - begun < 20


def test_without_articles_the_markup_decides(spark):
    body = "<body><nav><a href=1>One</a></nav><div class=story><p>The text of the page.</p></div><div class=comments><p>Nice.</p></div><footer>(c)</footer></body>"
    frame = spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string")
    assert html_text.main_text(frame).first()["text"] == "The text of the page."


def test_no_python_starts_where_a_shuffle_leaves_no_rows(spark, monkeypatch):
    # mapInArrow starts Python in every partition of a shuffle, however many of them are empty
    plans = []
    plain = nn_descent.stored
    monkeypatch.setattr(nn_descent, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or plain(df, name))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(unit_vectors(13, 300, 8))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nn_descent.neighbours(table, table.filter("vec_id % 20 = 0").select("vec_id")).count() == 15 * 20
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for name, plan in plans:
        lines = plan.splitlines()
        for at, line in enumerate(lines):
            below = [x for x in lines[at + 1 :] if depth(x) > depth(line)]
            assert "MapInArrow " not in line or not any("REPARTITION" in x for x in below), (name, plan)
    hops = [plan for name, plan in plans if name == "pool"]
    assert len(hops) > 1 and all("MapInArrow" not in plan and plan.count("FlatMapGroupsInArrow") == 3 for plan in hops)
