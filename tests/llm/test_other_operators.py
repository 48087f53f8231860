"""Operators in a free style, against brute force on small fixtures."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ratewise.llm import bit_sliced, line_blocks, near_duplicates, packing, permutation_index, queries, tokens, toxicity_chain, vector_blocks

SF = "/root/testdata/sf0.001"


def brute_classes(rows):
    sets, holders = [], defaultdict(list)
    for i, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        for s in sets[-1]:
            holders[s].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), d if not sets[i] else least.get(root(i))) for i, (d, _) in enumerate(rows)]


def texts(seed=0):
    """Copies, chains of near copies, shared passages, short, empty and null texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcde", k=5))
    rows, base, passage = [], [word() for _ in range(150)], [word() for _ in range(60)]
    for _ in range(60):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = word()
        rows.append(" ".join(t))
        if r.random() < 0.3:
            base = t  # a chain
    for _ in range(80):
        rows.append(" ".join([word() for _ in range(r.randrange(40, 90))] + passage + [word() for _ in range(20)]))
    rows += ["one two", "One\tTWO", "one", "", "  \n", None, None, "a b c d e", "a b c d e f", " nbsp is a word"]
    rows += r.sample(rows[:100], 30)
    out = list(enumerate(rows))
    r.shuffle(out)
    return out + [out[0], (None, out[1][1]), (None, "alone without an id at all"), (3, "clashing id with another text")]


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    for f in (near_duplicates.candidate_links, near_duplicates.linked_across):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], block))
    rows = texts()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rep string, n_shingles int")
    got = near_duplicates.near_duplicates(df).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_classes(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("broadcast_rows", [near_duplicates.BROADCAST_ROWS, 0])
def test_deduplicated_keeps_one_of_each(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", broadcast_rows)  # 0: texts are found by a join
    rows = texts(1)
    df = spark.createDataFrame([(d, t, i, "x", 1, 2) for i, (d, t) in enumerate(rows)], "doc_id long, text string, rep int, __id string, loc int, row int")
    out = near_duplicates.deduplicated(df)
    assert out.columns == df.columns
    left = out.collect()
    brute = brute_classes(rows)
    empty = sum(n == 0 for _, n, _ in brute)
    classes = {c for _, n, c in brute if n and c is not None}
    other = 2  # the class without ids, and the class whose only id another class has too
    assert len(left) == empty + len(classes) + other and len({r.rep for r in left}) == len(left)


def test_components_of_stars_chains_and_random_links(spark):
    r = random.Random(5)
    links = [(10, i) for i in range(100, 700)] + [(i, i + 1) for i in range(1000, 1060)] + [(699, 5), (5, 5)]
    links += [(2000 + r.randrange(300), 2000 + r.randrange(300)) for _ in range(220)]
    r.shuffle(links)
    least = {x: x for e in links for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    got = near_duplicates.components(spark.createDataFrame(links, "a long, b long")).collect()
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert sorted((x.rep, x.component) for x in got) == sorted((x, m) for x, m in least.items() if x not in alone)


def test_near_duplicates_empty(spark):
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_properties(spark):
    rows = [(i, " ".join(["word"] * (37 * i % 900))) for i in range(300)] + [(300, "x " * 5000), (301, None), (302, ""), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, length int")
    got = packing.pack(df).collect()
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(n for _, n in p) <= 2048
    assert len(places) == -(-sum(r.length for r in got) // 2048)
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 300)
    assert long == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 5001 - 4096)]
    assert {r.ids_crc32 for r in got if r.doc_id in (301, 302)} == {zlib.crc32(b"\0\0\0\0")}
    assert sum(r.doc_id == 5 for r in got) == 3


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path(packing.VOCABULARY)
    real, mine = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["Hello, world... it's A.B. 12,5 x", "É ÎLE ǅ ﬁ Σας ΣΑΣ.", "a\x1cb c d e\u0085f", "<|endoftext|> x<|ENDOFTEXT|>y <|EndOfText|>", "",
             "é É. ,, .,. word., 'S don'T", "日本語 テスト。 ok"]
    texts += [t for (t,) in duckdb.connect().sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL LIMIT 60").fetchall()]
    for t, ids in zip(texts, mine(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == real.encode(t, add_special_tokens=False).ids, t


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(30):
        sizes = [r.randrange(1, 101) for _ in range(r.randrange(1, 200))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, room in enumerate(rooms) if room >= s]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(100 - s)
        runs = packing.plan(Counter(sizes), 100)
        used = Counter()
        for n, _, count, first, _ in runs:
            used.update({first + i: n for i in range(count)})
        assert len(used) == len(rooms) and sum(used.values()) == sum(sizes) and max(used.values()) <= 100
        assert sum(c for _, _, c, _, _ in runs) == len(sizes)


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist(), "c") for i in range(400)]
    rows += [(400, rows[0][1], "c"), (0, rows[1][1], "c"), (20, rows[20][1], "c"), (420, [0.0] * 16, "c"), (440, None, "c"), (460, [None] * 16, "c"),
             (480, [float("nan")] * 16, "c"), (500, [float("inf")] * 16, "c"), (520, [1.0, 2.0], "c"), (540, [], "c"), (None, rows[3][1], "c")]
    return rows


VECTORS = "vec_id long, embedding array<float>, score string"


def exact(rows, every, k, integer):
    ok = []
    for i, (d, v, _) in enumerate(rows):
        if d is None or not v or None in v or not np.isfinite(v).all() or (not integer and not any(v)):
            continue
        v = np.array(v, np.float32).astype(float)
        ok.append((i, d, np.floor(256 * v).astype(int) if integer else v))
    out = []
    for i, d, v in ok:
        if d % every == 0:
            best = sorted((-(v @ w), e) for j, e, w in ok if j != i and len(v) == len(w))[:k]
            out += [(d, n + 1, e, -s) for n, (s, e) in enumerate(best)]
    return sorted(out)


def test_bit_sliced_is_exact(spark):
    rows = vectors()
    got = bit_sliced.top_k(spark.createDataFrame(rows, VECTORS), every=10, k=5).collect()
    assert sorted(tuple(r) for r in got) == exact(rows, 10, 5, True)


def test_permutation_index_recall_and_scores(spark):
    rows = vectors()
    got = permutation_index.nearest(spark.createDataFrame(rows, VECTORS), every=10, k=20, pivots=64, prefix=32).collect()
    want = exact(rows, 10, 20, False)
    pairs = Counter((q, v) for q, _, v, _ in want)
    found = Counter((r.query_id, r.vec_id) for r in got)
    assert sum((pairs & found).values()) >= 0.9 * len(want) and len(got) == len(want)
    scores = {(q, v): s for q, _, v, s in want}
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-9 for r in got if (r.query_id, r.vec_id) in scores and r.query_id not in (0, 20))


@pytest.mark.parametrize("dim", [3, 64, 129])
def test_permutation_index_scores_copies_alike_in_blocks_of_any_size(dim):
    rng = np.random.default_rng(dim)
    query = rng.normal(size=dim)
    near = query + rng.normal(size=dim) / 100
    want = 0.0
    for x, y in zip(near, query, strict=True):
        want += x * y
    index = permutation_index.PermutationIndex({dim: rng.normal(size=(32, dim))}, prefix=16)
    ids, scores = [], []
    for n in (3, 17, 64, 1000, 1301):  # each block holds three copies, the greatest id first
        vectors = rng.normal(size=(n, dim)) / 10
        vectors[-3:] = near
        block = index.build(np.arange(n)[::-1] + 10_000 * n, vectors)
        asked = {"orders": index.orders(query[None]), "vectors": query[None]}
        i, s = index.best(block, asked, np.array([-1]), 3)
        assert i[0].tolist() == [10_000 * n + j for j in range(3)]
        ids, scores = ids + i[0].tolist(), scores + s[0].tolist()
    assert set(scores) == {want} and len(ids) == 15


@pytest.mark.parametrize("search", [bit_sliced.top_k, permutation_index.nearest])
def test_search_empty(spark, search):
    assert search(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("search", [bit_sliced.top_k, permutation_index.nearest])
def test_search_broadcasts_no_copies_of_queries(spark, monkeypatch, search):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), "c") for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    monkeypatch.setattr(vector_blocks.build_blocks, "__defaults__", (20,))  # 20 blocks
    spark.conf.set("spark.sql.maxBroadcastTableSize", "300k")  # the queries are less, 20 copies of them more
    try:
        got = search(df, every=1, k=3).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 1200 and {(r.query_id, r["rank"]) for r in got} == {(i, n) for i in range(400) for n in (1, 2, 3)}
    if search is bit_sliced.top_k:
        assert sorted(tuple(r) for r in got) == exact(rows, 1, 3, True)


def test_search_in_rounds_is_exact(spark, tmp_path):
    rows = vectors() + [(i, [3e4 * (i % 7), -2e4, i / 10], "c") for i in range(600, 700)]  # large components, and another length
    ok = vector_blocks.finite_vectors(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", zeros=True)
    index = bit_sliced.BitSlicedIndex()
    blocks = vector_blocks.build_blocks(ok, index, rows=60)
    is_query = lambda ids: ids % 2 == 0
    asked, rounds = vector_blocks.query_rounds(blocks, index, is_query, 5, str(tmp_path), 4000)
    sizes = [r["size"] for r in asked.groupBy("round").agg({"size": "sum"}).withColumnRenamed("sum(size)", "size").collect()]
    assert rounds > 5 and len(sizes) == rounds and max(sizes) < 2 * 4000  # the driver holds one round
    for round_bytes in (4000, 10**7):  # with one round, queries of both lengths meet in it
        got = vector_blocks.search(blocks, index, is_query, 5, query_rows=7, round_bytes=round_bytes).collect()
        assert sorted(tuple(r) for r in got) == exact(rows, 2, 5, True)


def test_bit_sliced_tells_queries_of_different_lengths_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 + i % 3).tolist(), "c") for i in range(90)]
    got = bit_sliced.top_k(spark.createDataFrame(rows, VECTORS), every=1, k=2).collect()
    assert sorted(tuple(r) for r in got) == exact(rows, 1, 2, True)


def test_adder_adds_bitmaps_by_position():
    rng = np.random.default_rng(3)
    adder, want = bit_sliced.Adder(), np.zeros(64, object)
    for at in [2, *rng.integers(2, 9, 200)]:
        bits = rng.integers(0, 2, 64, dtype=np.uint8)
        adder.add(int(at), np.packbits(bits, bitorder="little").view(np.uint64))
        want += bits.astype(int) << int(at)
    slices = adder.slices()
    assert slices[0] is None and slices[1] is None and all(len(bits) <= 2 for bits in adder.columns.values())
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(int) << c for c, s in enumerate(slices) if s is not None)
    assert (got == want).all() and bit_sliced.Adder().slices() == []


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav>
      <div class="sidebar-left"><p>side</p></div><div id=content><h2>Title &eacute;</h2><p>First\n  para &lt;b&gt; <i>x</i>.</p>
      <div class="advert">buy</div><p>Second<script>var a="</p>"</script> one.<ul><li>a<li>bb</ul><table><tr><td>c1<td>c2</table></div>
      <form><p>subscribe now</p></form><div class="comments"><p>nice post, nice post, nice post, nice post, nice post</p></div><footer>f</footer></body></html>"""
    pages = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain &amp; simple"), (5, "u", "<p>a<p>b<br>c"), (1, "u", page),
             (8, "u", "<div class='page no-sidebar'><main><p>body</p><div>in div</div></main></div>"),
             (9, "u", "<article><p>one</p><div><div>two</div></div><p>three</p></article><article class='comment'>" + "me too " * 99 + "</article>"),
             (6, "u", "<article><h1>T</h1><p>x</p><aside>zz</aside><p>" + "long " * 50000 + "</p><p>.</p></article><nav>n</nav>"), (7, "u", "<nav>only</nav>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in line_blocks.extract_main_text(df).collect())
    body = "Title é\nFirst para <b> x.\nSecond one.\na\nbb\nc1\nc2"
    want = {1: body, 2: "", 3: "", 4: "plain & simple", 5: "a\nb\nc", 6: "T\nx\n" + ("long " * 50000).strip() + "\n.", 7: "", 8: "body\nin div",
            9: "one\ntwo\nthree"}
    assert got == sorted((p, want[p], len(want[p])) for p, *_ in pages)


def test_main_text_of_nested_articles():
    assert line_blocks.main_text("<main><h1>Title</h1><p>Lead</p><article>Body</article></main>") == "Title\nLead\nBody"
    assert line_blocks.main_text("<article><p>A</p><article>quote</article><p>B</p></article>") == "A\nquote\nB"


def test_main_text_under_names_that_mention_chrome():
    text = line_blocks.main_text
    long = "A sentence of the article that is much too long to be one of a menu. " * 4
    assert text('<div class="row has-sidebar"><p>article</p></div><p>Read more</p>') == "article\nRead more"
    assert text(f'<div class="social-science"><p>{long}</p></div><p>more</p>') == long.strip() + "\nmore"
    assert text(f'<div class="widget"><p>{long}</p><p>x</p></div><p>more</p>') == long.strip() + "\nx\nmore"
    assert text(f'<div class="ad"><article>{long}</article></div>') == long.strip()
    assert text('<p title="A hidden gem">one</p><p style="overflow:hidden ">two</p><p hidden>gone</p>') == "one\ntwo"
    assert text('<div><p class="ad">buy<p>one<p>two</div>') == "one\ntwo"
    assert text('<ul><li class="share">x<li>y<ul><li>z</ul></ul><table><tr><td class=ad>x<td>c<tr><td>d</table>') == "y\nz\nc\nd"
    assert text(f"<form><p>{long}</p><p>x</p></form>") == long.strip() + "\nx"
    assert text("<body><form><p>all</p><p>of it</p></form></body>") == "all\nof it"
    # chrome still goes
    assert text(f'<p>{long}</p><form><p>Sign up</p></form><div class="sidebar-left">side</div><div class="comments"><p>{long}</p></div>') == long.strip()


def test_main_text_surges_and_dives():
    text = line_blocks.main_text
    long = ("A sentence of the article that is much too long to be one of a menu. " * 2).strip()
    menu = lambda c: f'<div class="{c}"><ul>' + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9)) + "</ul></div>"
    # no article, no list of tags or names tells these menus and the last line
    page = f'{menu("top")}<h1>T</h1><p>{long}</p><p>a</p><ul><li>b<li>c<li>d<li>e</ul><p>{long}</p><p>.</p>{menu("bottom")}<p>(c) site</p>'
    assert text(page) == f"T\n{long}\na\nb\nc\nd\ne\n{long}\n."
    # a menu amid the text parts it, and both sides stay
    assert text(f'<p>{long}</p>{menu("mid")}<p>{long}</p><p>x</p>') == f"{long}\n{long}\nx"
    # nothing surges: all but menus stays
    assert text(f'{menu("top")}<p>short</p>{menu("mid")}<p>text</p>') == "short\ntext"
    assert text(menu("only")).count("Item") == 9
    # articles that surge, or all if none does; text outside only if it outweighs them
    assert text(f"<article>{long}</article><article><p>{long}</p></article><article><a>teaser</a></article>") == f"{long}\n{long}"
    assert text("<article>one</article><article>second</article><p>foot</p>") == "one\nsecond"
    assert text(f"<p>{long}</p><p>{long}</p><article><p>short</p></article>") == f"{long}\n{long}\nshort"


def test_main_text_between_surge_and_dive_is_whole():
    text = line_blocks.main_text
    long = ("A sentence of the article that is much too long to be one of a menu. " * 2).strip()
    links = '<ul>' + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(4)) + "</ul>"
    four = "Link 0\nLink 1\nLink 2\nLink 3"
    page = f"<div>top</div><div id=content><p>{long}</p><p>short.</p>{links}<p>After list short.</p></div><div>bottom</div>"
    assert text(page) == f"{long}\nshort.\n{four}\nAfter list short."
    assert text(f"<body>{page}</body>") == text(page)
    # in the body itself a list goes on with the text, a division ends it
    assert text(f"<body><div>top</div><h1>T</h1><p>{long}</p>{links}<p>end</p><div>(c) site</div></body>") == f"T\n{long}\n{four}\nend"
    # two divisions that surge keep what lies between, but for menus
    assert text(f"<div>a</div><div><p>{long}</p></div><div>b</div><div>{links}</div><div><p>c</p><p>{long}</p></div><div>d</div>") == \
        f"{long}\nb\nc\n{long}"
    # a one-line note beside the text is not taken for text, however near its length comes to the threshold
    assert text(f"<div>{long[:110]}</div><div><p>{long}</p><p>x</p></div><div>{long[:110]}</div>") == f"{long}\nx"
    assert text("<div>" * 3000 + f"<p>{long}</p><p>x" + "</div>" * 3000 + "<div>foot</div>") == f"{long}\nx"


def test_comments_go_whatever_their_size_and_the_texts():
    text = line_blocks.main_text
    comments = "<div class=comments><p>" + "I say so too. " * 30 + "</p></div>"
    assert text(f"<article><p>Short text here.</p>{comments}</article>") == "Short text here."
    assert text(f"<div><p>Short text here.</p>{comments}</div>") == "Short text here."
    assert text(f"<p>One.</p><section id=disqus_thread><p>{'me too ' * 90}</p></section>") == "One."
    assert text(f"<article>{comments}</article>") == text(comments) == ""
    assert text(f'<div class="comments-page"><article>one</article>{comments}</div>') == "one"
    # a name that says chrome, but holds the text beside long comments
    body = "A sentence of the article that is much too long to be one of a menu. " * 2
    assert text(f"<article><div class=widget><p>{body}</p></div>{comments * 3}</article>") == body.strip()


def test_lines_surge_as_by_brute_force():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(0, 30)
        sizes = [r.choice((0, 5, 39, 40, 41, 60, 120, 400)) for _ in range(n)]
        divisions = sorted(r.randrange(4) for _ in range(n))
        want = set()
        for i in range(n):
            window = [j for j in range(i, min(i + line_blocks.WINDOW, n)) if divisions[j] == divisions[i]]
            if sum(sizes[j] for j in window) >= line_blocks.SURGE:
                want.update(j for j in window if sizes[j] * line_blocks.WINDOW >= line_blocks.SURGE)
        assert line_blocks._surging(sizes, divisions) == sorted(want)


def test_main_text_of_an_empty_table(spark):
    out = line_blocks.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, row string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 0


def test_main_text_of_given_pages_without_tags_and_names():
    """Neither the article's tag nor those of chrome nor any name: the line blocks alone."""
    import re

    rows = duckdb.connect().sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    same = 0
    for (page,) in rows:
        bare = re.sub(r"(</?)(article|main|nav|footer|aside|header|form)\b", r"\1div", page)
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|\S+?(?=[\s>]))", "", bare)
        want, got = line_blocks.main_text(page), line_blocks.main_text(bare)
        assert f"\n{want}\n" in f"\n{got}\n"
        same += want == got
    assert same >= 0.9 * len(rows)


def test_main_text_of_given_pages(spark):
    import html
    import re

    got = {r.page_id: r.text for r in queries.op8_line_block_text(spark, SF).collect()}
    for i, page in duckdb.connect().sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:h1|p|br)>", inner)]
        assert got[i] == "\n".join(b for b in blocks if b)


def test_toxicity_held_out(spark):
    con = duckdb.connect()
    rows = con.execute("SELECT doc_id, text, toxic FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' "
                       "USING (doc_id) ORDER BY doc_id").fetchall()
    train, test = rows[::2] + rows[1::4], rows[3::4]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, _ in rows], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(d, 1, x) for d, _, x in train] + [(None, 1, 1), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity_chain.judged_documents(docs, labels).collect()}
    toxic, clean = [got[d] for d, _, x in test if x], [got[d] for d, _, x in test if not x]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_toxicity_learns_all_words_of_long_texts(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(4500))
    bad = ["zbad" if i % 2 else "abad" for i in range(40)]
    rows = [(i, f"aaa {own(i)} {bad[i] if i < 20 else 'fine'}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(40)], "doc_id long, quality int, toxic int")
    links = {link.name: link for link in toxicity_chain.train(docs, labels).links}
    assert {"abad", "zbad"} <= set(links["toxic"].features)


def test_sample_is_encoded_as_in_one_place(spark):
    r = random.Random(4)
    texts = [" ".join(sorted({"".join(r.choices("abc", k=r.randrange(1, 9))) for _ in range(60)})) for _ in range(200)]
    y = [np.array([int(("bb" in t.split()) != (r.random() < 0.2)) for t in texts]), np.array([r.randrange(2) for _ in texts])]
    df = spark.createDataFrame(list(enumerate(texts)), "h long, text string").repartition(7)
    some, every = toxicity_chain.encode_sample(df, np.arange(200), y, most=20), toxicity_chain.Encoded.of(texts)
    order = np.argsort(np.array(every.names, object), kind="stable")  # equal gains go by name
    every = toxicity_chain.Encoded([every.names[i] for i in order], every.n_words, every.row, np.argsort(order)[every.feature])
    assert some.n_words.tolist() == every.n_words.tolist()
    for category in y:
        for fold in range(5):
            train = np.flatnonzero(np.arange(200) % 4 != fold)
            a, b = some.telling(train, category[train], 20), every.telling(train, category[train], 20)
            assert [some.names[i] for i in a] == [every.names[i] for i in b]
            assert (some.hits(a) == every.hits(b)).all()


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "word " * 100000, "c")], "doc_id long, text string, rejected string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity_chain.without_toxic(docs, none).count() == 4
    assert toxicity_chain.without_toxic(docs, none).columns == docs.columns
    odd = spark.createDataFrame([(1, None, 1), (1, 0, None), (2, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity_chain.judged_documents(docs, odd).count() == 4
    assert toxicity_chain.judged_documents(docs.limit(0), odd).count() == 0


def test_chain_feeds_earlier_categories():
    words = ["junk x" if i % 2 else "fine y" for i in range(200)]
    first = np.array([i % 2 for i in range(200)])
    chain = toxicity_chain.fit_chain(words, [("first", first), ("second", first)])
    assert len(chain.links[1].weights) == len(chain.links[1].features) + 4 and chain.links[1].weights[-2] > 0


def test_words_are_encoded_as_the_tokenizer_encodes_texts():
    rng = random.Random(5)
    signs = [*"abzAZ09'.,!$<|>-_`^%&*()", *"\u00e9\u00c9\u00e8\u00df\u00f1\u00ff\u00f7\u00d7\u0130\u0131\u017f\ufb01\u0338\u0327\u0301\u00b2\u00bd\u2167\u0958\u65e5\u200d",
             *" \u00a0\u3000\t\n\x1c\x85", "<|endoftext|>", "x<|endoftext|>.", "'s", "'re"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    encode = packing.encoder(packing.VOCABULARY)
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
